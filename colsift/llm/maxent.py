"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(word | class). A word's shape (its last characters and how it begins) is hashed to
one of some keys; keys that stand beside the same other keys all over the training corpus share a class (correspondence
analysis of the neighbour counts, then k-means). P(class | history) is a softmax over weights of hashed features: the previous word, the word before it (a skip
feature), the classes of the last two words and of the last three. It is trained by distributed gradient updates: in each
round every task runs Adagrad over mini-batches of its share of the corpus, and the tasks' steps are averaged row by row,
weighted by how often each saw the row; every training document is used in exactly one round. These tables are of fixed size.

P(word | class, history) grows with the corpus: it is counted, not trained. Its n-gram feature is the previous word, its skip
feature the word before that; each with a class is a context. The training tokens after every context are counted by hashed
(context, word) in a distributed table. A context gives a word its share, less an absolute discount that goes to what the skip
context gives it, and from there to the word's share of the training tokens of its class, less a discount that goes to the
class's unknown words as one outcome.

The corpus is encoded once, in blocks of some megabytes: token numbers and the block's distinct words. The words travel to
buckets, where they are counted over all blocks, and their counts travel back; so do the contexts with the words after them. No
vocabulary is broadcast or collected. To
the driver come the neighbour counts of the keys, the weights (both of fixed size), and a few numbers a class.

Null texts are empty: their only token is the end. Texts are used whole. Repeated rows and ids are learned from and scored one
by one. A null id is held out. Without training documents every word is unknown. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from colsift.llm.texts import is_fold, narrow, slices
from colsift.plans.session import cut_lineage

FIGURES = 4  # a class's training tokens, distinct words, words met once, words met twice
FEW = 8


@dataclass(frozen=True)
class Settings:
    """Sizes of the hashed feature tables, the training and the work units. All are fixed, whatever the corpus."""

    classes: int = 48
    keys: int = 1024
    dimensions: int = 24
    word_rows: int = 8192
    history_rows: int = 8192
    rounds: int = 2
    rate: float = 0.3
    batch: int = 2048
    chunk_rows: int = 64
    block_bytes: int = 8 << 20
    bucket_words: int = 1_000_000
    bucket_pairs: int = 2_000_000

    @property
    def sizes(self) -> tuple[int, ...]:
        """Rows of the feature tables: previous word, word before it, last two classes, last three classes."""
        return self.word_rows, self.word_rows, (self.classes + 1) ** 2, self.history_rows


def packed(values: np.ndarray | bytes) -> bytes:
    """Compressed; of numbers first all lowest bytes, then all next ones, as most numbers are small."""
    if not isinstance(values, bytes):
        whole = values.reshape(-1).view(f"u{values.itemsize}")
        top = int(whole.max()).bit_length() if len(whole) else 0
        values = b"".join((whole >> whole.dtype.type(8 * i)).astype(np.uint8).tobytes() if 8 * i < top else bytes(len(whole))
                          for i in range(values.itemsize))
    return zstandard.ZstdCompressor(level=3).compress(values)


def unpacked(data: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    if kind is None:
        return raw
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    whole = planes[0].astype(f"u{len(planes)}")
    for i, plane in enumerate(planes[1:], 1):
        if plane.any():
            whole |= plane.astype(whole.dtype) << whole.dtype.type(8 * i)
    return whole.view(kind)


def stable_order(values: np.ndarray) -> np.ndarray:
    """np.argsort(values, kind="stable") of whole numbers from 0. As many of their highest bits as fit beside a place are sorted
    as plain numbers, which takes a fraction of the time; numbers that differ in lower bits only are put right afterwards."""
    if not len(values):
        return np.zeros(0, np.int64)
    places = len(values).bit_length()
    low = np.uint64(max(0, int(values.max()).bit_length() + places - 64))
    line = values.astype(np.uint64)
    line >>= low
    line <<= np.uint64(places)
    line |= np.arange(len(values), dtype=np.uint64)
    line.sort()
    line &= np.uint64((1 << places) - 1)
    order = line.view(np.int64)
    if low:
        line = values[order]
        if (line[1:] < line[:-1]).any():
            order = order[np.argsort(line, kind="stable")]
    return order


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(values, return_inverse=True) of whole numbers from 0."""
    order = stable_order(values)
    line = values[order]
    begins = np.r_[True, line[1:] != line[:-1]][:len(line)]
    line = line[begins]
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(begins, dtype=np.int32) - np.int32(1)
    return line, of


def shape_key(word: bytes, keys: int) -> int:
    """The hashed shape of a word: its last three bytes and the kind of the first."""
    first = word[:1]
    kind = b"u" if first.isupper() else b"l" if first.islower() else b"d" if first.isdigit() else b"o" if first < b"\x80" else b"x"
    return zlib.crc32(word[-3:] + kind) % keys


def shape_keys(words: list[bytes], keys: int) -> np.ndarray:
    """The shape key of each word, worked out once for words alike in what it depends on."""
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    ends, tail = np.cumsum(sizes), np.minimum(sizes, 3)
    shape = data[ends - sizes].astype(np.uint64) << np.uint64(2) | tail.astype(np.uint64)
    for k in (1, 2, 3):
        shape = shape << np.uint64(8) | np.where(tail >= k, data[ends - np.minimum(tail, k)], 0).astype(np.uint64)
    _, first, of = np.unique(shape, return_index=True, return_inverse=True)
    return np.array([shape_key(words[i], keys) for i in first.tolist()], np.uint16)[of]


def lowered_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    raw = np.frombuffer(b" ".join(data).lower(), np.uint8)
    solid = (raw != 32) & (raw - np.uint8(9) > 4)
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    offsets = np.zeros(len(edges) // 2 + 1, np.int64)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])])
    return words, np.diff(np.searchsorted(edges[::2], ends), prepend=0)


def encode(docs: DataFrame, settings: Settings) -> DataFrame:
    """A row per block of (doc_id, text, held_out): its documents, their token numbers (0: end), its words in byte order and
    for each word (the end first) training count, shape key and hash. Binary columns are compressed."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = StructType.fromDDL(f"doc_ids array<{id_type}>, held array<boolean>, sizes array<int>, n_words int, tokens binary, "
                             "words binary, counts binary, keys binary, hashes binary")
    schema = to_arrow_schema(out)
    place = docs.columns.index("text")

    def block(part):  # a function, so that nothing of a block is left when the next one is made
        rows = part.to_pydict()
        held = np.array(rows["held_out"], bool)
        found, sizes = lowered_words(rows["text"])
        found = found.dictionary_encode()
        order = pc.sort_indices(found.dictionary).to_numpy()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(order)], found.dictionary.take(order)), pa.scalar(b" ", pa.large_binary()))[0].as_py()
        words = joined.split()
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(1, len(words) + 1, dtype=np.uint32)
        tokens = np.insert(rank[found.indices.to_numpy()], np.cumsum(sizes), 0)  # an end after each text
        sizes = sizes + 1
        learned = tokens[~np.repeat(held, sizes)]
        counts = np.bincount(learned, minlength=len(words) + 1).astype(np.uint32)
        keys = np.full(len(words) + 1, settings.keys, np.uint16)  # the end has a key of its own
        keys[1:] = shape_keys(words, settings.keys)
        hashes = np.zeros(len(words) + 1, np.uint32)
        hashes[1:] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        return pa.RecordBatch.from_arrays([
            pa.array([rows["doc_id"]], schema.field("doc_ids").type), pa.array([held.tolist()], pa.list_(pa.bool_())),
            pa.array([sizes], pa.list_(pa.int32())), pa.array([len(words)], pa.int32()),
            *(pa.array([packed(x)], pa.binary()) for x in (tokens, joined, counts, keys, hashes))],
            schema=schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, place, settings.block_bytes):
                yield block(part)

    return docs.mapInArrow(run, out)


def histories(tokens: np.ndarray, sizes: np.ndarray, classes: np.ndarray, hashes: np.ndarray, settings: Settings):
    """The class of each token and its feature rows, one array a feature. Before a text stand boundaries."""
    c, h = classes[tokens].astype(np.int32), hashes[tokens]
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def back(values: np.ndarray, k: int, boundary: int) -> np.ndarray:
        moved = np.empty_like(values)
        moved[k:] = values[:-k] if len(values) > k else values[:0]
        moved[place < k] = boundary
        return moved

    none = settings.classes
    c1, c2, c3 = (back(c, k, none) for k in (1, 2, 3))
    w1, w2 = back(h, 1, 0) % settings.word_rows, back(h, 2, 0) % settings.word_rows
    pair = c1 * (none + 1) + c2
    triple = ((pair * (none + 1) + c3).astype(np.uint32) * np.uint32(2654435761) >> np.uint32(7)) % settings.history_rows
    starts = np.cumsum((0, *settings.sizes[:-1]))
    return c, [(rows.astype(np.int64) + start).astype(np.uint16) for rows, start in zip((w1, w2, pair, triple), starts)]


def odds(weights: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """What the chances of the classes are in proportion to, a line per token, from the prior's logarithms plus the rows' weights."""
    z = weights.take(rows[0], axis=0)
    z += prior
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def chances(weights: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """The softmax over the classes, a line per token."""
    z = odds(weights, rows, prior)
    z /= z.sum(axis=1, keepdims=True)
    return z


def row_sums(slope: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different feature rows, how often each is there, and the sum of its lines of `slope` (entry i of `rows` is for line i
    modulo the lines). Most rows are there a few times: these are added side by side, in the order in which numpy adds so many."""
    order = np.argsort(rows, kind="stable")
    line = rows[order]
    order %= len(slope)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    n = np.diff(np.r_[first, len(line)])
    own, times = line[first], n
    by = np.argsort((len(line) - n).astype(np.uint16 if len(line) < 1 << 16 else np.int64), kind="stable")
    first, n = first[by], n[by]  # those there most often come first
    more = [int(k) for k in np.searchsorted(-n, -np.arange(FEW + 1))]  # how many rows are there more than 0, 1, 2... times
    total = slope.take(order[first], axis=0)
    many, some = more[FEW], more[1]
    if some > many:
        rest = slope.take(order[first[many:some] + 1], axis=0)
        for k in range(2, FEW):
            if more[k] == many:
                break
            rest[:more[k] - many] += slope.take(order[first[many:more[k]] + k], axis=0)
        total[many:some] += rest
    if many:
        ends = np.cumsum(n[:many])
        at = np.arange(ends[-1]) + np.repeat(first[:many] - ends + n[:many], n[:many])
        total[:many] = np.add.reduceat(slope.take(order[at], axis=0), ends - n[:many], axis=0)
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return own, times, total.take(back, axis=0)


class Learner:
    """Adagrad on the class weights, from given weights; each feature row has one sum of squared slopes."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray, settings: Settings):
        self.start, self.weights, self.prior, self.settings = weights, weights.copy(), prior, settings
        self.squares = np.full(len(weights), 1e-2, np.float32)
        self.seen = np.zeros(len(weights), np.float32)

    def learn(self, c: np.ndarray, rows: list[np.ndarray]) -> None:
        for at in range(0, len(c), self.settings.batch):
            target = c[at:at + self.settings.batch]
            some = [r[at:at + self.settings.batch] for r in rows]
            slope = chances(self.weights, some, self.prior)
            slope[np.arange(len(target)), target] -= 1
            own, n, step = row_sums(slope, np.concatenate(some))  # no two features share a row
            squares = self.squares[own] + np.einsum("ij,ij->i", step, step)
            self.squares[own] = squares
            step *= (self.settings.rate / np.sqrt(squares))[:, None]
            self.weights[own] = np.subtract(self.weights.take(own, axis=0), step, out=step)
            self.seen[own] += n


def block_rows(batches, *names):
    """The values of the named columns, block by block."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for row in range(batch.num_rows):
            yield [c[row].as_py() for c in columns]


def summed(frame: DataFrame, table, shape: tuple[int, int], per: int) -> np.ndarray:
    """The sum over the tasks of `frame` of the tables (arrays of `shape`) that `table(batches)` makes of their rows. The tables
    travel in chunks of `per` lines, and each chunk is summed on one executor."""
    kind = "chunk int, part binary"

    def cut(batches):
        own = table(batches).astype(np.float32)
        places = [i for i in range(0, len(own), per) if own[i:i + per].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // per for i in places], pa.int32()),
                                          pa.array([packed(own[i:i + per]) for i in places], pa.binary())], ["chunk", "part"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for chunk, part in block_rows(batches, "chunk", "part"):
            part = unpacked(part, np.float32).astype(np.float64)
            total[chunk] = total[chunk] + part if chunk in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(t) for t in total.values()], pa.binary())],
                                         ["chunk", "part"])

    result = np.zeros(shape)
    for chunk, part in frame.mapInArrow(cut, kind).repartition("chunk").mapInArrow(add, kind).collect():
        lines = unpacked(part, np.float64).reshape(-1, shape[1])
        result[chunk * per:chunk * per + len(lines)] = lines
    return result


def neighbour_counts(blocks: DataFrame, settings: Settings) -> np.ndarray:
    """How often each key follows each in the training documents; before a text stands the end's key."""
    n = settings.keys + 1

    def table(batches):
        counts = np.zeros(n * n)
        for held, sizes, tokens, keys in block_rows(batches, "held", "sizes", "tokens", "keys"):
            sizes = np.array(sizes, np.int64)
            key = unpacked(keys, np.uint16).astype(np.int64)[unpacked(tokens, np.uint32)]
            before = np.r_[settings.keys, key[:-1]]
            before[np.cumsum(sizes) - sizes] = settings.keys
            used = ~np.repeat(np.array(held, bool), sizes)
            counts += np.bincount(before[used] * n + key[used], minlength=n * n)
        return counts.reshape(n, n)

    return summed(blocks.select("held", "sizes", "tokens", "keys"), table, (n, n), settings.chunk_rows)


def key_classes(counts: np.ndarray, settings: Settings) -> np.ndarray:
    """The class of each key; the end's is 0. Weighted k-means from far-apart seeds on the keys' correspondence coordinates."""
    smooth = counts + 0.02
    rows, columns, total = smooth.sum(1), smooth.sum(0), smooth.sum()
    left, strength, right = np.linalg.svd(smooth / np.sqrt(np.outer(rows, columns)))
    some = slice(1, settings.dimensions + 1)
    points = np.hstack([left[:, some] * strength[some] / np.sqrt(rows / total)[:, None],
                        right[some].T * strength[some] / np.sqrt(columns / total)[:, None]])[:-1]
    weight = columns[:-1] / total
    centres = points[[int(weight.argmax())]]
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < settings.classes - 1:
        centres = np.vstack([centres, points[int((far * weight).argmax())]])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(30):
        nearest = ((points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1)).argmin(1)
        for j in range(len(centres)):
            if (nearest == j).any():
                centres[j] = np.average(points[nearest == j], axis=0, weights=weight[nearest == j])
    return np.r_[nearest + 1, 0].astype(np.uint8)


def train(blocks: DataFrame, classes: np.ndarray, prior: np.ndarray, settings: Settings) -> np.ndarray:
    """The class weights on top of the prior. In round r learn the blocks whose number has remainder r."""
    context = blocks.sparkSession.sparkContext
    weights = np.zeros((sum(settings.sizes), settings.classes), np.float32)

    for round_ in range(settings.rounds):
        shared = context.broadcast(weights)

        def steps(batches):
            learner = Learner(shared.value, prior, settings)
            for held, sizes, tokens, keys, hashes in block_rows(batches, "held", "sizes", "tokens", "keys", "hashes"):
                sizes = np.array(sizes, np.int64)
                c, rows = histories(unpacked(tokens, np.uint32), sizes, classes[unpacked(keys, np.uint16)], unpacked(hashes, np.uint32), settings)
                used = ~np.repeat(np.array(held, bool), sizes)
                learner.learn(c[used], [r[used] for r in rows])
            return np.c_[(learner.weights - learner.start) * learner.seen[:, None], learner.seen]

        share = blocks.filter(F.pmod("block", F.lit(settings.rounds)) == round_).select("held", "sizes", "tokens", "keys", "hashes")
        total = summed(share, steps, (len(weights), settings.classes + 1), settings.chunk_rows)
        weights = weights + (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32)
        shared.unpersist()
    return weights


def deal(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words, counts): the words of each block, dealt to buckets by hash, in the block's order."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words = unpacked(batch.column("words")[row].as_py()).split()
                counts = unpacked(batch.column("counts")[row].as_py(), np.uint32)[1:]
                bucket = unpacked(batch.column("hashes")[row].as_py(), np.uint32)[1:] % buckets
                order = stable_order(bucket)
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = [(b, order[ends[b]:ends[b + 1]]) for b in range(buckets) if ends[b + 1] > ends[b]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in some], pa.int32()),
                    pa.array([batch.column("block")[row].as_py()] * len(some), pa.int64()),
                    pa.array([packed(b" ".join([words[i] for i in at.tolist()])) for _, at in some], pa.binary()),
                    pa.array([packed(counts[at]) for _, at in some], pa.binary())], ["bucket", "block", "words", "counts"])

    return blocks.select("block", "words", "counts", "hashes").mapInArrow(
        run, "bucket int, block bigint, words binary, counts binary")


def count_buckets(dealt: DataFrame, classes: np.ndarray, settings: Settings) -> DataFrame:
    """(bucket, block, counts) with the counts over all blocks; and a row with block NULL per bucket whose `figures` are the
    class figures of the bucket's words."""
    def run(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        words = [unpacked(w).split() for w in table.column("words").to_pylist()]
        for own, counts in zip(words, table.column("counts").to_pylist()):
            for w, n in zip(own, unpacked(counts, np.uint32).tolist()):
                total[w] = total.get(w, 0) + n
        counts = np.fromiter(total.values(), np.int64, len(total))
        own_class = classes[shape_keys(list(total), settings.keys)]
        figures = np.stack([np.bincount(own_class, weights=x, minlength=settings.classes)
                            for x in (counts, counts > 0, counts == 1, counts == 2)], axis=1).astype(np.int64)
        bucket = table.column("bucket")[0].as_py()
        back = [packed(np.fromiter(map(total.__getitem__, own), np.uint64, len(own))) for own in words]
        return pa.table({"bucket": pa.array([bucket] * (len(back) + 1), pa.int32()),
                         "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
                         "counts": pa.array([*back, None], pa.binary()),
                         "figures": pa.array([*[None] * len(back), figures.ravel().tolist()], pa.list_(pa.int64()))})

    return dealt.groupBy("bucket").applyInArrow(run, "bucket int, block bigint, counts binary, figures array<bigint>")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of numbers."""
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Pairs:
    """The distinct (context, word) pairs of a block, by bucket and context. `of` has the pairs of each token: of the previous
    word and of the word before it."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, classes: np.ndarray, words: list[bytes], buckets: int):
        marks = np.ones(len(words) + 1, np.uint64)  # the first is the end, which also stands before a text
        marks[1:] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        contexts, own, self.of, size = [], [], [], 0
        for k in (1, 2):
            before = np.zeros(len(tokens), np.uint64)
            before[k:] = tokens[:-k] if len(tokens) > k else tokens[:0]
            before[place < k] = 0
            code, of = distinct(before * np.uint64(len(marks)) + tokens)
            before = code // np.uint64(len(marks))
            word = (code - before * np.uint64(len(marks))).astype(np.int64)
            contexts.append(mixed(marks[before.astype(np.int64)], classes[word].astype(np.uint64) * np.uint64(2) + np.uint64(k - 1)) >> np.uint64(16))
            own.append((marks[word] >> np.uint64(32)).astype(np.uint32))
            self.of.append(of + np.int32(size))
            size += len(code)
            del before, code, of, word
        context, mark = np.concatenate(contexts), np.concatenate(own)
        del contexts, own
        order = stable_order(context)
        self.contexts, self.marks = context[order], mark[order]
        del context, mark
        back = np.empty(size, np.int32)
        back[order] = np.arange(size, dtype=np.int32)
        self.of = [back[of] for of in self.of]
        self.first = np.flatnonzero(np.r_[True, self.contexts[1:] != self.contexts[:-1]][:size])  # where a context begins
        self.runs = np.diff(np.r_[self.first, size]).astype(np.uint32)
        # 48 bits of context, in ranges: close numbers, whose differences are small
        self.bucket = (self.contexts[self.first] // np.uint64(-(-(1 << 48) // buckets))).astype(np.int64)


def deal_pairs(blocks: DataFrame, classes: np.ndarray, buckets: int) -> DataFrame:
    """The pairs of each block, dealt to buckets by context: the contexts, how many pairs each has, the pairs' words as hashes
    and their training counts."""
    shared = blocks.sparkSession.sparkContext.broadcast(classes)

    def dealt(block, held, sizes, tokens, words, keys):  # nothing of a block is left when the next one is dealt
        sizes, tokens = np.array(sizes, np.int64), unpacked(tokens, np.uint32)
        pairs = Pairs(tokens, sizes, shared.value[unpacked(keys, np.uint16)], unpacked(words).split(), buckets)
        used = ~np.repeat(np.array(held, bool), sizes)
        counts = sum(np.bincount(of[used], minlength=len(pairs.marks)) for of in pairs.of).astype(np.uint32)
        ends = np.searchsorted(pairs.bucket, np.arange(buckets + 1))
        starts = np.r_[pairs.first, len(pairs.marks)]
        some = [b for b in range(buckets) if ends[b + 1] > ends[b]]
        run_of, pair_of = lambda b: slice(ends[b], ends[b + 1]), lambda b: slice(starts[ends[b]], starts[ends[b + 1]])
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()),
            *(pa.array([packed(x) for x in column], pa.binary()) for column in (
                [np.diff(pairs.contexts[pairs.first[run_of(b)]], prepend=np.uint64(0)) for b in some], [pairs.runs[run_of(b)] for b in some],
                [pairs.marks[pair_of(b)] for b in some], [counts[pair_of(b)] for b in some]))],
            ["bucket", "block", "contexts", "runs", "marks", "counts"])

    def run(batches):
        for row in block_rows(batches, "block", "held", "sizes", "tokens", "words", "keys"):
            yield dealt(*row)

    return blocks.select("block", "held", "sizes", "tokens", "words", "keys").mapInArrow(
        run, "bucket int, block bigint, contexts binary, runs binary, marks binary, counts binary")


def count_pairs(dealt: DataFrame) -> DataFrame:
    """(bucket, block, counts, totals, kinds): over all blocks the training tokens of each pair and context and the distinct
    words of each context; and a row with block NULL per bucket with the number of pairs met once and twice."""
    def run(table: pa.Table) -> pa.Table:
        column = lambda name, kind: [unpacked(x, kind) for x in table.column(name).to_pylist()]
        contexts, runs, marks = [np.cumsum(c, dtype=np.uint64) for c in column("contexts", np.uint64)], column("runs", np.uint32), column("marks", np.uint32)
        own, context_of = distinct(np.concatenate(contexts))
        of_run = np.repeat(context_of, np.concatenate(runs))
        pair, of = distinct(of_run.astype(np.uint64) << np.uint64(32) | np.concatenate(marks))
        n = np.bincount(of, weights=np.concatenate(column("counts", np.uint32)))
        context_of_pair = (pair >> np.uint64(32)).astype(np.int64)
        totals = np.bincount(context_of_pair, weights=n, minlength=len(own)).astype(np.uint64)
        kinds = np.bincount(context_of_pair, weights=n > 0, minlength=len(own)).astype(np.uint64)
        once, twice = int((n == 1).sum()), int((n == 2).sum())
        back = n[of].astype(np.uint64)
        cut = lambda values, sizes: [packed(x) for x in np.split(values, np.cumsum(sizes)[:-1])]
        by_run = [len(c) for c in contexts]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * (len(runs) + 1), pa.int32()),
                         "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
                         "counts": pa.array([*cut(back, [len(m) for m in marks]), None], pa.binary()),
                         "totals": pa.array([*cut(totals[context_of], by_run), None], pa.binary()),
                         "kinds": pa.array([*cut(kinds[context_of], by_run), None], pa.binary()),
                         "figures": pa.array([*[None] * len(runs), [once, twice]], pa.list_(pa.int64()))})

    return dealt.groupBy("bucket").applyInArrow(
        run, "bucket int, block bigint, counts binary, totals binary, kinds binary, figures array<bigint>")


def context_shares(counts: np.ndarray, totals: np.ndarray, kinds: np.ndarray, runs: np.ndarray, discount: float) -> np.ndarray:
    """A line per pair, side by side what `interpolated` needs: the pair's tokens less a discount, what the discounts in its
    context add up to, and the context's tokens. A context without training tokens leaves a chance as it is."""
    known = totals > 0
    shares = np.empty((len(counts), 3))
    shares[:, 0] = np.maximum(counts - discount, 0)
    shares[:, 1] = np.repeat(np.where(known, discount * kinds, 1), runs)
    shares[:, 2] = np.repeat(np.where(known, totals, 1), runs)
    return shares


def interpolated(chance: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return (shares[:, 0] + shares[:, 1] * chance) / shares[:, 2]


def with_context(chance: np.ndarray, counts: np.ndarray, totals: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """P(word | class, context): the word's share of the context's tokens, less a discount that goes to `chance`."""
    return interpolated(chance, context_shares(counts, totals, kinds, np.ones(len(counts), np.int64), discount))


SCORED = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def class_prior(figures: np.ndarray) -> np.ndarray:
    """Log shares of the classes in the training tokens."""
    tokens = figures[:, 0] + 0.1
    return np.log(tokens / tokens.sum()).astype(np.float32)


def score_blocks(blocks: DataFrame, classes: np.ndarray, weights: np.ndarray, figures: np.ndarray, pair_discount: float,
                 settings: Settings) -> DataFrame:
    """A row per document from the blocks with their returned counts of words and pairs."""
    id_field = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    out = StructType.fromDDL(f"doc_id {id_field}, held_out boolean, {SCORED}")
    schema = to_arrow_schema(out)
    ends = int(figures[0, 0])
    all_tokens, distinct = int(figures[:, 0].sum()), int(figures[:, 1].sum())
    total, kept, once, twice = figures.astype(float).T
    discount = (once + 0.5) / (once + 2 * twice + 1)
    lost = np.log10(np.where(total > 0, discount * kept / np.maximum(total, 1), 1.0))
    shared = blocks.sparkSession.sparkContext.broadcast((classes, weights, class_prior(figures), discount, total, lost))

    def scored(value):  # nothing of a block is left when the next one is scored
        class_of, weights, prior, discount, total, lost = shared.value
        sizes = np.array(value["sizes"], np.int64)
        tokens, keys, hashes = (unpacked(value[n], k) for n, k in (
            ("tokens", np.uint32), ("keys", np.uint16), ("hashes", np.uint32)))
        classes = class_of[keys]
        counts = np.zeros(len(classes), np.int64)
        counts[0] = ends
        if len(classes) > 1:
            bucket = hashes[1:] % value["buckets"]
            back = sorted(value["returned"], key=lambda r: r["bucket"])
            counts[1 + stable_order(bucket)] = np.concatenate([unpacked(r["counts"], np.uint64) for r in back])
        known = counts > 0
        of = classes.astype(np.int64)
        word = np.where(known, np.log10(np.maximum(counts - discount[of], 1e-9) / np.maximum(total[of], 1)), lost[of])
        base = np.log10((counts + 0.1) / (all_tokens + 0.1 * (distinct + 1)))
        pairs = Pairs(tokens, sizes, classes, unpacked(value["words"]).split(), value["pair_buckets"])
        runs, of_pairs = pairs.runs, pairs.of[::-1]
        del pairs, value["words"]
        back = sorted(value.pop("returned_pairs"), key=lambda r: r["bucket"])
        n, all_n, kinds = (np.concatenate([unpacked(r[k], np.uint64) for r in back]) for k in ("counts", "totals", "kinds"))
        shares = context_shares(n, all_n, kinds, runs, pair_discount)
        del back, n, all_n, kinds, runs
        gained, word = np.empty(len(tokens)), 10 ** word
        for at in range(0, len(tokens), 1 << 16):
            some = slice(at, at + (1 << 16))
            chance = word[tokens[some]]
            for of in of_pairs:
                chance = interpolated(chance, shares.take(of[some], axis=0))
            gained[some] = np.log10(np.maximum(chance, 1e-300))
        del shares, of_pairs
        c, rows = histories(tokens, sizes, classes, hashes, settings)
        for at in range(0, len(c), settings.batch):
            some = slice(at, at + settings.batch)
            line = odds(weights, [r[some] for r in rows], prior)
            gained[some] += np.log10(np.maximum(line[np.arange(len(line)), c[some]] / line.sum(axis=1), 1e-30))
        first = np.cumsum(sizes) - sizes
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((
            value["doc_ids"], value["held"], sizes, np.add.reduceat(known[tokens].astype(np.int64), first),
            [all_tokens] * len(sizes), np.add.reduceat(base[tokens], first), np.add.reduceat(gained, first)),
            schema.types)], schema=schema)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield scored({n: batch.column(n)[row].as_py() for n in batch.schema.names})

    return blocks.mapInArrow(run, out)


def score_documents(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score (log10 probability by the
    model) of every row. Learns from fold-10 remainders other than 0."""
    rows = narrow(docs, id_column, text_column, held_out=is_fold(id_column, 10, 0))
    blocks = cut_lineage(encode(rows, settings).withColumn("block", F.monotonically_increasing_id()), "blocks")
    entries, ends, tokens = blocks.agg(F.sum("n_words"), F.sum(F.size(F.filter("held", lambda h: ~h))), F.sum(
        F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()
    entries, ends, tokens = entries or 0, ends or 0, tokens or 0
    buckets = max(8, -(-entries // settings.bucket_words))
    classes = key_classes(neighbour_counts(blocks, settings), settings)
    returned = cut_lineage(count_buckets(deal(blocks, buckets), classes, settings), "counts")
    figures = np.zeros((settings.classes, FIGURES), np.int64)
    for place, n in returned.filter(F.col("block").isNull()).select(F.posexplode("figures").alias("i", "n")).groupBy("i").agg(
            F.sum("n")).collect():
        figures[place // FIGURES, place % FIGURES] = n
    figures[0] = (ends, ends > 0, ends == 1, ends == 2)  # the end is no word of a bucket
    pair_buckets = max(8, -(-2 * tokens // settings.bucket_pairs))
    pairs = cut_lineage(count_pairs(deal_pairs(blocks, classes, pair_buckets)), "pairs")
    once, twice = pairs.filter(F.col("block").isNull()).agg(F.sum(F.col("figures")[0]), F.sum(F.col("figures")[1])).first()
    pair_discount = ((once or 0) + 0.5) / ((once or 0) + 2 * (twice or 0) + 1)
    weights = train(blocks, classes, class_prior(figures), settings)
    back_pairs = pairs.filter(F.col("block").isNotNull()).groupBy("block").agg(
        F.collect_list(F.struct("bucket", "counts", "totals", "kinds")).alias("returned_pairs"))
    back = returned.filter(F.col("block").isNotNull()).groupBy("block").agg(
        F.collect_list(F.struct("bucket", "counts")).alias("returned"))
    joined = blocks.select("block", "doc_ids", "held", "sizes", "tokens", "keys", "hashes", "words").join(back, "block", "left").join(
        back_pairs, "block", "left").withColumns({"buckets": F.lit(buckets), "pair_buckets": F.lit(pair_buckets)})
    return score_blocks(joined, classes, weights, figures, pair_discount, settings)
