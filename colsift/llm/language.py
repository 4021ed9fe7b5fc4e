"""Language identification by bit-sliced Bloom filters of character n-grams.

One Bloom filter per language, all of the same length and hash functions, are stored bit-sliced: place p of the table holds
a bit mask of the languages whose filter has bit p. The AND of an n-gram's places is then the mask of all languages that
(may) contain it. A document's n-grams give one popcount per language; each is corrected for the filter's own rate of false
positives, and the largest corrected share decides.

Nulls and texts without a letter are `und` with score 0; a text of which no language knows an n-gram gets the most frequent
learned language with score 0. Ties go to the first language in alphabetical order. Training needs a non-null language; with
no training row every text is `und`. Repeated rows are scored one by one. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from colsift.llm.texts import LETTERS, bounded_sample, explode_texts, is_fold, map_texts, narrow

UNDETERMINED = "und"
CACHE_WORDS = 150_000


@dataclass(frozen=True)
class Settings:
    """`rows_per_language` bounds the training sample. An n-gram belongs to a language if it makes up `min_rate` of that
    language's n-grams and at least `typical` of the rate of the language where it is most frequent; so a filter holds at
    most 1 / min_rate n-grams of each size."""

    rows_per_language: int = 4000
    longest: int = 4
    min_rate: float = 1e-5
    typical: float = 0.5
    places_per_gram: int = 24
    hashes: int = 4


def word_grams(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram code, index of its word) of all n-grams of 1 to `longest` UTF-16 units (4 at most), word ends included.

    A code packs the units themselves into 64 bits, so different n-grams have different codes.
    """
    units = np.frombuffer((" " + " ".join(words) + " ").encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    space = units == 32
    owner = np.cumsum(space) - 1
    codes, owners = [], []
    for n in range(1, longest + 1):
        count = len(units) - n + 1
        if count <= 0:
            break
        code, fits = units[:count].copy(), ~space[:count] if n == 1 else np.ones(count, bool)
        for k in range(1, n):
            code |= units[k:count + k] << np.uint64(16 * k)
            if k < n - 1:
                fits &= ~space[k:count + k]
        if n == 2:
            fits &= ~(space[:count] & space[1:count + 1])
        codes.append(code[fits])
        owners.append(owner[:count][fits])
    return np.concatenate(codes), np.concatenate(owners)


def gram_counts(training: DataFrame, longest: int) -> DataFrame:
    """(lang, gram, n) over all words of the training rows, pre-aggregated in the tasks."""
    def make():
        held: dict[str, dict[str, int]] = {}

        def flush():
            for lang, words in held.items():
                if not words:
                    continue
                codes, owners = word_grams(list(words), longest)
                grams, where = np.unique(codes, return_inverse=True)
                n = np.bincount(where, weights=np.fromiter(words.values(), float)[owners])
                yield {"lang": [lang] * len(grams), "gram": grams.view(np.int64), "n": n.astype(np.int64)}
                words.clear()

        def add(rows):
            for lang, text in zip(rows["lang"], rows["text"]):
                words = held.setdefault(lang, {})
                for word in LETTERS.findall((text or "").lower()):
                    words[word] = words.get(word, 0) + 1
            if sum(map(len, held.values())) > CACHE_WORDS:
                yield from flush()

        return add, flush

    counted = explode_texts(training, make, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """`masks` (places x words of 64 languages) is the bit-sliced table; `false_rate` the false positives by language."""

    languages: list[str]
    default: int
    masks: np.ndarray
    false_rate: np.ndarray
    settings: Settings

    def hits(self, words: list[str]) -> np.ndarray:
        """A row per word: how many n-grams it has, then how many of them each language contains."""
        codes, owners = word_grams(words, self.settings.longest)
        found = lookup(self.masks, codes, self.settings.hashes)
        columns = [np.bincount(owners, minlength=len(words))[:len(words)]]
        for i in range(len(self.languages)):
            has = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            columns.append(np.bincount(owners, weights=has, minlength=len(words))[:len(words)])
        return np.stack(columns, axis=1).astype(np.float32)


def places(codes: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    """The places of each n-gram: two mixed hashes, combined as h1 + i h2."""
    def mixed(x: np.ndarray, factor: int) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
        return x ^ (x >> np.uint64(29))

    first, second = mixed(codes, 0x9E3779B97F4A7C15), mixed(codes, 0xC2B2AE3D27D4EB4F) | np.uint64(1)
    return [((first + np.uint64(i) * second) >> np.uint64(13)) & np.uint64(size - 1) for i in range(hashes)]


def lookup(masks: np.ndarray, codes: np.ndarray, hashes: int) -> np.ndarray:
    """The languages that contain each n-gram, as bit masks."""
    found = None
    for place in places(codes, len(masks), hashes):
        found = masks[place] if found is None else found & masks[place]
    return found


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from (doc_id, text, lang); rows without a language are skipped.

    Only the n-grams kept by the two thresholds come to the driver: at most longest / min_rate for each language.
    """
    known = labelled.filter(F.col("lang").isNotNull())
    sample = bounded_sample(known, "lang", settings.rows_per_language)
    counts = gram_counts(sample, settings.longest)
    rates = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(rates), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("best", best).filter(
        (F.col("rate") >= settings.min_rate) & (F.col("rate") >= settings.typical * F.col("best"))).select("lang", "gram", "total")
    rows = kept.toArrow()
    langs = np.array(rows["lang"].to_pylist(), dtype=object)
    grams = rows["gram"].to_numpy().view(np.uint64)
    languages = sorted(set(langs))
    largest = max([1, *((langs == name).sum() for name in languages)])
    size = 1 << max(10, int(np.ceil(np.log2(largest * settings.places_per_gram))))
    masks = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
    for i, name in enumerate(languages):
        for place in places(grams[langs == name], size, settings.hashes):
            masks[place, i // 64] |= np.uint64(1 << (i % 64))
    filled = [((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
    totals = dict(zip(rows["lang"].to_pylist(), rows["total"].to_pylist()))
    default = max(range(len(languages)), key=lambda i: (totals[languages[i]], -i)) if languages else 0
    return Model(languages, default, masks, np.array(filled) ** settings.hashes, settings)


SCORED = "lang_pred string, score double, known_share double"


def scorer(model: Model):
    """From a list of texts to lang_pred, score and known_share. Words are looked up once and kept while they fit."""
    index: dict[str, int] = {}
    table = np.zeros((0, len(model.languages) + 1), np.float32)

    def score(texts: list[str | None]):
        nonlocal table
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not model.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if len(index) > CACHE_WORDS:
            index.clear()
            table = table[:0]
        new = list({w for words in split for w in words if w not in index})
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            table = np.concatenate([table, model.hits(new)])
        sums = np.zeros((len(texts), table.shape[1]))
        for i, words in enumerate(split):
            if words:
                sums[i] = table[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        n, hits = sums[:, :1], sums[:, 1:]
        share = np.clip((hits - n * model.false_rate) / np.maximum(n * (1 - model.false_rate), 1e-9), 0, 1)
        best = share.argmax(axis=1)
        top = share.max(axis=1)
        best[top <= 0] = model.default
        rest = share.copy()
        rest[np.arange(len(best)), best] = 0
        second = rest.max(axis=1) if rest.shape[1] > 1 else np.zeros(len(best))
        certain = np.where(top > 0, top / np.maximum(top + second, 1e-12), 0.0)
        empty = sums[:, 0] == 0
        named = [UNDETERMINED if e else model.languages[b] for e, b in zip(empty, best)]
        return named, np.where(empty, 0.0, certain), np.where(empty, 0.0, top)

    return score


def identify(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """`keep` (all columns by default) with lang_pred, score (0 to 1: the best share against the next) and known_share
    (the corrected share of the text's n-grams that the predicted language contains), their names after `prefix`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(prefix + f for f in SCORED.split(", "))
    return map_texts(docs, text_column, lambda: scorer(shared.value), schema, keep)


def in_known_language(docs: DataFrame, settings: Settings = Settings(), least_share: float = 0.3, id_column: str = "doc_id",
                      text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of `docs` whose text has a letter and of whose n-grams the predicted language knows `least_share`; all columns
    stay. Learns from the rows of `docs` as predict_languages does."""
    rows = narrow(docs, id_column, text_column, lang=F.col(f"`{lang_column}`").cast("string"),
                  held_out=is_fold(id_column, 4, 2))
    model = train(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang"), settings)
    prefix = "_llm_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = identify(docs, model, text_column, prefix=prefix)
    return found.filter((F.col(f"{prefix}lang_pred") != UNDETERMINED) & (F.col(f"{prefix}known_share") >= least_share)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def predict_languages(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text",
                      lang_column: str = "lang") -> DataFrame:
    """Learn from fold-4 remainders other than 2 and predict every text: doc_id, held_out, lang_pred, score, known_share."""
    rows = narrow(docs, id_column, text_column, lang=F.col(f"`{lang_column}`").cast("string"),
                  held_out=is_fold(id_column, 4, 2))
    model = train(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang"), settings)
    return identify(rows.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])
