"""Resampling, conversation tries and suffix removal against brute force; edge rows of each."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsift.llm import resample, suffixes, tries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_buckets(text, buckets):
    words = WORD.findall((text or "").encode().lower())
    features = words + [a + b" " + b for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f) % buckets for f in features]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 7])
def test_buckets_of_features(monkeypatch, slice_bytes):
    monkeypatch.setattr(resample, "SLICE_BYTES", slice_bytes)
    texts = ["One two, ONE two three", None, "", "...", "x" * 700 + " y", "Größe größe 漢字 \U0001f600 a-b_c", "end", " lead and trail "]
    words, buckets = resample.buckets_of_texts(texts, 997)
    for text, n, found in zip(texts, words, buckets):
        want_n, want = brute_buckets(text, 997)
        assert n == want_n and collections.Counter(np.frombuffer(found, "<u2").tolist()) == collections.Counter(want)
    assert resample.buckets_of_texts([], 10) == ([], [])


def test_crc_of_matrices():
    features = [b"", b"a", b"ab", b"ba", "ü".encode(), b"z" * 256, b"z" * 257, bytes(range(256))]
    assert resample.crcs(pa.array(features, pa.binary())).tolist() == [zlib.crc32(f) for f in features]


def test_resampling_of_edge_rows(edge_docs, empty_docs, spark):
    target = spark.createDataFrame([(1, "the same text twice"), (2, None)], "item_id bigint, text string")
    settings = resample.Settings(least_words=3, percent=50)
    rows = resample.resample(edge_docs, target, settings).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all((by_id[i]["n_features"], by_id[i]["weight"], by_id[i]["rank"]) == (0, 0, None) for i in (1, 2, 3))
    assert by_id[None]["score"] is None and by_id[None]["rank"] is None
    may = sorted((r for r in rows if r["n_words"] >= 3 and r["doc_id"] is not None), key=lambda r: (-r["score"], r["doc_id"]))
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(may) // 2 + 1))
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(r["score"], r["doc_id"]) for r in may[:len(drawn)]]
    assert resample.resample(empty_docs, target).count() == 0
    assert resample.resample(edge_docs, target.limit(0), settings).count() == len(rows)
    kept = resample.resampled(edge_docs, target, settings)
    assert kept.columns == edge_docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in drawn}


def test_ranks_over_many_partitions_and_equal_rows(spark):
    scores = [(i % 7 if i % 3 else None, i % 11, 5) for i in range(600)] + [(3, 3, 5)] * 300
    frame = spark.createDataFrame(scores, "score bigint, doc_id bigint, n_features bigint").filter("score IS NOT NULL")
    rows = resample.ranked(frame).orderBy("rank").collect()
    want = sorted(((-s, d) for s, d, _ in scores if s is not None))
    assert [r["rank"] for r in rows] == list(range(1, len(want) + 1)) and [(-r["score"], r["doc_id"]) for r in rows] == want


def brute_trie(conversations):
    """Nodes by path from id -> list of (role, text)."""
    members = collections.defaultdict(list)
    for i, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(i)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, m in members.items():
        ends = ",".join(str(i) for i in sorted(m) if len(conversations[i]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations_of(pick, n, turns, words):
    made = {}
    for i in range(n):
        base = list(made[pick.randrange(i)]) if i and pick.random() < 0.7 else []
        base = base[:pick.randint(0, len(base))]
        made[i * 3 - 5] = base
        made[i] = base + [(pick.choice("ua"), "x" * pick.randint(0, words)) for _ in range(pick.randint(0, turns))]
    return {i: t for i, t in made.items() if t}


@pytest.mark.parametrize("task_nodes, n, turns, words", [(100_000, 60, 5, 3), (7, 60, 5, 3), (20, 4, 120, 1)])
def test_trie_against_brute_force(spark, task_nodes, n, turns, words):
    conversations = conversations_of(random.Random(n + turns), n, turns, words)
    rows = [(i, k, role, text, "x") for i, said in conversations.items() for k, (role, text) in enumerate(said)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, node string")
    nodes = tries.conversation_trie(table, task_nodes)
    got = sorted((tuple(r[c] for c in NODE) for r in nodes.collect()), key=str)
    assert got == brute_trie(conversations)
    said = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in nodes.collect()}
    assert all(said[i, d] == (conversations[i][d - 1] if d else (None, None)) for i, d in said)


def test_trie_of_edge_rows(spark):
    schema = "conv_id bigint, turn int, role string, text string"
    rows = [(1, None, "u", "first"), (1, 0, None, "second"), (2, None, "u", "first"), (2, 5, "", None), (2, 5, "", None), (None, 1, "u", "lost"),
            (-7, 1, "u", "first"), (-7, 2, "", "second"), (9, 0, "b", "x"), (9, 0, "a", "y")]
    got = sorted((tuple(r[c] for c in NODE) for r in tries.conversation_trie(spark.createDataFrame(rows, schema)).collect()), key=str)
    first = ("u", "first")
    assert got == brute_trie({1: [first, ("", "second")], 2: [first, ("", ""), ("", "")], -7: [first, ("", "second")], 9: [("a", "y"), ("b", "x")]})
    assert tries.conversation_trie(spark.createDataFrame([], schema)).count() == 0


def test_ids_of_a_node_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK_IDS", 7)
    rows = [(bytes([i % 3]) if i % 2 else b"hot", i * 17 % 1009 - 90) for i in range(1000)]
    ends = spark.createDataFrame(rows, "node binary, conv_id bigint").repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = {bytes(r["node"]): r["ends_sha256"] for r in tries.ends_digest(ends).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {n: hashlib.sha256(",".join(map(str, sorted(i for m, i in rows if m == n))).encode()).hexdigest() for n, _ in rows}
    assert got == want


def test_decomposition_of_random_forests():
    pick = np.random.default_rng(4)
    for shape in ("bushy", "chain", "star", "mixed"):
        top, parent = [], []
        for i in range(700):
            new = i == 0 or pick.random() < 0.01
            p = {"bushy": lambda: pick.integers(0, i), "chain": lambda: i - 1, "star": lambda: top[-1], "mixed": lambda: max(0, i - pick.integers(1, 4))}[shape]
            parent.append(-1 if new else int(p()))
            top.append(i if new else top[parent[-1]])
        order = np.argsort(np.array(top), kind="stable")
        where = np.empty(700, np.int64)
        where[order] = np.arange(700)
        top = where[np.array(top)[order]]
        parent = np.array([-1 if parent[i] < 0 else where[parent[i]] for i in order])
        weights = pick.integers(0, 100, (700, 2))
        size, want = np.ones(700, np.int64), weights.copy()
        for i in range(699, -1, -1):
            if parent[i] >= 0:
                size[parent[i]] += size[i]
                want[parent[i]] += want[i]
        assert (tries.decompose(top, parent, size, weights) == want).all()


def brute_repeats(texts, n):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.defaultdict(list)
    for i, d in enumerate(data):
        for p in range(len(d) - n + 1):
            seen[d[p:p + n]].append((i, p))
    marks = [bytearray(len(d)) for d in data]
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            marks[i][p:p + n] = b"\1" * n
    return [(len(d), sum(m), len(re.findall(b"\1+", bytes(m))), bytes(b for b, x in zip(d, m) if not x)) for d, m in zip(data, marks)]


def planted_texts(seed, count, size):
    """Texts of few letters that share passages, some changed by a letter, some twice in one text."""
    pick = random.Random(seed)
    letters = lambda k: "".join(pick.choice("abcdé ") for _ in range(k))
    passages = [letters(pick.randint(size // 2, size * 2)) for _ in range(5)]
    texts = []
    for _ in range(count):
        text = letters(pick.randint(0, size))
        for _ in range(pick.randint(0, 3)):
            passage = pick.choice(passages)
            if pick.random() < 0.5:
                k = pick.randrange(len(passage))
                passage = passage[:k] + "Z" + passage[k + 1:]
            text += passage[pick.randint(0, 20):] + letters(pick.randint(0, 30))
        texts.append(text)
    return texts + [texts[0], texts[0], None, "", "ab" * size, "a" * (2 * size), "a" * (2 * size)]


@pytest.mark.parametrize("settings", [suffixes.Settings(40, 10, 2000, 1), suffixes.Settings(40, 10, 2, 4), suffixes.Settings(40, 40, 5, 2), suffixes.Settings(41, 3, 4, 5)])
def test_repeats_against_brute_force(spark, settings):
    texts = planted_texts(settings.length + settings.batches, 90, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in suffixes.without_repeats(docs, settings).collect()}
    for i, want in enumerate(brute_repeats(texts, settings.length)):
        r = got[i]
        assert (r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) == want, i


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BITS", 9)
    suffixes._rolling.cache_clear()
    settings = suffixes.Settings(40, 10, 3, 2)
    texts = ["".join(planted_texts(s, 25, 70)[:25]) for s in (1, 1, 2)] + planted_texts(3, 20, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made, add = [], suffixes.spans
    rows = [(k, t) for k, t in enumerate(texts)]
    # blocks are cut where the task runs, so the function is called here as a task would call it
    frame = docs.select(F.col("doc_id").cast("string").cast("binary").alias("key"), "text")
    pieces = []
    monkeypatch.setattr(suffixes, "explode_texts", lambda d, make, schema: pieces.append(make) or d)
    add(frame, settings)
    run, _ = pieces[0]()
    for part in run({"key": [str(k).encode() for k, _ in rows], "text": [t for _, t in rows]}):
        made += list(zip(part["key"], part["at"].tolist(), part["first"].tolist(), part["last"].tolist()))
    suffixes._rolling.cache_clear()
    for k, t in rows:
        covered = sorted((f, l) for key, _, f, l in made if key == str(k).encode())
        windows = [w for f, l in covered for w in range(f, l + 1)]
        assert windows == list(range(max(0, len((t or "").encode()) - 40 + 1))), k
    assert all(f <= a <= l + 30 for _, a, f, l in made)


def test_reach_of_matches():
    pick = random.Random(5)
    for _ in range(60):
        entries = sorted({("".join(pick.choice("ab") for _ in range(pick.randint(0, 4))).encode(), "".join(pick.choice("ab") for _ in range(pick.randint(1, 7))).encode())
                          for _ in range(pick.randint(2, 25))}, key=lambda e: e[1])
        left, suffix = [e[0] for e in entries], [e[1] for e in entries]
        want = []
        for i in range(len(entries)):
            hits = [(x, y) for j in range(len(entries)) if j != i
                    if (x := suffixes.common_prefix(left[i], left[j])) + (y := suffixes.common_prefix(suffix[i], suffix[j])) >= 5]
            want.append((max(h[0] for h in hits), max(h[1] for h in hits)) if hits else None)
        got = suffixes.longest_matches(left, suffix, 5)
        assert got == want


def test_repeats_of_edge_rows(edge_docs, empty_docs):
    rows = suffixes.without_repeats(edge_docs, suffixes.Settings(12, 5, 3, 2)).collect()
    assert len(rows) == edge_docs.count()
    assert all((r["n_bytes"], r["spans"], bytes(r["kept"])) == (0, [], b"") for r in rows if r["doc_id"] in (1, 2))
    assert {bytes(r["kept"]) for r in rows if r["doc_id"] in (5, 6)} == {b""}
    assert suffixes.without_repeats(empty_docs).count() == 0
