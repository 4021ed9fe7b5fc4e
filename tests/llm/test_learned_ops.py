"""Toxicity, language and language-model scores: exactness of the search, held-out quality, edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from colsift.llm import language, maxent, toxicity


def held(doc_id, parts, number):
    return zlib.crc32(str(doc_id).encode()) % parts == number


def make_index(vectors, toxic, settings):
    index = toxicity.Index(settings, np.ones(30), np.array(toxic, float), np.ones(len(toxic)), [str(i) for i in range(len(toxic))], 0.3, 0.1)
    index.build(vectors)
    return index


def test_nearest_examples_are_those_of_brute_force():
    pick = np.random.default_rng(3)
    settings = toxicity.Settings(neighbours=7, block=8)
    vectors = []
    for _ in range(300):
        terms = np.sort(pick.choice(30, pick.integers(1, 8), replace=False)).tolist()
        vectors.append((terms, pick.integers(1, 5, len(terms)).tolist()))
    index = make_index(vectors, pick.integers(0, 2, 300), settings)
    dense = np.zeros((300, 30))
    for i, v in enumerate(vectors):
        ids, weights = index.unit(*v)
        dense[i, ids] = weights
    for i in range(0, 300, 7):
        near, cosine = index.nearest(*index.unit(*vectors[i]), but=i)
        want = dense @ dense[i]
        want[i] = -1
        best = np.sort(want)[::-1][:7]
        assert np.allclose(cosine, best[best > 0][:len(cosine)], atol=1e-5) and len(cosine) == min(7, (want > 1e-9).sum())
        assert np.allclose(want[near], cosine, atol=1e-5)


def test_toxicity_on_held_out_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score_toxicity(documents, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == documents.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    hits = [r for r in tested if r["toxic"] == 1 and r["predicted"]]
    assert len(hits) >= 0.6 * sum(r["toxic"] for r in tested)
    assert not [r for r in tested if r["toxic"] == 0 and r["predicted"]]
    assert all(r["neighbours"] and r["terms"] for r in hits)


def test_toxicity_does_not_learn_from_held_out_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda l: {(r["doc_id"], round(r["score"], 9)) for r in toxicity.score_toxicity(documents, l).select("doc_id", "score").collect()}
    assert score(labels) == score(flipped)


def test_toxicity_of_edge_rows(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (4, 0), (5, 1), (5, 0), (None, 1), (77, 1)], "doc_id bigint, toxic int")
    found = toxicity.score_toxicity(edge_docs, labels)
    assert found.count() == edge_docs.count() and found.filter("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.score_toxicity(edge_docs, labels.limit(0))
    assert none.count() == edge_docs.count() and none.filter("score > 0").count() == 0
    assert toxicity.score_toxicity(empty_docs, labels).count() == 0
    assert toxicity.without_toxic(edge_docs, labels).columns == edge_docs.columns


def test_language_on_held_out_documents(documents):
    rows = language.predict_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.98 * len(tested)


def test_filters_have_no_false_negatives_and_the_expected_false_positives():
    pick = np.random.default_rng(2)
    settings = language.Settings()
    masks = np.zeros((1 << 12, 2), np.uint64)
    own = {i: pick.integers(0, 2**63, 150, dtype=np.uint64) for i in range(70)}
    for i, codes in own.items():
        for place in language.places(codes, len(masks), settings.hashes):
            masks[place, i // 64] |= np.uint64(1 << (i % 64))
    has = lambda codes, i: (language.lookup(masks, codes, settings.hashes)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
    assert all(has(codes, i).all() for i, codes in own.items())
    filled = ((masks[:, 0] >> np.uint64(5)) & np.uint64(1)).mean()
    others = pick.integers(0, 2**63, 200_000, dtype=np.uint64)
    assert abs(has(others, 5).mean() - filled ** settings.hashes) < 2e-4


def test_grams_include_word_ends_and_nothing_across_words():
    codes, owners = language.word_grams(["ab", "c"], 4)
    text = lambda c: bytes(int(c).to_bytes(8, "little")).decode("utf-16-le").rstrip("\0")
    assert sorted((text(c), int(o)) for c, o in zip(codes, owners)) == sorted(
        [("a", 0), ("b", 0), ("c", 1), (" a", 0), ("ab", 0), ("b ", 0), (" c", 1), ("c ", 1), (" ab", 0), ("ab ", 0), (" c ", 1), (" ab ", 0)])


def test_language_of_edge_rows(edge_docs, empty_docs):
    found = language.predict_languages(edge_docs)
    rows = found.collect()
    assert len(rows) == edge_docs.count() and found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert by_id[7]["lang_pred"] != "und" and by_id[4]["lang_pred"] == "en"
    assert language.predict_languages(empty_docs).count() == 0
    untaught = language.predict_languages(edge_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
    kept = language.in_known_language(edge_docs)
    assert kept.columns == edge_docs.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6}


def brute_base(texts):
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for i, t in texts.items()}
    counts = Counter(w for i, words in tokens.items() if not held(i, 10, 0) for w in words)
    total, distinct = sum(counts.values()), len(counts)
    return {i: (len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w))
            for i, w in tokens.items()}


def test_base_scores_and_counts_are_exact(documents, texts):
    want = brute_base(texts)
    # small units, so that many blocks and buckets meet
    rows = maxent.score_documents(documents, maxent.Settings(block_bytes=1 << 17, bucket_words=4000)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(r["doc_id"], 10, 0))
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested) and all(r["score"] < 0 for r in rows)


def test_probabilities_sum_to_one():
    settings = maxent.Settings(classes=8)
    pick = np.random.default_rng(1)
    weights = pick.normal(size=(sum(settings.sizes), 8)).astype(np.float32)
    tokens, sizes = pick.integers(0, 50, 200).astype(np.uint32), np.array([60, 1, 139])
    classes, hashes = pick.integers(0, 8, 50).astype(np.uint8), pick.integers(0, 2**32, 50).astype(np.uint32)
    _, rows = maxent.histories(tokens, sizes, classes, hashes, settings)
    line = maxent.chances(weights, rows, np.zeros(8, np.float32))
    assert (line > 0).all() and np.allclose(line.sum(axis=1), 1, atol=1e-5)
    # a text's first token knows nothing of the text before it
    assert all(r[60] == r[61] == r[0] for r in rows)


def test_orders_and_numbers_are_those_of_numpy():
    pick = np.random.default_rng(3)
    for top, n in ((1 << 63, 5000), (1 << 48, 5000), (7, 5000), (1, 3), (5, 1), (5, 0)):
        for kind in (np.uint64, np.uint32):
            values = (pick.integers(0, top, n, dtype=np.uint64) & np.uint64(np.iinfo(kind).max)).astype(kind)
            values[::3] = values[:1]  # many copies
            values[1::3] ^= kind(1)  # and numbers that differ in the lowest bit
            assert (maxent.stable_order(values) == np.argsort(values, kind="stable")).all()
            want, found = np.unique(values, return_inverse=True), maxent.distinct(values)
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(want, found))


def test_words_are_cut_at_ascii_white_space_only():
    texts = [None, "", " ", "Ab  c\t\x0bD\r\n", "a\xa0b\u2003c\x1cd\x85e\x08f\x0eg\x00h \u00c4\u00c9Z", "end", "\n\x0c", "end \U0001f600 x"]
    words, sizes = maxent.lowered_words(texts)
    want = [(t or "").encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for found in want for w in found] and sizes.tolist() == [len(w) for w in want]


def test_row_sums_of_all_features_at_once():
    """Each sum to the bit what numpy adds up for the row alone."""
    pick = np.random.default_rng(4)
    slope = pick.normal(size=(2048, 6)).astype(np.float32)
    rows = [(np.minimum(pick.zipf(1.4, 2048), 500) + 1000 * k).astype(np.uint16) for k in range(3)]
    own, n, total = maxent.row_sums(slope, np.concatenate(rows))
    assert len(own) == sum(len(np.unique(r)) for r in rows)
    for r, k, line in zip(own, n, total):
        at = np.flatnonzero(rows[r // 1000] == r)
        assert len(at) == k and (line == np.add.reduceat(slope[at], [0], axis=0)[0]).all()


def test_training_learns_an_order():
    settings = maxent.Settings(classes=6, batch=64)
    tokens = np.array([1, 2, 3, 4, 5] * 400, np.uint32)
    classes, hashes = np.array([0, 1, 2, 3, 4, 5], np.uint8), np.arange(6, dtype=np.uint32) * 977
    learner = maxent.Learner(np.zeros((sum(settings.sizes), 6), np.float32), np.zeros(6, np.float32), settings)
    c, rows = maxent.histories(tokens, np.array([len(tokens)]), classes, hashes, settings)
    learner.learn(c, rows)
    line = maxent.chances(learner.weights, rows, learner.prior)
    assert line[np.arange(len(c)), c][100:].mean() > 0.8


def test_words_of_one_class_depend_on_the_history(spark):
    """Words of one shape, hence one class, met equally often, each after a word of its own and after another one before that."""
    learned = [i for i in range(400) if not held(i, 10, 0)]
    tested = [i for i in range(400, 600) if held(i, 10, 0)][:5]
    rows = [(i, "red one balling" if i % 2 else "blue two calling") for i in learned]
    rows += list(zip(tested, ("red one balling", "red one calling", "blue six calling", "blue six balling", "new new balling")))
    found = {r["doc_id"]: r["score"] for r in maxent.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near, far, skip, not_skip, _ = (found[i] for i in tested)
    assert near > far + 1 and skip > not_skip + 1


def test_word_chances_of_a_history_sum_to_one():
    pick = np.random.default_rng(5)
    start = pick.dirichlet(np.ones(12))  # the last is the unknown word
    counts = [np.r_[pick.integers(0, 4, 11), 0].astype(float) for _ in range(2)]
    for n in counts:
        start = maxent.with_context(start, n, np.full(12, n.sum()), np.full(12, (n > 0).sum()), 0.7)
        assert abs(start.sum() - 1) < 1e-12 and (start > 0).all()
    same = maxent.with_context(start, np.zeros(12), np.zeros(12), np.zeros(12), 0.7)
    assert (same == start).all()


def test_context_counts_are_those_of_brute_force(spark):
    """Over many blocks and buckets."""
    pick = np.random.default_rng(6)
    texts = [" ".join(f"w{n}" for n in pick.zipf(1.5, 30) % 50) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("held_out", F.col("doc_id") % 5 == 0)
    settings = maxent.Settings(block_bytes=500)
    blocks = maxent.encode(docs, settings).withColumn("block", F.monotonically_increasing_id()).cache()
    classes = (np.arange(settings.keys + 1) % 7).astype(np.uint8)
    got = {(r["block"], r["bucket"]): r for r in maxent.count_pairs(maxent.deal_pairs(blocks, classes, 5)).filter("block is not null").collect()}
    class_of = lambda w: classes[maxent.shape_key(w.encode(), settings.keys) if w else settings.keys]
    want = Counter()
    for i, text in enumerate(texts):
        if i % 5:
            line = ["", "", *text.split(), ""]
            want.update((k, line[j - k], w) for j, w in enumerate(line) if j > 1 for k in (1, 2))
    totals, kinds = Counter(), Counter()
    for (k, before, w), n in want.items():
        totals[k, before, class_of(w)] += n
        kinds[k, before, class_of(w)] += 1
    for b in blocks.collect():
        own = maxent.unpacked(b["words"]).split()
        tokens, sizes = maxent.unpacked(b["tokens"], np.uint32), np.array(b["sizes"])
        pairs = maxent.Pairs(tokens, sizes, classes[maxent.unpacked(b["keys"], np.uint16)], own, 5)
        back = [got[b["block"], k] for k in range(5) if (b["block"], k) in got]
        n, t, d = (np.concatenate([maxent.unpacked(r[name], np.uint64) for r in back]) for name in ("counts", "totals", "kinds"))
        t, d = np.repeat(t, pairs.runs), np.repeat(d, pairs.runs)
        at = 0
        for i in b["doc_ids"]:
            line = ["", "", *texts[i].split(), ""]
            for j, w in enumerate(line[2:], 2):
                for k in (1, 2):
                    p = pairs.of[k - 1][at]
                    key = k, line[j - k], class_of(w)
                    assert (n[p], t[p], d[p]) == (want[k, line[j - k], w], totals[key], kinds[key])
                at += 1


def test_keys_beside_the_same_neighbours_share_a_class():
    settings = maxent.Settings(classes=4, keys=6, dimensions=3)
    # keys 0, 1, 2 stand among themselves, and so do 3, 4 and 5; key 6 is the end's
    counts = np.zeros((7, 7))
    counts[:3, :3] = counts[3:6, 3:6] = 100
    counts[6, :6] = counts[:6, 6] = 3
    classes = maxent.key_classes(counts, settings)
    assert classes[6] == 0 and min(classes[:6]) >= 1
    assert not set(classes[:3]) & set(classes[3:6])


def test_language_model_of_edge_rows(edge_docs, empty_docs):
    found = maxent.score_documents(edge_docs)
    rows = found.collect()
    assert len(rows) == edge_docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert maxent.score_documents(empty_docs).count() == 0
    untaught = maxent.score_documents(edge_docs.filter("doc_id is null")).collect()
    assert untaught[0]["train_tokens"] == 0 and untaught[0]["held_out"] and math.isfinite(untaught[0]["score"])


def test_numbers_are_no_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the words of a text", "½ ² ① Ⅷ", "x²", "漢"])]
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert found[1] == "und" and found[2] != "und" and found[3] != "und"


def test_sums_of_feature_rows_are_numpys_own():
    """To the bit, with rows met once, a few times and often."""
    pick = np.random.default_rng(8)
    for n in (1, 2, 7, 400):
        rows, slope = (pick.zipf(1.4, n) % 60).astype(np.uint16), pick.normal(size=(n, 5)).astype(np.float32)
        order = np.argsort(rows, kind="stable")
        own, first = np.unique(rows[order], return_index=True)
        got = maxent.row_sums(slope, rows)
        assert (got[0] == own).all() and (got[1] == np.bincount(rows)[own]).all()
        assert (got[2] == np.add.reduceat(slope[order], first, axis=0)).all()


def test_shape_keys_are_those_of_single_words():
    words = [b"a", b"ab", b"\x00ab", b"ab\x00", b"abc", b"Abc", b"xbc", "\u00fcber".encode(), "\u00e9".encode(), b"7", b"17", b"-17", b"walking", b"talking"]
    assert maxent.shape_keys(words, 1024).tolist() == [maxent.shape_key(w, 1024) for w in words]
    assert len(maxent.shape_keys([], 1024)) == 0


def test_small_numbers_are_packed_by_their_bytes():
    numbers = (np.random.default_rng(9).zipf(1.5, 20000) % 50000).astype(np.uint64)
    for kind in (np.uint64, np.uint32, np.uint16, np.float32):
        values = numbers.astype(kind)
        assert (maxent.unpacked(maxent.packed(values), kind) == values).all()
        assert len(maxent.unpacked(maxent.packed(values[:0]), kind)) == 0
    assert maxent.unpacked(maxent.packed(b"a b")) == b"a b"
    import zstandard
    assert len(maxent.packed(numbers)) < 0.9 * len(zstandard.ZstdCompressor(level=3).compress(numbers.tobytes()))
