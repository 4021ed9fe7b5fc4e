"""Token counts, packing and fertility against the tokenizer libraries and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colsift.llm import fertility, packing, token_counts
from colsift.llm.texts import tokenizer

VOCABULARY = "byte_bpe_50k.json"
ALPHABET = ["a", "b", " ", "\n", "\t", "  ", "'s", "é", "漢", "\U0001f600", "<|endoftext|>", "1", ".", "\r", "\x0b", "\x85", "\xa0",
            "\x1c", "the", "́", "٣", "²", "aaaa", "​", "<|endof", " "]


def odd_texts(n=3000):
    pick = random.Random(5)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 50))) for _ in range(n)]


def library_ids(texts):
    return [e.ids for e in tokenizer(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_library_s_on_odd_texts():
    texts = [*odd_texts(), "", "a" * 5000, " " * 999, "漢字" * 2000, "<|endoftext|>" * 3]
    assert token_counts.Counter(VOCABULARY)(texts)[1] == [len(i) for i in library_ids(texts)]


def test_overlapping_pairs_merge_from_the_left():
    merges = token_counts.merges(VOCABULARY)
    words = ["a" * n for n in range(1, 60)]
    assert merges.count([w.encode() for w in words]).tolist() == [len(i) for i in library_ids(words)]


def test_ids_are_the_library_s_on_odd_and_long_texts():
    texts = [*odd_texts(), "", "ab " * 90_000]
    ids = packing.ids_of_worker(VOCABULARY)
    assert [ids(t) for t in texts] == [np.array(i, "<u4").tobytes() for i in library_ids(texts)]


def test_token_counts_of_the_table(documents, texts):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(documents).collect()}
    want = dict(zip(texts, map(len, library_ids(list(texts.values())))))
    assert {i: r["n_tokens"] for i, r in got.items()} == want
    assert all(r["n_bytes"] == len(texts[i].encode()) and r["over_limit"] == (r["n_tokens"] > 1024) for i, r in got.items())


def test_token_counts_of_edge_rows(edge_docs, empty_docs):
    found = token_counts.count_tokens(edge_docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and found.count() == edge_docs.count()
    assert {(r["doc_id"], r["n_tokens"]) for r in found.collect()} >= {(1, 0), (2, 0)}
    assert token_counts.count_tokens(empty_docs).count() == 0


def check_packing(rows, texts, limit):
    """Pieces are the library's ids, cut as agreed; sequences are gapless and within the limit."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, ids in zip(texts, library_ids([t or "" for t in texts.values()])):
        ids = np.array([*ids, 0], "<u4")
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        first = (len(ids) - 1) % limit + 1
        want = [(0, first), *((s, limit) for s in range(first, len(ids), limit))]
        assert [(r["start"], r["length"]) for r in pieces] == want
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in pieces)
    assert not by_doc
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= limit
    return len(by_sequence)


def test_packing_of_the_table(documents, texts):
    rows = packing.pack(documents, cell=50).collect()
    used = check_packing(rows, texts, 2048)
    assert used <= 1.01 * -(-sum(r["length"] for r in rows) // 2048)


def test_packing_of_edge_rows(edge_docs, empty_docs):
    one_each = edge_docs.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in one_each.collect()}
    check_packing(packing.pack(one_each, limit=64, cell=2).collect(), texts, 64)
    assert packing.pack(edge_docs).filter("piece = 0").count() == edge_docs.count()
    assert packing.pack(empty_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    pick = np.random.default_rng(seed)
    limit = 128
    counts = np.bincount(pick.integers(1, limit + 1, 3000 * seed + 5), minlength=limit + 1)
    patterns = packing.plan(counts)
    used = np.zeros_like(counts)
    for pattern, n in patterns:
        assert n > 0 and sum(pattern) <= limit
        for length in pattern:
            used[length] += n
    assert (used == counts).all()
    assert sum(n for _, n in patterns) <= 1.02 * (counts @ np.arange(limit + 1)) / limit + 3


def test_fitted_patterns_come_near_the_histogram():
    limit = 64
    wanted = {(40, 24): 500, (30, 20, 14): 300, (32, 32): 80}
    counts = np.zeros(limit + 1, int)
    for pattern, n in wanted.items():
        for length in pattern:
            counts[length] += n
    left = counts.astype(float)
    for pattern, x in packing.fitted_patterns(counts):
        assert sum(pattern) == limit and x > 0
        for length in pattern:
            left[length] -= x
    assert np.abs(left).sum() < 0.02 * counts.sum()


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if times[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again),
            n < 50 or 100 * len(again) > 50 * n)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_rules_of_the_table(documents, texts):
    rows = fertility.judge(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in BASE) == brute_base(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in rows) > 0.9 * sum(not r["base_failed"] for r in rows)


def test_measures_are_the_library_s(documents, texts):
    from colsift.llm.texts import pieces_model
    model = pieces_model("piece_bpe_32k.model")
    for r in fertility.judge(documents).limit(50).collect():
        words = texts[r["doc_id"]].encode().split()
        ids = [i for w in words for i in model.encode(w.decode())]
        p = np.array(list(Counter(ids).values())) / len(ids)
        assert r["chars_per_token"] == pytest.approx(sum(len(w.decode()) for w in words) / len(ids), abs=1e-3)
        assert r["token_entropy"] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-3)


def test_fertility_rejects_what_the_vocabulary_does_not_know(spark, documents):
    odd = spark.createDataFrame([(90001, " ".join(["ᚠᚢᚦ" + chr(0x16a0 + i % 70) + chr(0x16a0 + i // 7) for i in range(300)]), "en")], "doc_id bigint, text string, lang string")
    verdict = fertility.judge(documents.select("doc_id", "text", "lang").unionByName(odd)).filter("doc_id = 90001").first()
    assert not verdict["base_failed"] and not verdict["kept"] and "byte_share" in verdict["reasons"]


def test_fertility_of_edge_rows(edge_docs, empty_docs):
    found = {r["doc_id"]: r for r in fertility.judge(edge_docs).collect()}
    assert fertility.judge(edge_docs).count() == edge_docs.count()
    assert found[1]["n_words"] == 0 and found[1]["base_failed"] and found[1]["chars_per_token"] is None
    assert found[6]["band_group"] == "script latin"
    assert fertility.judge(empty_docs).count() == 0
