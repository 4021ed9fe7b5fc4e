"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Terms are character n-grams of words (ends marked), each at up to three levels: met at all, twice, three times or more. Kept
are those whose log odds between toxic and other training documents differ for certain. Document frequencies are counted over all documents. A bounded sample of labelled documents is indexed: a term's
postings are cut into blocks of examples, and each block keeps the term's largest weight. A query sums these maxima to an
upper bound per block, scores the most promising blocks, and then only the blocks that can still hold one of the k nearest;
so the neighbours are exact. They vote with weight 1 / (distance + softening); an isotonic fit on the votes that the examples
get from each other turns votes into probabilities. The nearest examples and the terms met are the evidence.

Null and empty texts, and others without a term, score the share of toxic documents among training documents without a term.
Conflicting labels of one id count as toxic. Without labelled rows every score is 0. Repeated rows are scored one by one.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from colsift.llm.texts import bounded_sample, explode_texts, free_name, is_fold, map_texts, narrow
from colsift.plans.session import cut_lineage

WORDS = re.compile(r"\w+")
CACHE_WORDS = 200_000
LEVEL = ["", " 2", " 3", " 4", " 5"]  # what marks a term's level


@dataclass(frozen=True)
class Settings:
    """`terms` and `examples_per_class` bound the index, `learn_per_class` the labelled ids that terms are chosen from. A term is kept where its log odds ratio, less `sureness` standard
    errors, is at least log(`odds`) either way."""

    gram: int = 5
    levels: int = 3
    terms: int = 4000
    odds: float = 4.0
    sureness: float = 2.5
    learn_per_class: int = 20000
    examples_per_class: int = 2000
    neighbours: int = 15
    softening: float = 0.05
    prior_votes: float = 0.5
    block: int = 64


def grams_of(word: str, n: int) -> tuple[str, ...]:
    """The n-grams of a word with its ends marked; a shorter one is a gram itself."""
    marked = f"^{word}$"
    return tuple({marked[i:i + n] for i in range(max(1, len(marked) - n + 1))})


class WordCache(dict):
    """Remembers what `find` gives for a word."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str):
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self.find(word)
        if len(word) <= 64:
            self[word] = found
        return found


def choose_terms(training: DataFrame, settings: Settings) -> list[str]:
    """The terms, most telling first, from (text, toxic); at most `settings.terms` of them reach the driver."""
    def make():
        grams = WordCache(lambda w: grams_of(w, settings.gram))
        n, toxic = Counter(), Counter()

        def flush():
            if n:
                yield {"term": list(n), "n": list(n.values()), "toxic": [toxic[t] for t in n]}
                n.clear()
                toxic.clear()

        def add(rows):
            for text, label in zip(rows["text"], rows["toxic"]):
                times = Counter(chain.from_iterable(map(grams.__getitem__, WORDS.findall((text or "").lower()))))
                met = [t + LEVEL[k] for t, m in times.items() for k in range(min(m, settings.levels))]
                n.update(met)
                if label:
                    toxic.update(met)
            if len(n) > 2 * CACHE_WORDS:
                yield from flush()

        return add, flush

    sizes = {r[0]: r[1] for r in training.groupBy("toxic").count().collect()}
    all_toxic, others = sizes.get(1, 0), sizes.get(0, 0)
    counts = explode_texts(training.select("text", "toxic"), make, "term string, n bigint, toxic bigint").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    a, c = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    b, d = all_toxic + 1 - a, others + 1 - c
    sure = F.abs(F.log(a * d / (b * c))) - settings.sureness * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = counts.withColumn("sure", sure).filter(F.col("sure") >= float(np.log(settings.odds))).orderBy(
        F.desc("sure"), "term").limit(settings.terms)
    return [r[0] for r in best.select("term").collect()]


def term_counts(docs: DataFrame, terms: list[str], settings: Settings) -> DataFrame:
    """`docs` without its text, with the terms of each text as arrays `term` and `times`."""
    places: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        gram, _, level = term.partition(" ")
        places.setdefault(gram, [-1] * settings.levels)[int(level or 1) - 1] = i
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def make():
        places = shared.value
        known = WordCache(lambda w: tuple(g for g in grams_of(w, settings.gram) if g in places))

        def run(texts):
            ids, times = [], []
            for text in texts:
                met = Counter(chain.from_iterable(filter(None, map(known.__getitem__, WORDS.findall((text or "").lower())))))
                found = sorted((i, n - k) for g, n in met.items() for k, i in enumerate(places[g][:n]) if i >= 0)
                ids.append([i for i, _ in found])
                times.append([n for _, n in found])
            return ids, times

        return run

    return map_texts(docs, "text", make, "term array<int>, times array<int>", [c for c in docs.columns if c != "text"])


@dataclass
class Index:
    """The block-max index of the examples and the calibration of their votes."""

    settings: Settings
    idf: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    names: list[str]
    base: float
    no_term: float
    pointers: np.ndarray = field(default=None)  # (terms, blocks + 1): where a term's postings of a block start
    maxima: np.ndarray = field(default=None)  # (terms, blocks): the largest weight there
    posted: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    votes: np.ndarray = field(default=None)
    chances: np.ndarray = field(default=None)

    def unit(self, terms, times) -> tuple[np.ndarray, np.ndarray]:
        """Term ids and TF-IDF weights of length 1."""
        ids = np.asarray(terms, np.int64)
        raw = (1 + np.log(np.asarray(times, float))) * self.idf[ids]
        return ids, (raw / np.sqrt((raw * raw).sum())).astype(np.float32)

    def build(self, vectors: list[tuple[list[int], list[int]]]) -> None:
        """Postings and block maxima."""
        units = [self.unit(*v) for v in vectors]
        terms = np.concatenate([u[0] for u in units]) if units else np.zeros(0, np.int64)
        values = np.concatenate([u[1] for u in units]) if units else np.zeros(0, np.float32)
        example = np.repeat(np.arange(len(units)), [len(u[0]) for u in units])
        blocks = max(1, -(-len(units) // self.settings.block))
        cell = terms * blocks + example // self.settings.block
        order = np.argsort(cell, kind="stable")
        self.posted, self.values = example[order], values[order]
        starts = np.searchsorted(cell[order], np.arange(len(self.idf) * blocks + 1))
        self.pointers = np.stack([starts[:-1], starts[1:]], axis=-1).reshape(len(self.idf), blocks, 2)
        self.maxima = np.zeros(len(self.idf) * blocks, np.float32)
        np.maximum.at(self.maxima, cell, values)
        self.maxima = self.maxima.reshape(len(self.idf), blocks)

    def scores(self, ids: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The examples of these blocks that share a term, and their cosine."""
        spans = self.pointers[ids[:, None], blocks[None, :]].reshape(-1, 2)
        sizes = spans[:, 1] - spans[:, 0]
        at = np.repeat(spans[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        sums = np.bincount(self.posted[at], self.values[at] * np.repeat(np.repeat(weights, len(blocks)), sizes),
                           minlength=len(self.toxic))
        met = np.flatnonzero(sums)
        return met, sums[met]

    def nearest(self, ids: np.ndarray, weights: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0 (ties: first in the index), `but` left out."""
        k = self.settings.neighbours + (but >= 0)
        bound = weights @ self.maxima[ids]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        first, rest = order[:3], order[3:]
        met, sums = self.scores(ids, weights, first)
        if len(rest):
            least = np.partition(sums, -k)[-k] if len(sums) >= k else 0.0
            open_blocks = rest[bound[rest] >= least - 1e-6]
            if len(open_blocks):
                more, more_sums = self.scores(ids, weights, open_blocks)
                met, sums = np.concatenate([met, more]), np.concatenate([sums, more_sums])
        if but >= 0:
            met, sums = met[met != but], sums[met != but]
        best = np.lexsort((met, -sums))[:self.settings.neighbours]
        return met[best], sums[best]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        s = self.settings
        w = self.weight[near] / (np.maximum(0, 1 - cosine) + s.softening)
        return float(((w * self.toxic[near]).sum() + s.prior_votes * self.base) / (w.sum() + s.prior_votes))

    def calibrate(self, vectors: list[tuple[list[int], list[int]]]) -> None:
        """Isotonic fit of the examples' labels on the votes of the other examples, by pooling adjacent violators."""
        votes = np.array([self.vote(*self.nearest(*self.unit(*v), but=i)) for i, v in enumerate(vectors)])
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # weight, toxic weight, vote x weight
        for i in order:
            pools.append([self.weight[i], self.weight[i] * self.toxic[i], votes[i] * self.weight[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last)]
        if pools:
            table = np.array(pools)
            self.votes = table[:, 2] / table[:, 0]
            self.chances = (table[:, 1] + self.base) / (table[:, 0] + 1)

    def score(self, terms: list[int], times: list[int]) -> tuple[float, list[str], float]:
        """Score, nearest examples and the largest cosine of one document."""
        if not len(terms) or not len(self.toxic):
            return self.no_term, [], 0.0
        near, cosine = self.nearest(*self.unit(terms, times))
        if not len(near):
            return self.no_term, [], 0.0
        chance = float(np.interp(self.vote(near, cosine), self.votes, self.chances))
        return chance, [self.names[i] for i in near[:3]], float(min(1.0, cosine[0]))


def build_index(vectors: DataFrame, n_terms: int, settings: Settings) -> Index:
    """An index from (doc_id, toxic, learn, term, times). `toxic` is NULL where a row has no label or is held out.

    To the driver come the frequency of each term and at most 2 x examples_per_class example vectors.
    """
    total = vectors.count()
    frequency = np.zeros(n_terms)
    for term, n in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():
        frequency[term] = n
    labelled = vectors.filter(F.col("toxic").isNotNull())
    sizes = {(r[0], r[1]): r[2] for r in labelled.groupBy("toxic", F.size("term") > 0).count().collect()}
    met = {label: sizes.get((label, True), 0) for label in (0, 1)}
    none = {label: sizes.get((label, False), 0) for label in (0, 1)}
    n_labelled = sum(met.values()) + sum(none.values())
    base = (met[1] + none[1]) / n_labelled if n_labelled else 0.0
    sample = bounded_sample(labelled.filter(F.size("term") > 0), "toxic", settings.examples_per_class, "term").select(
        F.col("doc_id").cast("string"), "toxic", "term", "times").collect()
    # examples of like label and like first terms share blocks, which keeps the blocks' bounds low
    sample = sorted(sample, key=lambda r: (r["toxic"], r["term"], r["times"], r["doc_id"] or ""))
    toxic = np.array([r["toxic"] for r in sample], float)
    taken = Counter(r["toxic"] for r in sample)
    index = Index(settings, np.log((1 + total) / (1 + frequency)) + 1, toxic,
                  np.array([met[r["toxic"]] / taken[r["toxic"]] for r in sample], float), [r["doc_id"] for r in sample], base,
                  (none[1] + base) / (none[0] + none[1] + 1))
    pairs = [(r["term"], r["times"]) for r in sample]
    index.build(pairs)
    index.calibrate(pairs)
    return index


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7,
                   id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """doc_id, held_out, text_hash, score, predicted (score >= threshold), neighbours (ids of the nearest examples), similarity
    (the largest cosine) and terms (those met, most frequent first). Learns from fold-3 remainders other than 1."""
    spark = docs.sparkSession
    marks = labels.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label_column}`").cast("int").alias("_toxic")).filter(
        F.col("_toxic").isin(0, 1)).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    rows = narrow(docs, id_column, text_column, held_out=is_fold(id_column, 3, 1),
                  text_hash=F.xxhash64(F.col(f"`{text_column}`").cast("string")))
    marked = lambda frame: frame.join(marks, (F.col("doc_id") == F.col("_id")) & ~F.col("held_out"), "left").drop("_id")
    ids = rows.filter(~F.col("held_out")).select("doc_id").distinct().join(marks, F.col("doc_id") == F.col("_id")).select(
        "doc_id", F.col("_toxic").alias("toxic"))
    sample = F.broadcast(bounded_sample(ids, "toxic", settings.learn_per_class, "toxic"))  # at most 2 x learn_per_class ids
    training = rows.join(sample, "doc_id").select("text", "toxic")
    terms = choose_terms(training, settings)
    vectors = cut_lineage(term_counts(rows, terms, settings), "toxicity")
    index = build_index(marked(vectors).withColumnRenamed("_toxic", "toxic"), len(terms), settings)
    shared = spark.sparkContext.broadcast((index, terms))

    kept = [f for f in vectors.schema if f.name not in ("term", "times")]
    out = StructType(list(kept)).add("score", DoubleType()).add("predicted", IntegerType()).add(
        "neighbours", ArrayType(StringType())).add("similarity", DoubleType()).add("terms", ArrayType(StringType()))

    def run(batches):
        index, terms = shared.value
        for batch in batches:
            ids, times = batch.column("term").to_pylist(), batch.column("times").to_pylist()
            found = [index.score(i, t) for i, t in zip(ids, times)]
            score = [f[0] for f in found]
            words = [[terms[i] for _, i in sorted(zip([-n for n in t], ids_))[:5]] for ids_, t in zip(ids, times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(score, pa.float64()),
                 pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.string())),
                 pa.array([f[2] for f in found], pa.float64()), pa.array(words, pa.list_(pa.string()))], out.names)

    return vectors.mapInArrow(run, out)


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7,
                  id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """The rows of `docs` that are not predicted toxic; all columns stay."""
    bad_id, bad_hash = free_name(docs, "_doc"), free_name(docs, "_hash")
    bad = score_toxicity(docs, labels, settings, threshold, id_column, text_column, label_column).filter("predicted = 1").select(
        F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    same = docs[f"`{id_column}`"].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[f"`{text_column}`"].cast("string")) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")
