"""Quality rules on tokeniser fertility, with rejection bands per language or script.

Each word of a text is tokenised with a public sentencepiece vocabulary. Characters per token, the share of byte-fallback
tokens and the entropy of the text's tokens say how natural the text is to that vocabulary. For each language, or script where
the language is unknown, the bands are the median plus and minus some interquartile ranges of all its documents that pass the
base rules (too short, too repetitive); groups of few documents use the bands of all documents. A document outside a band goes.

Null texts count as empty; a text without a word has no measures and fails the base rules. Repeated rows are judged one by
one. Quartiles are exact on measures rounded to 0.001, so a run gives the same bands again. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from colsift.llm.texts import map_texts, narrow, pieces_model
from colsift.plans.session import cut_lineage

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CACHE_WORDS = 300_000
BROADCAST_GROUPS = 10_000
MEASURES = ("chars_per_token", "byte_share", "token_entropy")


@dataclass(frozen=True)
class Settings:
    """A band reaches `reach` interquartile ranges from the median, and at least `least`: one each for characters per token,
    byte share and entropy. Groups of under `least_documents` documents use the bands of all."""

    reach: tuple[float, float, float] = (4.0, 6.0, 2.5)
    least: tuple[float, float, float] = (0.15, 0.1, 0.75)
    least_documents: int = 30
    least_words: int = 50
    repeated_percent: int = 50


@lru_cache(maxsize=4096)
def script_of(letter: str) -> str:
    """The first word of a letter's Unicode name, which is its script for nearly all."""
    return unicodedata.name(letter, "UNNAMED").split(" ")[0].lower()


def script(text: str) -> str:
    """The script of most letters of a text."""
    seen: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            name = script_of(c)
            seen[name] = seen.get(name, 0) + text.count(c)
    return max(sorted(seen), key=seen.get) if seen else "none"


def repeated_words(words: np.ndarray) -> int:
    """How many words stand in a three-word window that is found twice or more."""
    if len(words) < 4:
        return 0
    windows = (words[:-2] << 42) | (words[1:-1] << 21) | words[2:]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= again
    return int(covered.sum())


class Measurer:
    """Base counts and token measures of texts; the tokens of words are kept."""

    def __init__(self, vocabulary: str):
        self.model = pieces_model(vocabulary)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts, self.sizes, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[bytes]) -> None:
        ids = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for word in ids for i in word), np.int32, int(sizes.sum()))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.tokens = np.concatenate([self.tokens, flat])

    def tokens_of(self, words: np.ndarray) -> np.ndarray:
        sizes = self.sizes[words]
        total = int(sizes.sum())
        return self.tokens[np.repeat(self.starts[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)]

    def __call__(self, texts: list[str | None]):
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.reset()
        new = set()
        for words in split:
            new.update(words)
        self.learn(list(new - self.index.keys()))
        rows = []
        for text, words in zip(texts, split):
            text = text or ""
            n = len(words)
            chars = len(text) - sum(map(text.count, SPACES))
            lines = [line for line in text.split("\n") if line.strip(SPACES)]
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, n)
            measures = (None, None, None)
            if n:
                tokens = self.tokens_of(at)
                if len(tokens):
                    p = np.unique(tokens, return_counts=True)[1] / len(tokens)
                    measures = (round(chars / len(tokens), 3), round(float(self.is_byte[tokens].mean()), 3),
                                round(float(-(p * np.log2(p)).sum()), 3) + 0.0)
            rows.append((n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(at),
                         script(text), *measures))
        return list(zip(*rows))


MEASURED = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, script string, "
            "chars_per_token double, byte_share double, token_entropy double")


def quartiles(group: Column | None, measured: DataFrame) -> DataFrame:
    """The quartiles of each measure as arrays, by group or of all documents, with their number."""
    grouped = measured.groupBy(group.alias("group")) if group is not None else measured.groupBy()
    return grouped.agg(F.count("*").alias("documents"), *[F.percentile(m, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(m) for m in MEASURES])


def judge(docs: DataFrame, settings: Settings = Settings(), vocabulary: str = "piece_bpe_32k.model", id_column: str = "doc_id",
          text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the group, its three measures and `reasons` (the bands that were missed).

    The bands of all documents (nine numbers) go through the driver; those of the groups are joined.
    """
    lang = F.col(f"`{lang_column}`").cast("string") if lang_column else F.lit(None).cast("string")
    rows = narrow(docs, id_column, text_column, lang=lang)
    measured = map_texts(rows, "text", lambda: Measurer(vocabulary), MEASURED, ["doc_id", "lang"])
    failed = (F.col("n_words") < settings.least_words) | (
        100 * F.col("n_repeat_words") > settings.repeated_percent * F.col("n_words"))
    measured = cut_lineage(measured.withColumn("base_failed", failed).withColumn(
        "group", F.coalesce(F.col("lang"), F.concat(F.lit("script "), F.col("script")))).drop("lang", "script"), "fertility")
    passing = measured.filter(~F.col("base_failed") & F.col("chars_per_token").isNotNull())
    overall = quartiles(None, passing).first()
    bands = cut_lineage(quartiles(F.col("group"), passing).filter(F.col("documents") >= settings.least_documents).select(
        F.col("group").alias("_group"), *[F.col(m).alias(f"_{m}") for m in MEASURES]), "bands")
    if bands.count() <= BROADCAST_GROUPS:  # a few languages hold most rows, which a join by group would bring together
        bands = F.broadcast(bands)
    joined = measured.join(bands, F.col("group") == F.col("_group"), "left")
    reasons = []
    for measure, reach, least in zip(MEASURES, settings.reach, settings.least):
        whole = F.lit(None).cast("array<double>") if overall[measure] is None else F.array(*map(F.lit, overall[measure]))
        q = F.coalesce(F.col(f"_{measure}"), whole)
        away = F.greatest(reach * (q[2] - q[0]), F.lit(least))
        reasons.append(F.when(F.abs(F.col(measure) - q[1]) > away, F.lit(measure)))
    missed = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    return joined.withColumn("reasons", missed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.size("reasons") == 0).alias("kept"), F.col("group").alias("band_group"), *MEASURES, "reasons")
