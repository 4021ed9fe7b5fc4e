"""Token counts by rank-synchronous array merging.

Texts are cut into the pre-tokens of a byte-level BPE vocabulary. Many pre-tokens are held as one ragged array of symbols;
each step finds every sequence's pair of lowest rank and applies it everywhere in that sequence at once, in all sequences of
the batch. A sequence without a known pair is done, and what is left of it are its tokens. Counts are those of the library
for the same vocabulary; a special token's string inside a text is that one token.

Null texts count as empty. Empty texts have 0 tokens. Long texts are never cut; memory is bounded by the longest text and a
cache of `CACHE_PARTS` counts. Rows are counted one by one, so repeated rows and ids stay. Extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from colsift.llm.texts import map_texts, narrow, parts_of, vocabulary_path

CACHE_PARTS = 400_000
LONGEST_CACHED = 64
ABSENT = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merge ranks of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, name: str):
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocab, merges = spec["pre_tokenizer"], spec["model"]["vocab"], spec["model"]["merges"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError(f"{name} is not a plain byte-level vocabulary")
        import public_tokenizers
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.of_byte = np.zeros(256, np.int32)
        for symbol, byte in byte_symbols().items():
            self.of_byte[byte] = vocab[symbol]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ABSENT if it is no merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], ABSENT)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each word after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        result = np.zeros(len(words), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        # rank of the pair that starts at each symbol; the last of a sequence starts none
        ranks = np.full(len(symbols), ABSENT, np.int32)
        if len(symbols) > 1:
            ranks[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), ABSENT)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            least = np.minimum.reduceat(ranks, starts)
            done = least == ABSENT
            if done.any():
                result[owner[starts[done]]] = lengths[done]
                going = ~np.repeat(done, lengths)
                symbols, owner, ranks = symbols[going], owner[going], ranks[going]
                least, lengths = least[~done], lengths[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, lengths))
            # of overlapping pairs, as in a a a, the first, third, ... are merged
            first = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, owner, ranks = symbols[stays], owner[stays], ranks[stays]
            touched = np.zeros(len(symbols), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            changed = np.flatnonzero(touched)
            right = np.minimum(changed + 1, len(symbols) - 1)
            paired = (changed + 1 < len(symbols)) & (owner[changed] == owner[right])
            ranks[changed] = np.where(paired, self.rank(symbols[changed], symbols[right]), ABSENT)
        return result


@lru_cache(maxsize=4)
def merges(name: str) -> Merges:
    return Merges(name)


class Counter:
    """Counts the tokens of texts; counts of the parts between spaces are kept."""

    def __init__(self, name: str):
        self.merges, self.first, self.later = merges(name), {}, {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text without its special tokens, and the number of these."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [text], 0
        if self.merges.special is None or not self.merges.special.search(text):
            return self.merges.pattern.findall(text), 0
        plain = self.merges.special.split(text)
        return [t for part in plain for t in self.merges.pattern.findall(part)], len(plain) - 1

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece: its pre-tokens are merged together with those of all others, each distinct one once."""
        cut = [self.pretokens(p) for p in pieces]
        distinct = list({w for words, _ in cut for w in words})
        counts = dict(zip(distinct, self.merges.count([w.encode("utf-8", "surrogatepass") for w in distinct]).tolist()))
        return [counts[words[0]] if len(words) == 1 and not special else special + sum(map(counts.__getitem__, words))
                for words, special in cut]

    def __call__(self, texts: list[str | None]):
        split = [parts_of(t or "") for t in texts]
        new_first = {s[0] for s in split if s} - self.first.keys()
        new_later = {w for s in split if s for w in s[1:]} - self.later.keys()
        whole = [t or "" for t, s in zip(texts, split) if s is None]
        fresh = [*new_first, *(" " + w for w in new_later), *whole]
        counts = self.count_pieces(fresh)
        first = dict(zip(new_first, counts))
        later = dict(zip(new_later, counts[len(new_first):]))
        wholes = iter(counts[len(new_first) + len(new_later):])
        known_first, known_later = self.first | first, self.later
        known_later.update(later)
        tokens = [next(wholes) if s is None else known_first[s[0]] + sum(map(known_later.__getitem__, s[1:])) for s in split]
        if len(known_later) > CACHE_PARTS:
            known_later.clear()
        else:
            for w in later:
                if len(w) > LONGEST_CACHED:
                    del known_later[w]
        n_bytes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        return n_bytes, tokens


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) for every row."""
    def make():
        count = Counter(vocabulary)

        def run(texts):
            n_bytes, tokens = count(texts)
            return n_bytes, tokens, [n > limit for n in tokens]

        return run

    return map_texts(narrow(docs, id_column, text_column), "text", make,
                     "n_bytes bigint, n_tokens bigint, over_limit boolean", ["doc_id"])
