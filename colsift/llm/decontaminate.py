"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Each test item is a set of word shingles. Items are partitioned by size, in powers of two; an item's sketch is its bottom-k by
hash, with k taken from the size partition: one more than the largest number of shingles that an item of the partition may
miss at the threshold. So a document that contains the threshold share of an item holds at least one hash of its sketch, and
the search loses nothing; the hits over k are the MinHash estimate of the containment. The hashes of all shingles of all
documents, whole and in place, meet the sketches in a hash join. Pairs found are verified on the shingles themselves.

Words are lower-cased runs of letters and digits; shingles have `width` words, and a shorter text is one shingle. Texts
without a word, and nulls, have no shingle: they are never contaminated and no item. Items or documents with the same text
count alike; a null id is an id. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colsift.llm.texts import free_name
from colsift.plans.session import cut_lineage

WIDTH = 5
THRESHOLD = 0.8
# a sketch table of up to this many hashes (16 bytes each) is broadcast; a larger one is left to Spark's own choice
BROADCAST_HASHES = 1_000_000


def words_of(text: str) -> Column:
    """The words of a text column."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def places_of(words: str, width: int) -> Column:
    """The first word of each shingle, from 0; none without a word."""
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_words(words: str, place: str, width: int) -> list[Column]:
    """The words of the shingle that starts there, NULL beyond the end."""
    return [F.get(F.col(words), F.col(place) + i) for i in range(width)]


def item_shingles(items: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """(item_id, hash, shingle, n): the distinct shingles of each item text and their number n."""
    words = items.select(F.col(f"`{id_column}`").alias("item_id"), F.col(f"`{text_column}`").cast("string").alias("text")).withColumn(
        "words", words_of("text")).select("item_id", "words")
    shingles = words.select("item_id", "words", F.explode(places_of("words", width)).alias("at")).select(
        "item_id", F.concat_ws(" ", *shingle_words("words", "at", width)).alias("shingle"),
        F.xxhash64(*shingle_words("words", "at", width)).alias("hash")).distinct()
    return shingles.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(item_id, hash, k): the bottom-k sketch of each item, k set by the item's size partition."""
    # sizes 2^(p-1) < n <= 2^p form partition p; the upper end bounds what an item of it may miss
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    k = F.least(F.col("n"), F.floor(upper * (1 - threshold) + 1e-9) + 1)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("hash"))
    return shingles.withColumn("k", k).withColumn("rank", rank).filter("rank <= k").select("item_id", "hash", "k")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, id_column: str = "doc_id",
                    text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, containment, estimate) for each item of whose distinct shingles a document holds at least
    `threshold`. `estimate` is the share of the sketch found. `text_hash` tells apart documents of one id."""
    item_table = item_shingles(items, width, item_column, item_text)
    sketch = sketches(item_table, threshold)
    if sketch.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        sketch = F.broadcast(sketch)
    keyed = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    keyed = keyed.withColumn("text_hash", F.xxhash64("text"))
    cut = lambda frame, *keys: frame.select(*keys, words_of("text").alias("words")).select(
        *keys, "words", F.explode(places_of("words", width)).alias("at"))
    hashes = cut(keyed, "doc_id", "text_hash").select(
        "doc_id", "text_hash", F.xxhash64(*shingle_words("words", "at", width)).alias("hash"))
    hits = hashes.join(sketch, "hash").groupBy("doc_id", "text_hash", "item_id").agg(
        (F.count_distinct("hash") / F.max("k")).alias("estimate"))
    # the found documents once more, with the shingles of the items found in them
    hits = cut_lineage(hits, "candidates")
    found = hits.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    again = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    again = again.dropDuplicates(["doc_id", "text_hash"])
    held = cut(again, "doc_id", "text_hash").select(
        "doc_id", "text_hash", F.concat_ws(" ", *shingle_words("words", "at", width)).alias("shingle"))
    met = held.join(item_table.select("item_id", "shingle", "n"), "shingle").groupBy("doc_id", "text_hash", "item_id").agg(
        (F.count_distinct("shingle") / F.max("n")).alias("containment")).filter(F.col("containment") >= threshold)
    named = hits.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "item_id")], "estimate")
    return met.join(named, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
                    & F.col("item_id").eqNullSafe(F.col("_item_id"))).select("doc_id", "text_hash", "item_id", "containment", "estimate")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that contain no item; all columns stay."""
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    bad_id, bad_hash = free_name(docs, "_doc"), free_name(docs, "_hash")
    bad = contained_items(docs, items, **options).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    same = docs[f"`{id_column}`"].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[f"`{text_column}`"].cast("string")) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")
