"""The registered queries of the text operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colsift.llm import (decontaminate, fertility, language, licenses, maxent, packing, resample, revisits, simhash,
                         suffixes, token_counts, toxicity, tries)
from colsift.plans.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_best_fit_packing")
def op2(spark, folder):
    return packing.pack(table(spark, folder, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_token_counts")
def op5(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"))


@query("op10_language_id")
def op10(spark, folder):
    return language.predict_languages(table(spark, folder, "documents"))


@query("op1_toxicity")
def op1(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "neighbours", "similarity", "terms")


@query("op4_simhash_groups")
def op4(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP6_SQL = """
    WITH doc_words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    item_words AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
    doc_places AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM doc_words WHERE len(w) > 0),
    item_places AS (SELECT item_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM item_words WHERE len(w) > 0),
    items AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 5], ' ') AS shingle FROM item_places),
    docs AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS shingle FROM doc_places),
    sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY 1)
    SELECT doc_id, item_id, round(count(*) / any_value(n), 6) AS containment
    FROM docs JOIN items USING (shingle) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.8"""


@query("op6_decontamination", OP6_SQL)
def op6(spark, folder):
    found = decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records made of the pages: a full response each, a hundred seconds apart, and a not-modified revisit each. Most revisits
    come some time after their page; every eleventh comes before it, every fifth has another entity tag."""
    at = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    page, tag = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    pair = lambda *texts: [F.lit(t) if isinstance(t, str) else t for t in texts]
    full = pages.select(page.alias("record_id"), "url", at(page * 100).alias("date"), F.create_map(*pair(
        "ETag", tag, "Content-Type", "text/html", "Content-Length", F.length("html").cast("string"),
        "Cache-Control", "max-age=60")).alias("headers"))
    after = F.when(page % 11 == 0, -50).otherwise(50 + 100 * (page % 7))
    revisit = pages.select((-1 - page).alias("record_id"), "url", at(page * 100 + after).alias("date"), F.create_map(*pair(
        "etag", F.concat(F.lit("W/"), F.when(page % 5 == 0, F.lit("other")).otherwise(tag)), "content-length", "0",
        "cache-control", F.concat(F.lit("max-age="), page % 3 * 60), "x-revisit", "1")).alias("headers"))
    return full, revisit


CANONICAL_SQL = """(SELECT CASE WHEN h <> '' THEN h || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') ||
        CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END FROM (SELECT r,
            regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS h,
            list_sort(list_filter(string_split(regexp_extract(r, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q
        FROM (SELECT regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r)))"""


OP9_SQL = f"""
    WITH p AS (SELECT page_id, {CANONICAL_SQL} AS url, md5(coalesce(html, '')) AS tag, length(html) AS n FROM pages),
    full_ AS (SELECT url, page_id * 100 AS t, max(page_id) AS page_id, max_by(tag, page_id) AS tag, max_by(n, page_id) AS n FROM p WHERE url IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT page_id, url, page_id * 100 + CASE WHEN page_id % 11 = 0 THEN -50 ELSE 50 + 100 * (page_id % 7) END AS t,
          CASE WHEN page_id % 5 = 0 THEN 'other' ELSE tag END AS tag FROM p),
    j AS (SELECT r.*, f.page_id AS full_id, f.t AS full_t, f.tag AS full_tag, f.n AS full_n FROM r ASOF LEFT JOIN full_ f ON r.url = f.url AND r.t > f.t)
    SELECT -1 - page_id AS record_id, url, CASE WHEN full_tag = tag THEN full_id END AS response_id,
           CASE WHEN url IS NULL THEN 'no_url' WHEN full_id IS NULL THEN 'no_earlier_response' WHEN full_tag = tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
           CASE WHEN full_tag = tag THEN 'cache-control: max-age=' || (page_id % 3 * 60) || '; content-length: ' || full_n || '; content-type: text/html; etag: W/' || tag || '; x-revisit: 1'
                ELSE 'cache-control: max-age=' || (page_id % 3 * 60) || '; content-length: 0; etag: W/' || tag || '; x-revisit: 1' END AS headers
    FROM j"""


@query("op9_revisits", OP9_SQL)
def op9(spark, folder):
    resolved = revisits.resolve(*captures(table(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select("record_id", "url", "response_id", "outcome", F.array_join(lines, "; ").alias("headers"))


@query("op7_fertility")
def op7(spark, folder):
    return fertility.judge(table(spark, folder, "documents"))


@query("op8_licenses")
def op8(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op3_lm_scores")
def op3(spark, folder):
    return maxent.score_documents(table(spark, folder, "documents"))


CRC_SQL = """CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))) AS BIGINT)"""
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"""

OP11_SQL = f"""
    WITH crc AS ({CRC_TABLE_SQL}),
    worded AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
               FROM (SELECT 's' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
    found AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
    hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM found)),
    bucketed AS (SELECT f, {CRC_SQL.format(bytes="list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))")} % 10000 AS bucket FROM hexed, crc),
    counted AS (SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM found JOIN bucketed USING (f) GROUP BY 1),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
    weights AS (SELECT id, floor(sum(gain) / count(*)) AS weight FROM found JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE kind = 's' GROUP BY 1),
    scored AS (SELECT id AS doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
               coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
               FROM worded LEFT JOIN weights USING (id) WHERE kind = 's'),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 25 // 100 AS drawn FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


@query("op11_target_resampling", OP11_SQL)
def op11(spark, folder):
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op13_suffix_dedup")
def op13(spark, folder):
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    return suffixes.without_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = f"""
    WITH crc AS ({CRC_TABLE_SQL}),
    turns AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
    opened AS (SELECT conv_id, s, {CRC_SQL.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))")} % 6 AS h FROM turns, crc),
    built AS (SELECT a.conv_id, list_concat(coalesce(b.s, []::STRUCT(role VARCHAR, text VARCHAR)[])[1:h], a.s[h + 1:]) AS p
              FROM opened a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100),
    members AS (SELECT conv_id, len(p) AS n, d, p[1:d] AS path FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM built)),
    nodes AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
              CASE WHEN any_value(d) > 0 THEN any_value(path)[1:any_value(d) - 1] END AS up FROM members GROUP BY path),
    children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    weighted AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(n.path[depth].text) ELSE 0 END AS save
                 FROM nodes n LEFT JOIN children USING (path)),
    sums AS (SELECT path[1:e] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(save) AS BIGINT) AS saved_tokens
             FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM weighted) GROUP BY 1)
    SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
    FROM weighted w JOIN sums USING (path) LEFT JOIN nodes u ON u.path = w.up"""


def with_shared_openings(turns: DataFrame) -> DataFrame:
    """Numbered turns (conv_id, k and more) of rebuilt conversations: the first h turns of the conversation whose number is rounded
    down to a hundred, then the own turns after the first h; h is the CRC-32 of the number modulo 6."""
    most = 5
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    first = turns.filter(F.col("k") <= most).withColumnRenamed("conv_id", "base")
    shared = convs.join(first, "base").filter("k <= h").drop("base", "h")
    sizes = first.groupBy("base").agg(F.max("k").alias("there"))
    moved = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    own = turns.join(moved, "conv_id").filter("k > h").withColumn("k", F.col("k") - F.col("h") + F.col("taken"))
    return shared.select(*turns.columns).unionByName(own.select(*turns.columns))


@query("op12_conversation_trie", OP12_SQL)
def op12(spark, folder):
    turns = cut_lineage(tries.digested(tries.numbered(table(spark, folder, "conversations"))), "turns")
    nodes = tries.trie(with_shared_openings(turns), turns.select("conv_id").distinct())
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
