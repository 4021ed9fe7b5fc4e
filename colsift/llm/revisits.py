"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

A revisit record of the server-not-modified kind holds headers but no body. It is resolved to the latest response of the same
canonical URL with an earlier date (of several at one date, the largest record id). Validators decide whether the two belong
together, and the permitted headers of the revisit replace those of the response.

The timeline has one row per (URL, date), so ties and repeated rows collapse first. It is range-partitioned by URL and date,
so a URL that fills a third of it is spread over many tasks; a window finds the latest response within a partition, and one
row per URL and partition carries it on to the next. Only built-in functions are used.

A null or empty URL resolves to nothing (`no_url`), nor does a null date. Null headers are empty headers. Header names are
lower-cased; of two that then agree, the first by original name is kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colsift.plans.session import cut_lineage

# Fields that a 304 does not update (RFC 9111, 3.2 and RFC 9110, 7.6.1).
NOT_UPDATED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
               "transfer-encoding", "upgrade"]
HEADERS = "map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, `www.` and default port; path without a slash at the end; query parts in order,
    without `utm_` parts; no scheme, no fragment. NULL if there is no host."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    for extra in ("^[^@]*@", ":(80|443)$", r"^www[0-9]*\."):
        host = F.regexp_replace(host, extra, "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def lowered(headers: Column) -> Column:
    """Headers with lower-case names."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast(HEADERS))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(entries, lambda e: F.lower(e["key"]) == n)[0]["value"]))


def merged(stored: Column, update: Column) -> Column:
    """The stored headers, updated with the permitted ones of `update`."""
    new = F.map_filter(update, lambda k, _: ~k.isin(NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(new, k)), new)


def validators_agree(stored: Column, update: Column) -> Column:
    """Whether the entity tags (compared weakly) or else the modification dates are equal; NULL if neither is on both sides."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    return F.coalesce(tag(stored) == tag(update), stored["last-modified"] == update["last-modified"])


def latest_earlier(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """(url, date, response) for each distinct (url, date) of `asked`: `response` is that of the latest earlier date in
    (url, date, response), NULL if there is none. Both inputs have one row per (url, date)."""
    nothing = F.lit(None).cast(responses.schema["response"].dataType)
    timeline = responses.select("url", "date", "response", F.lit(False).alias("ask")).unionByName(
        asked.select("url", "date", nothing.alias("response"), F.lit(True).alias("ask")))
    # answers come before responses of the same date, which are not earlier; so both are to lie in one partition
    timeline = cut_lineage(timeline.repartitionByRange("url", "date").withColumn("part", F.spark_partition_id()), "timeline")
    before = F.last("response", ignorenulls=True).over(
        Window.partitionBy("part", "url").orderBy("date", F.desc("ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = timeline.filter(~F.col("ask")).groupBy("part", "url").agg(F.max_by("response", "date").alias("_last"))
    starts = timeline.groupBy("part", "url").agg(F.lit(1).alias("_one")).join(ends, ["part", "url"], "left")
    carried = F.last("_last", ignorenulls=True).over(
        Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = starts.select("part", "url", carried.alias("_carried")).filter(F.col("_carried").isNotNull())
    found = timeline.withColumn("_before", before).filter("ask")
    return found.join(carry, ["part", "url"], "left").select("url", "date", F.coalesce("_before", "_carried").alias("response"))


def resolve(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """For every row of `revisits`: record_id, url, date, response_id, response_date, outcome and headers.

    Both inputs have record_id, url, date and headers. `outcome` is resolved, unverified (no validator on both sides; the
    headers are merged), validator_mismatch, no_earlier_response or no_url (the headers stay the revisit's own).
    """
    keep = lambda frame: frame.select("record_id", canonical_url(F.col("url")).alias("url"), "date", lowered(F.col("headers")).alias("headers"))
    full = keep(responses).filter(F.col("url").isNotNull() & F.col("date").isNotNull()).groupBy("url", "date").agg(
        F.max_by(F.struct(F.col("record_id").alias("id"), "date", "headers"), "record_id").alias("response"))
    asking = keep(revisits)
    dated = asking.filter(F.col("url").isNotNull() & F.col("date").isNotNull()).select("url", "date").distinct()
    answers = latest_earlier(full, dated)
    stored, own = F.col("response.headers"), F.col("headers")
    agree = validators_agree(stored, own)
    outcome = (F.when(F.col("url").isNull(), "no_url").when(F.col("response").isNull(), "no_earlier_response")
               .when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("validator_mismatch"))
    joined = asking.join(answers, ["url", "date"], "left").withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unverified")
    return joined.select(
        "record_id", "url", "date", F.when(good, F.col("response.id")).alias("response_id"),
        F.when(good, F.col("response.date")).alias("response_date"), "outcome",
        F.when(good, merged(stored, own)).otherwise(own).alias("headers"))
