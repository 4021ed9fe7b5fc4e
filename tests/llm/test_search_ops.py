"""SimHash groups, decontamination, licenses and revisits against brute force and SQL; the pipeline against its parts."""

import random
import re
from datetime import datetime
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from colsift.llm import decontaminate, licenses, revisits, simhash
from colsift.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest id reachable for each id of id -> fingerprint."""
    own = {}
    for i, f in fps.items():
        own[f] = min(own.get(f, i), i)
    values = np.array(list(own), np.uint64)
    label = np.array(list(own.values()))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 3) for v in values]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    found = dict(zip(values.tolist(), label.tolist()))
    return {i: found[f] for i, f in fps.items()}


def test_simhash_of_the_table(documents, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    rows = simhash.near_duplicates(documents).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


@pytest.mark.parametrize("n, rounds", [(40, 4), (700, 3)])
def test_index_links_what_brute_force_links(n, rounds):
    pick = np.random.default_rng(n)
    fps = pick.integers(0, 2**63, n, dtype=np.uint64)
    for _ in range(rounds):
        near = fps[pick.integers(0, len(fps), n)] ^ (np.uint64(1) << pick.integers(0, 64, n).astype(np.uint64))
        fps = np.unique(np.concatenate([fps, near]))
    pick.shuffle(fps)
    group = np.sort(pick.integers(0, 3, len(fps)))
    got = simhash.linked_roots(fps, group)
    for g in range(3):
        at = np.flatnonzero(group == g)
        want = brute_components(dict(zip(at.tolist(), fps[at].tolist())))
        assert {i: got[i] for i in want} and len({(got[i], want[i]) for i in want}) == len(set(want.values())) == len({got[i] for i in want})


def test_split_groups_lose_no_link(spark):
    pick = np.random.default_rng(9)
    # two thousand fingerprints under one pattern, in near groups
    fps = np.unique((pick.integers(0, 400, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F) & np.uint64((1 << 48) - 1))
                    ^ (np.uint64(1) << pick.integers(0, 48, 2000).astype(np.uint64)))
    frame = spark.createDataFrame([(int(i), int(np.int64(f))) for i, f in enumerate(fps)], "doc_id bigint, fp bigint")
    want = brute_components(dict(enumerate(fps.tolist())))
    for rows in (64, 100_000):
        stars = simhash.star_components(simhash.near_links(frame.select("fp"), rows))
        root = {r["u"]: r["v"] for r in stars.collect()}
        got = [root.get(int(np.int64(f)), int(np.int64(f))) for f in fps]
        assert len(set(zip(got, want.values()))) == len(set(got)) == len(set(want.values()))


def test_gray_neighbours_differ_in_one_bit():
    ranks = np.arange(1024, dtype=np.uint64)
    codes = ranks ^ (ranks >> np.uint64(1))
    assert (simhash.gray_rank(codes) == ranks).all()


def test_simhash_of_edge_rows(edge_docs, empty_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {(r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {("0" * 16, 1)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(empty_docs).count() == 0
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9]


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_sql(spark, db, name):
    result = db.execute(SQL[name])
    columns = sorted(d[0] for d in result.description)
    want = sorted(str([row[[d[0] for d in result.description].index(c)] for c in columns]) for row in result.fetchall())
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(frame.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in frame.collect()) == want


def test_item_inside_a_long_document(spark):
    item = " ".join(f"alpha{i} Beta{i}," for i in range(20))
    filler = " ".join(f"filler{i % 313} text" for i in range(30_000))
    broken = item.replace("alpha10", "other").replace("alpha3", "another")  # 10 of 36 shingles are gone
    one_gone = item.replace("alpha10", "other")
    docs = spark.createDataFrame([(1, filler + " " + item.upper() + " " + filler), (2, filler), (3, broken), (4, one_gone), (5, None), (6, ""),
                                  (None, item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "!!"), (10, "two words")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(docs, items).collect()}
    assert found == {(1, 7): 1.0, (None, 7): 1.0, (4, 7): 31 / 36}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()) == [2, 3, 5, 6]


def test_sketches_hold_one_more_than_may_be_missing(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(i + 4))) for i in (1, 2, 5, 10, 33, 64)], "item_id bigint, text string")
    shingles = decontaminate.item_shingles(items, 5, "item_id", "text")
    for r in decontaminate.sketches(shingles, 0.8).groupBy("item_id").agg(F.count("*").alias("k")).collect():
        n = r["item_id"]
        assert min(n, int(0.2 * n + 1e-9) + 1) <= r["k"] <= n


def test_decontamination_of_edge_rows(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "the same text twice and again"), (1, "the same text twice and again")], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.contained_items(edge_docs, items).collect()} == {5, 6}
    kept = decontaminate.decontaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    assert decontaminate.contained_items(empty_docs, items).count() == 0
    assert decontaminate.decontaminated(edge_docs, items.limit(0)).count() == edge_docs.count()


def test_every_license_template_is_found(spark):
    rows = [(i, f"Some words.\n\nlicense\n{text}\n\nMore words.") for i, (_, text) in enumerate(licenses.TEMPLATES.values())]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["license_id"] for r in found} == dict(enumerate(licenses.TEMPLATES))


def test_wording_differences():
    mit = licenses.TEMPLATES["MIT"][1].replace(", ", ",\n").replace("restriction", "limits")
    row, = licenses.scan_text(f"Copyright (c) 2020 X\n{mit}\nend", licenses.Settings())
    assert (row["license_id"], row["missing"], row["extra"]) == ("MIT", ["restriction"], ["limits"])
    other, = licenses.scan_text("Licensed under the Apache License, Version 3.0.", licenses.Settings())
    assert (other["license_id"], other["candidate"], other["missing"]) == (None, "Apache-2.0 notice", ["2.0"])
    two = licenses.scan_text("Released under the MIT License.\nfoo\nLicensed under CC BY-NC 4.0.", licenses.Settings())
    assert [(r["license_id"], r["first_line"]) for r in two] == [("MIT notice", 0), ("CC-BY-NC-4.0 notice", 2)]


def wrapped(text, width=7):
    parts = text.split()
    return "\n".join(" ".join(parts[i:i + width]) for i in range(0, len(parts), width))


def test_third_party_notices_keep_all_their_licenses():
    """More licenses in one window than were once compared, wrapped over lines, near twins among them."""
    def found(*names):
        text = "\n\n".join(f"Part {i}\n{wrapped(licenses.TEMPLATES[n][1])}" for i, n in enumerate(names))
        return {r["license_id"] for r in licenses.scan_text(text, licenses.Settings())}

    for names in (("MPL-2.0", "GPL-2.0-or-later", "Unlicense", "Apache-2.0", "ISC", "BSD-2-Clause"),
                  ("GPL-2.0-or-later", "GPL-3.0-or-later"), ("BSD-2-Clause", "BSD-3-Clause"),
                  ("GPL-3.0-or-later", "GPL-2.0-or-later", "MPL-2.0", "Unlicense", "BSD-3-Clause", "MIT")):
        assert found(*names) == set(names)


GNU_HEADER = ("This {} is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published "
              "by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n\nThis {} is "
              "distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY.")


def test_gnu_headers_get_their_own_license():
    found = lambda text: [r["license_id"] for r in licenses.scan_text(text, licenses.Settings())]
    header = lambda thing, kind, version: GNU_HEADER.format(thing, kind, version, thing)
    for thing in ("program", "library"):
        assert found(header(thing, "Affero ", "3")) == ["AGPL-3.0-or-later"]
        assert found(header(thing, "Lesser ", "3")) == ["LGPL-3.0-or-later"]
        assert found(header(thing, "Lesser ", "2.1")) == ["LGPL-2.1-or-later"]
        assert found(header(thing, "", "3")) == ["GPL-3.0-or-later"] and found(header(thing, "", "2")) == ["GPL-2.0-or-later"]
    assert found(header("library", "Library ", "2")) == ["LGPL-2.0-or-later"]
    # an unknown kind is no GPL, and does not hide the GPL behind it
    assert found(header("program", "Lesser ", "9")) == [None]
    both = header("program", "Lesser ", "9").replace("version 9", "version 3 (or 9)").replace("Lesser", "Library") + "\n\n" + header("program", "", "3")
    assert found(both) == ["GPL-3.0-or-later"]
    assert found("Licensed under CC BY NC 4.0.") == [None]


def test_full_license_texts_are_found():
    for name, (_, text) in licenses.full_texts().items():
        found = [r["license_id"] for r in licenses.scan_text(f"Some words.\n\n{text if chr(10) in text else wrapped(text)}\nMore words.", licenses.Settings())]
        assert found == [name]
    # the full text of the Affero GPL differs from that of the GPL by its name
    affero = licenses.full_texts()["GPL-3.0"][1].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")
    assert "GPL-3.0" not in {r["license_id"] for r in licenses.scan_text(affero, licenses.Settings())}


def test_spdx_expressions_and_short_names():
    found = lambda text: sorted(str(r["license_id"]) for r in licenses.scan_text(text, licenses.Settings()))
    assert found("SPDX-License-Identifier: MIT") == ["MIT identifier"]
    assert found("// SPDX-License-Identifier: (Apache-2.0 OR MIT)\nint x;") == ["Apache-2.0 identifier", "MIT identifier"]
    assert found("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT") == ["GPL-2.0-only identifier", "MIT identifier"]
    assert found("Licensed under the Apache License, Version 2.0 or the MIT license") == ["Apache-2.0 notice", "MIT alternative"]
    assert found("Licensed under the Creative Commons Attribution 4.0 International License.") == ["CC-BY-4.0 name"]
    assert found("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.") == ["CC-BY-SA-4.0 name"]
    assert found("Released under the GNU GPL v3.") == ["GPL-3.0 name"]
    assert found("SPDX-License-Identifier: NONE") == ["None"]


def test_license_rank_is_the_size_reduction():
    plain, known = licenses.compressors()[:2]
    block = licenses.words(licenses.TEMPLATES["BSD-3-Clause"][1])
    data = " ".join(block).encode()
    order = licenses.ranked(block, known)
    assert [r[1] for r in order] == sorted(len(t.compressor.compress(data)) for t in known) and order[0][0] == len(plain.compress(data))
    assert order[0][2].name == "BSD-3-Clause"


def test_ranked_licenses_are_those_of_comparing_every_template():
    """Random mixtures of templates and other words, against the template that explains most words in each round."""
    draw, settings, known = random.Random(5), licenses.Settings(), licenses.compressors()[1]

    def compared(block):
        free, names = list(range(len(block))), set()
        while True:
            held = [(-share * len(t.words), t.name, used) for t in known for share, used, _, _ in [licenses.place(t, block, free, settings) or (0, set(), [], [])] if used]
            if not held:
                return names
            _, name, used = min(held, key=lambda h: h[:2])
            names.add(name)
            free = [i for i in free if i not in used]

    for _ in range(150):
        names = draw.sample(sorted(licenses.TEMPLATES), draw.randint(1, 4))
        block = []
        for name in names:
            block += draw.choices(["alpha", "beta", "code", "the", "of", "file"], k=draw.randint(0, 8)) + licenses.words(licenses.TEMPLATES[name][1])
        found = {row["license_id"] for row in licenses.scan_window(block, settings)}
        assert found == compared(block), names


def test_licenses_of_the_table(documents, texts):
    line = re.compile(r"^(Licensed under CC BY-NC 4.0|This work is licensed under the GNU General Public License, version 3|"
                      r"Licensed under the Apache License, Version 2.0|Released under the MIT License)\.$", re.M)
    want = sorted((i, m.start()) for i, t in texts.items() for m in line.finditer(t))
    found = licenses.scan_licenses(documents).filter("license_id is not null").collect()
    assert sorted(r["doc_id"] for r in found) == [i for i, _ in want] and all(r["matched_share"] == 1 for r in found)


def test_licenses_of_edge_rows(spark, edge_docs, empty_docs):
    assert licenses.scan_licenses(edge_docs).count() == 0 and licenses.scan_licenses(empty_docs).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "licence\n" * 3000)],
                                  "doc_id bigint, text string")
    found = licenses.scan_licenses(twice).collect()
    assert [r["license_id"] for r in found if r["doc_id"] == 1] == ["MIT notice"] * 2
    assert [r["license_id"] for r in found if r["doc_id"] is None] == [None]


def at(second):
    return datetime(2024, 1, 1, 0, 0, second)


RECORDS = "record_id bigint, url string, date timestamp, headers map<string,string>, outcome string, response string"


def test_revisits(spark):
    full = spark.createDataFrame([
        (1, "http://www.A.example:80/x/?b=2&a=1&utm_source=q#top", at(1), {"ETag": '"v1"', "Content-Type": "text/html", "Age": "1"}, "", ""),
        (2, "https://a.example/x?a=1&b=2", at(5), {"etag": '"v2"', "content-length": "10"}, "", ""),
        (3, "https://a.example/x?a=1&b=2", at(5), {"etag": '"v3"', "content-length": "11"}, "", ""),
        (4, "https://b.example/", at(1), None, "", ""), (5, None, at(1), {}, "", ""), (6, "c.example", None, {}, "", "")], RECORDS)
    asked = spark.createDataFrame([
        (11, "a.example/x/?a=1&b=2", at(3), {"ETAG": 'W/"v1"', "Content-Type": "none", "Age": "9"}, "", ""),
        (12, "a.example/x?b=2&a=1", at(5), {"etag": '"v1"'}, "", ""), (13, "a.example/x?b=2&a=1", at(6), {"etag": '"v3"'}, "", ""),
        (13, "a.example/x?b=2&a=1", at(6), {"etag": '"v3"'}, "", ""), (14, "a.example/x?b=2&a=1", at(9), {"etag": '"v1"'}, "", ""),
        (15, "a.example/x?b=2&a=1", at(1), {"etag": '"v1"'}, "", ""), (16, "b.example", at(2), {"x": "y"}, "", ""),
        (17, None, at(2), {"x": "y"}, "", ""), (18, "", at(2), None, "", ""), (19, "c.example", None, {}, "", "")], RECORDS)
    rows = revisits.resolve(full, asked).collect()
    assert len(rows) == 10
    found = {r["record_id"]: (r["outcome"], r["response_id"], r["headers"]) for r in rows}
    assert found[11] == ("resolved", 1, {"etag": 'W/"v1"', "content-type": "text/html", "age": "9"})
    assert found[12][:2] == ("resolved", 1)  # the response of the same second is not earlier
    assert found[13] == ("resolved", 3, {"etag": '"v3"', "content-length": "11"})
    assert found[14] == ("validator_mismatch", None, {"etag": '"v1"'})
    assert found[15][:2] == ("no_earlier_response", None)
    assert found[16] == ("unverified", 4, {"x": "y"})
    assert found[17][0] == found[18][0] == "no_url" and found[19][0] == "no_earlier_response"
    assert revisits.resolve(full.limit(0), asked.limit(0)).count() == 0


def test_revisits_of_one_hot_address(spark):
    """Many captures of one address, dealt over many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ids = spark.range(3000)
        frame = lambda sign, shift: ids.select((F.col("id") * sign).alias("record_id"), F.lit("h.example/").alias("url"), F.timestamp_seconds(
            F.col("id") * 10 + shift).alias("date"), F.create_map(F.lit("etag"), (F.col("id") % 2).cast("string")).alias("headers"))
        full = frame(1, 0).filter("record_id % 100 = 0")
        rows = revisits.resolve(full, frame(-1, 5).filter("record_id % 2 = 0")).collect()
        assert len(rows) == 1500 and all(r["response_id"] == -r["record_id"] // 100 * 100 and r["outcome"] == "resolved" for r in rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def test_ties_of_one_hot_address(spark):
    """A response and a revisit at every date of one address, with bounds of the ranges among them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        dates = spark.range(60).select(F.lit("h.example/").alias("url"), F.timestamp_seconds("id").alias("date"), F.col("id").alias("response"))
        found = revisits.latest_earlier(dates, dates.drop("response")).select(F.unix_timestamp("date"), "response").collect()
        assert {d: r for d, r in found} == {0: None, **{i: i - 1 for i in range(1, 60)}} and len(found) == 60
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, FOLDER)
        if name == "packing":
            left = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert left == before
            break
        assert out.columns == docs.columns
        docs = out.cache()
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        gone = before - after
        if name == "language_id":
            assert not gone
        elif name == "toxicity":
            assert gone and not [i for i in gone if labels.get(i) == 0]
        elif name == "near_duplicates":
            groups = brute_components({i: brute_fingerprint(texts[i]) for i in before})
            assert after == {i for i, g in groups.items() if i == g}
        elif name == "decontamination":
            items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            cut = lambda words: {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
            known = [cut(w) for w in items]
            bad = {i for i in before for k in known if len(k & cut(re.findall(r"[^\W_]+", texts[i].lower()))) >= 0.8 * len(k)}
            assert gone == bad
    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()}
    assert whole == left


def test_pipeline_of_edge_rows(spark, edge_docs, empty_docs):
    for docs in (edge_docs, empty_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "packing" or out.columns == docs.columns
            docs = out
        docs.count()
