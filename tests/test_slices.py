"""Even slices, pages, batches and robots patterns against plain loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from retailscope.operators import findings, ingest, links, overview
from retailscope.operators.keyed import even_slices, list_parts, number_rows, text_downward


def test_slices_are_even_for_names_that_share_a_prefix(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(-F.col("id")).alias("shop"),
        F.concat(F.lit("same long beginning "), F.lpad(F.xxhash64("id").cast("string"), 21, "0")).alias("name"),
    )
    cut = even_slices(rows, ["shop"], [F.col("name")], rate=2, step=64)
    hot = cut.filter("shop = 1").groupBy("_slice").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b")).orderBy("_slice").collect()
    assert cut.count() == 30_000 and sum(r["n"] for r in hot) == 10_000
    assert 60 < len(hot) < 95 and max(r["n"] for r in hot) < 300
    assert all(x["b"] < y["a"] for x, y in zip(hot[:-1], hot[1:], strict=True))
    assert cut.filter("shop <> 1").agg(F.max("_slice")).first()[0] == 0


def test_rows_are_numbered_without_given_slices(spark):
    rng = random.Random(4)
    rows = [(None if i % 7 == 0 else 1 if i % 3 else i % 50, rng.choice([None, "a", "ab", "é", ""]), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k int, t string, id long").repartition(5)
    order = [text_downward(F.col("t")), F.col("id")]
    got = {r["id"]: r["row_no"] for r in number_rows(df, ["k"], order).collect()}
    seen: dict = {}
    # UTF-8 order descending, nulls last
    place = {"é": 0, "ab": 1, "a": 2, "": 3, None: 4}
    for k, _, i in sorted(rows, key=lambda r: (place[r[1]], r[2])):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]
    parts = list_parts(df, ["k"], order, None, F.col("id"), per_part=100).collect()
    assert max(r["n"] for r in parts) == 100 and sorted(i for r in parts for i in r["items"]) == list(range(20_000))
    assert number_rows(df.limit(0), ["k"], order).count() == 0


def test_pages_equal_the_sorted_list(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 10, 20, 30]), rng.choice([None, "x", "y"])) for i in range(9_000)]
    stores = spark.createDataFrame(rows, "id long, lead_score int, domain string")
    known = {"asc": sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])), "desc": sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))}
    for way, want in known.items():
        for page in (1, 37, 90, 900):
            got, info = overview.page_of(stores, "score", way, page, 100)
            assert [r["id"] for r in got.collect()] == [r[0] for r in want[info.offset : info.offset + 100]]
            assert (info.page, info.total) == (min(page, 90), 9_000)
        for at in (0, 2_500, 8_950):
            after = overview.page_after(stores, want[at][0], want[at][1], "score", way, 100)
            assert [r["id"] for r in after.collect()] == [r[0] for r in want[at + 1 : at + 101]]
    got, info = overview.page_of(stores.limit(0), "score")
    assert got.count() == 0 and info.total_pages == 1


def test_a_batch_reads_the_range_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MIN_RANGE", 8)
    rng = random.Random(6)
    rows = [(p, rng.choice([None, *[f"s{i}" for i in range(400)]]), p) for p in range(0, 6_000, 3)]
    spark.createDataFrame(rows, "pos long, domain string, rank long").repartitionByRange(20, "pos").write.parquet(str(tmp_path / "feed"))
    feed = spark.read.parquet(str(tmp_path / "feed"))
    stores = spark.createDataFrame([("s1",), ("s2",), (None,)], "domain string")
    for cursor, n in ((0, 5), (900, 60), (5_000, 10_000), (0, 0), (9_999, 3)):
        want, seen, new = [], {"s1", "s2"}, 0
        for p, domain, _ in rows:
            if p < cursor or new >= n:
                continue
            label = "unusable" if domain is None else "duplicate" if domain in seen else "new"
            seen.add(domain)
            new += label == "new"
            want.append((p, label))
        batch = ingest.next_batch(feed, stores, cursor, n)
        assert sorted((r["pos"], r["feed_label"]) for r in batch.collect()) == want
    plan = ingest.next_batch(feed, stores, 0, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(pos", plan)


def test_robots_patterns_equal_regular_expressions(spark):
    rng = random.Random(7)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    cases = [("/" + pick("ab*.$", 6) + rng.choice(["", "$"]), "/" + pick("ab.$", 9)) for _ in range(3_000)]
    cases += [("/" + "*a" * 20 + "b", "/" + "a" * 5_000), ("*", "/x"), ("/é*ü$", "/éaü"), ("/*", "/")]

    def covers(pattern: str, path: str) -> bool:
        body = pattern.removesuffix("$")
        last = body.rsplit("*", 1)[-1]
        if len(path) > 1_000:
            return False
        found = re.match(".*".join(map(re.escape, body.split("*"))), path, re.S) is not None
        return found and (not pattern.endswith("$") or path.endswith(last))

    df = spark.createDataFrame(cases, "p string, u string")
    assert [r[0] for r in df.select(links.robots_match(F.col("p"), F.col("u"))).collect()] == [covers(*c) for c in cases]


def test_observations_are_counted_beyond_any_limit(spark):
    rows = [(1, "console", s, "console", f"m{s % 700}", "u", 1, None, None, None) for s in range(1_400)] + [(2, "http", 0, None, None, "u", None, None, 404, "script")]
    seen = spark.createDataFrame(rows, "page_id long, list string, seq long, kind string, text string, url string, line int, error_text string, status int, resource_type string")
    got = findings.tally_observations(seen).filter("page_id = 1").orderBy("key_no").collect()
    assert [(r["key_no"], r["text"], r["count"], r["truncated"]) for r in got] == [(i + 1, f"m{i}", 2, False) for i in range(700)]
    cut = findings.tally_observations(seen, max_keys=5).collect()
    assert sorted((r["page_id"], r["key_no"], r["truncated"]) for r in cut) == [(1, i, True) for i in range(1, 6)] + [(2, 1, False)]
