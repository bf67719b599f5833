"""Jobs on small fixtures, against expectations worked out in plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from retailscope.operators import contacts, documents, scoring
from retailscope.operators.keyed import list_parts, number_rows, previous_value, running_sum
from retailscope.sources import catalog, exports, feed, upserts
from retailscope.streaming import jobs


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows belong to one key."""
    rng = random.Random(7)
    rows = [(1 if i % 3 == 0 else rng.randint(2, 40), i, rng.randint(0, 5)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k int, seq bigint, v int").repartition(8)


def by_key(rows):
    out = {}
    for k, seq, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(k, []).append((seq, v))
    return out


def test_slices_number_hot_keys(hot):
    rows, df = hot
    slices = F.floor(F.col("seq") / 100)
    got = {(r.k, r.seq): r.no for r in number_rows(df, ["k"], [F.col("seq")], slices, "no").collect()}
    down = {(r.k, r.seq): r.no for r in number_rows(df, ["k"], [F.col("seq").desc()], slices, "no", descending=True).collect()}
    total = {r.seq: r.t for r in running_sum(df, [], [F.col("seq")], slices, F.col("v"), "t").collect()}
    before = {(r.k, r.seq): r.p for r in previous_value(df, ["k"], ["seq"], slices, "v", "p").collect()}
    for k, items in by_key(rows).items():
        for i, (seq, _) in enumerate(items):
            assert got[k, seq] == i + 1 and down[k, seq] == len(items) - i
            assert before[k, seq] == (items[i - 1][1] if i else None)
    run = 0
    for _, seq, v in sorted(rows, key=lambda r: r[1]):
        run += v
        assert total[seq] == run


def test_list_parts_keep_every_row(hot):
    rows, df = hot
    parts = list_parts(df, ["k"], [F.col("seq")], F.floor(F.col("seq") / 100), F.col("seq"), per_part=50).collect()
    assert max(len(p["items"]) for p in parts) <= 50
    for k, items in by_key(rows).items():
        mine = sorted((p for p in parts if p.k == k), key=lambda p: p.part)
        assert [s for p in mine for s in p["items"]] == [s for s, _ in items]


def test_strongest_person_equals_the_fold(spark):
    rank = {"jsonld": 0, "role_text": 1, "ai_about": 2, "email_local": 3}
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), i, rng.choice(["Anna Nowak", "ANNA  Nówak", "Jan Lis"]), rng.choice([None, "CEO", "Other"]), rng.choice(list(rank))) for i in range(200)]
    got = {
        (r.store_id, r.name_key): r.seq
        for r in contacts.strongest_person(spark.createDataFrame(rows, "store_id int, seq int, name string, role string, source string"), ["seq"]).collect()
    }
    best = {}
    for store, seq, name, role, source in rows:
        key = (store, "jan lis" if name == "Jan Lis" else "anna nowak")
        held = best.get(key)
        if held is None or (held[1] is None and role is not None) or ((role is not None or held[1] is None) and rank[source] < rank[held[2]]):
            best[key] = (seq, role, source)
    assert got == {k: v[0] for k, v in best.items()}


def plain_json(x):
    if isinstance(x, dict):
        return {k: plain_json(v) for k, v in x.items() if v is not None}
    return [plain_json(v) for v in x] if isinstance(x, list) else x


def size_of(x):
    return len(json.dumps(plain_json(x), ensure_ascii=False, separators=(",", ":")).encode())


def trimmed(ctx, limit):
    """The same trims by trying: one step after the other, then issue by issue."""
    x, meta, audit = ctx, ctx["meta"], ctx["audit"]
    total = sum(audit["counts"].values()) if audit else 0

    def cap(n):
        changed = False
        for i in audit["issues"]:
            if i["evidence"] and len(i["evidence"]) > n:
                i["evidence"], changed = i["evidence"][:n], True
        return changed

    def drop(items, field, keep=lambda i: False):
        hit = [i for i in items if i[field] is not None and not keep(i)]
        for i in hit:
            i[field] = None
        return bool(hit)

    def minors():
        kept = [i for i in audit["issues"] if i["severity"] != "MINOR"]
        changed = len(kept) < len(audit["issues"])
        audit["issues"] = kept
        if changed:
            meta["issues_omitted"] = total - len(kept)
        return changed

    steps = [
        ("page-facts", lambda: drop(audit["pages"], "facts")),
        ("app-names", lambda: drop([x["apps"]], "names") if x["apps"] else False),
        ("check-errors", lambda: any([drop(p["failed_checks"] or [], "error") for p in audit["pages"]])),
        ("issue-detail", lambda: drop(audit["issues"], "detail", lambda i: i["severity"] == "CRITICAL")),
        ("evidence", lambda: cap(2)),
        ("failed-checks", lambda: drop(audit["pages"], "failed_checks")),
        ("minor-issues", minors),
        ("critical-detail", lambda: drop(audit["issues"], "detail")),
        ("evidence-min", lambda: cap(1)),
    ]
    for name, step in steps if audit else steps[1:2]:
        if size_of(x) <= limit:
            return x
        if step():
            meta["truncated"] = True
            meta["trimmed"].append(name)
    first = True
    while size_of(x) > limit and audit and audit["issues"]:
        if first:
            meta["truncated"], first = True, False
            meta["trimmed"].append("issue-tail")
        audit["issues"].pop()
        meta["issues_omitted"] = total - len(audit["issues"])
    return x


@pytest.mark.parametrize("limit", [900, 1500, 2500, 6000])
def test_context_trims_equal_trying(spark, sf_dir, limit):
    from retailscope.plans.leads import contexts

    built = contexts(spark, sf_dir)
    before = {r.store_id: r.context.asDict(recursive=True) for r in built.collect()}
    for r in documents.fit_to_budget(built, limit).collect():
        want = trimmed(before[r.store_id], limit)
        assert r.context.asDict(recursive=True) == want
        assert r.bytes == size_of(want) and r.over_budget == (r.bytes > limit)


def test_images_stay_within_their_bytes(spark, sf_dir):
    from retailscope.plans.leads import _images

    kept, skipped = _images(spark, sf_dir)
    for r in kept.groupBy("audit_id").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect():
        assert r.b <= scoring.MAX_IMAGE_BYTES and r.n <= scoring.MAX_IMAGES
    assert {r.reason for r in skipped.select("reason").distinct().collect()} <= {"full-page", "too-tall", "over-limit", "unreadable", "over-budget"}


def test_cooldown_strikes(spark, tmp_path):
    base = dt.datetime(2026, 9, 1)
    hour = dt.timedelta(hours=1)
    rows = [
        ("a.pl", base, "refused", None), ("a.pl", base + hour / 2, "refused", None), ("a.pl", base + hour, "refused", None),
        ("b.pl", base, "refused", None), ("b.pl", base + 3 * hour, "refused", None),
        ("c.pl", base, "refused", "7200"), ("d.pl", base, "refused", "60"), ("e.pl", base, "refused", None), ("e.pl", base + hour / 2, "ok", None),
        ("f.pl", base, "refused", "999999"),
    ]
    df = spark.createDataFrame([(d, t, o, "rate_limited", 429, r) for d, t, o, r in rows], "domain string, ts timestamp, outcome string, reason string, status int, retry_after string")
    source = str(tmp_path / "in")
    df.write.parquet(source)
    stream = jobs.track_cooldowns(spark.readStream.schema(df.schema).parquet(source))
    jobs.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.domain: (r.strikes, (r.blocked_until_ms - int(base.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) / 3_600_000) for r in jobs.newest_cooldowns(spark, str(tmp_path / "out")).collect()}
    assert got == {"a.pl": (3, 5.0), "b.pl": (1, 4.0), "c.pl": (1, 2.0), "d.pl": (1, 1.0), "f.pl": (1, 24.0)}


def test_store_feed_reads_loose_json(spark, tmp_path):
    page = {
        "domains": [
            {"name": "WWW.A.pl", "merchant_name": " A ", "rank": "12.5", "estimated_sales": 1000, "theme": "Dawn", "platform": "Shopify", "country_code": "pl",
             "apps": [{"name": "Mail", "state": "active", "categories": ["unknown", "Ads"]}, {"name": "mail", "state": None}, {"name": "Old", "state": "removed"}]},
            {"name": None, "platform_domain": "b.host.pl", "theme": {"name": "Craft", "version": "Unknown"}, "technologies": [{"name": "X"}, "Y"]},
            {"name": "localhost"},
        ],
        "has_next_page": False,
    }
    (tmp_path / "p.json").write_text(json.dumps(page))
    raw = feed.read_store_feed(spark, str(tmp_path))
    shops = {r.pos: r for r in feed.normalise_store_feed(raw).collect()}
    assert (shops[0].domain, shops[0].name, shops[0]["rank"], shops[0].theme_name, shops[0].country, shops[0].apps_count) == ("a.pl", "A", 13, "Dawn", "PL", 1)
    assert (shops[1].domain, shops[1].theme_name, shops[1].theme_version) == ("b.host.pl", "Craft", None)
    assert not shops[2].usable
    apps = feed.explode_store_apps(raw, "source_file").collect()
    assert [(a.name, a.category) for a in apps] == [("Mail", "Ads")]
    assert [r.technologies for r in raw.orderBy("pos").collect()][1] == ["X", "Y"]
    with pytest.raises(ValueError):
        feed.require_feed_filter(raw, "DE")


def test_theme_catalog_and_releases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"updatedAt": "2026-09-01", "themes": {
        "dawn": {"displayName": "Dawn", "architecture": "os2", "releases": [{"version": "2.0", "releasedAt": "2026-01-01"}, {"version": "1.0", "releasedAt": "2025-01-01"}]},
        "old": {"displayName": "Old", "architecture": "vintage", "latest": {"version": "9", "releasedAt": None}, "releases": []}}}))
    rows = catalog.read_theme_catalog(spark, str(tmp_path / "c.json"))
    assert {(r.theme_key, r.latest_version) for r in catalog.catalog_entries(rows).collect()} == {("dawn", "2.0"), ("old", "9")}
    assert [r.version for r in catalog.catalog_releases(rows).orderBy("pos").collect()] == ["2.0", "1.0"]
    docs = spark.createDataFrame([("t", json.dumps([{"tag_name": "v1", "published_at": "2026-01-02T00:00:00Z"}, {"tag_name": "1", "published_at": "2026-02-02T00:00:00Z"},
        {"tag_name": "v2", "published_at": "2026-03-02T00:00:00Z", "prerelease": True}]), json.dumps([{"name": "theme_info", "theme_version": " 4.1 "}]))], "theme_key string, releases_json string, settings_json string")
    assert [(r.version, str(r.released_at)) for r in catalog.parse_release_feed(docs).collect()] == [("1", "2026-01-02")]
    assert catalog.settings_version(docs).first().version == "4.1"


def test_export_is_one_safe_file_sequence(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b.pl", None, None, "=1", 'say "hi"', "x", "C", 5, 9, 1, "t"), (1, "a.pl", "Ann", None, "a@a.pl", "s", "two\nlines", "C", None, 9, 1, "t")],
        "id bigint, domain string, contact_name string, contact_role string, contact_email string, subject string, body string, category string, lead_score int, word_count int, version int, created_at string")
    exports.export_approved(rows, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
    assert text.startswith('﻿"domain","contact_name"') and text.endswith("\r\n")
    assert text.index('"a.pl"') < text.index('"b.pl"') and '"\'=1","say ""hi"""' in text


def test_partition_rewrite_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int").write.partitionBy("p").parquet(path)
    target = spark.read.parquet(path)
    fresh = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, p int")
    merged = upserts.upsert(target.filter("p = 2"), fresh, ["k"], upserts.OVERWRITE)
    upserts.write_partitions(merged, path, ["p"])
    assert {tuple(r) for r in spark.read.parquet(path).select("k", "v", "p").collect()} == {(1, "a", 1), (2, "c", 2), (3, "d", 2)}
    snaps = str(tmp_path / "s")
    for run in (1, 2):
        upserts.append_snapshots(spark.createDataFrame([(1, run, "feed", "{}")], "store_id int, run_id int, source string, payload string"), snaps)
    assert spark.read.parquet(snaps).count() == 2


def test_suppression_survives_a_rewrite(spark):
    stores = spark.createDataFrame([(1, "a.pl"), (2, "b.pl")], "store_id int, store_domain string")
    held = spark.createDataFrame([(1, "x@a.pl"), (1, "y@mail.pl"), (2, "z@b.pl")], "store_id int, email string")
    none = spark.createDataFrame([], "email string, domain string, reason string")
    asked = spark.createDataFrame([(" Y@Mail.pl", None, "objection"), (None, "https://www.B.pl/", "erasure_request")], "email string, domain string, reason string")
    kept, supp = contacts.forget(held, none, asked, stores)
    assert [r.email for r in kept.collect()] == ["x@a.pl"]
    again, same = contacts.forget(kept, supp, asked, stores)
    assert same.count() == supp.count() == 2 and again.count() == 1
