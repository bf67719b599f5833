"""Image choice, table functions, contexts, briefs and lists without cuts, against plain loops."""

import random

from pyspark.sql import functions as F

from retailscope.functions.text import fold, fold_any
from retailscope.operators import documents, extract, letters, links, scoring, search, tables, walls


def greedy(rows, k, room):
    picked = []
    for r in sorted(rows, key=lambda r: r[1]):
        if len(picked) < k and r[1] is not None and r[2] is not None and r[2] <= room:
            room -= r[2]
            picked.append(r[1])
    return picked


def test_images_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for audit, n in ((1, 4000), (2, 5), (3, 300), (None, 40)):
        for i in range(n):
            size = {1: 5000 - i, 2: 900, 3: rng.randint(1, 2000)}.get(audit, rng.randint(1, 50))
            rows.append((audit, i, None if i % 17 == 3 else size))
    images = spark.createDataFrame(
        [(a, i, "cart", "mobile", "x.png", 100, b) for a, i, b in rows], "audit_id bigint, id bigint, page string, viewport string, path string, height int, bytes bigint"
    ).repartition(7)
    issues = spark.createDataFrame([], "audit_id bigint, page string, severity string")
    for k, room in ((4, 6000), (1, 4999), (3, 100)):
        kept, skipped = scoring.select_images(images, issues, k, room)
        got = {}
        for r in kept.orderBy("image_no").collect():
            got.setdefault(r.audit_id, []).append(r.id)
        for audit in (1, 2, 3, None):
            assert got.get(audit, []) == greedy([r for r in rows if r[0] == audit], k, room)
        assert kept.count() + skipped.count() == len(rows)


def test_thinning_leaves_a_bounded_rest(spark):
    rows = [(1, 0, 0, 0, i, random.Random(i).randint(1, 10**6)) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "audit_id bigint, w int, v int, p int, i bigint, bytes bigint").coalesce(1)
    assert scoring.thin_candidates(frame, 4).count() < 400
    none = frame.filter("false")
    assert scoring.thin_candidates(none, 4).count() == 0


MESSY = [
    (1, "https://A.shop/x/y?q=1", '<a href="z">one</a><!-- <a href="no">no</a> --><A class=b HREF=\'/t?a=1&amp;b=2#c\'> T&eacute;xt &amp;lt; <b>in</b>\n</A><a href="">e</a><a href="#f">f</a><a href="?p">p</a>'),
    (2, "http://b.pl", '<a href="c">c</a><a href="//d.pl/e">d</a><a href="../up">up</a><a href="mailto:x@y.pl">m</a><footer><a href="http://B.pl/f">in</a></footer><a href=g>after</a>'),
    (3, "https://c.pl/", '<script><a href="s">s</a></script><a data-href="n">n</a><a href>v</a><div id="shopify-section-footer"><a href="https://other.pl">o</a>' + "".join(f'<a href="/{i}">{i}</a>' for i in range(600))),
    (4, None, '<a href="/k">k</a>'),
    (5, "https://e.pl", None),
    (6, "https://f.pl", ""),
    (7, "https://g.pl/a", '<a href="' + "x" * 50 + '">' + "w" * 300 + "</a>"),
]
LD = [
    (1, '<script type="application/ld+json">[{"@type": ["A", "B"], "name": "é"}, {"x": {"@type": "C"}}]</script><script type="application/ld+json">{bad</script>'),
    (2, None),
    (3, "no blocks"),
    (4, '<script data-x type=\'application/ld+json\'>{"@graph": [{"@type": "D", "y": [{"@type": "E"}]}], "@type": 5}</script>'),
]


def test_table_functions_equal_the_frame_form(spark):
    tables.register(spark)
    pages = spark.createDataFrame(MESSY, "page_id int, url string, html string")
    pages.createOrReplaceTempView("messy_pages")
    got = spark.sql("SELECT p.page_id, l.* FROM messy_pages p, LATERAL page_links(p.html, p.url) l").collect()
    want = extract.extract_links(pages).collect()
    key = lambda r: (r["page_id"], r["pos"])
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)]
    assert max(r.pos for r in got) > 500
    nodes = spark.createDataFrame(LD, "page_id int, html string")
    nodes.createOrReplaceTempView("ld_messy")
    got = spark.sql("SELECT p.page_id, n.pos, n.type, to_json(try_parse_json(n.node)) AS node FROM ld_messy p, LATERAL page_json_ld(p.html) n").collect()
    want = extract.extract_json_ld(nodes).withColumn("node", F.to_json("node")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5


def test_lists_are_whole_unless_limited(spark):
    xml = "<urlset>" + "".join(f"<loc>https://s/{i}</loc>" for i in range(700)) + "</urlset>"
    maps = spark.createDataFrame([(1, xml), (2, None), (3, "")], "site int, sitemap_xml string")
    assert links.expand_sitemaps(maps).count() == 700
    assert [r.loc for r in links.expand_sitemaps(maps, max_locations=2).orderBy("pos").collect()] == ["https://s/0", "https://s/1"]
    hits = spark.createDataFrame([(1, i, f"https://s.pl/{i % 8}", "t", "s") for i in range(20)], "search_id int, pos int, url string, title string, snippet string")
    sources = spark.createDataFrame([(1, f"https://s.pl/{i}", None) for i in range(7)], "search_id int, url string, title string")
    assert [tuple(r) for r in search.surplus_search_hits(hits, sources).collect()] == [(1, 2)]
    assert search.ground_search_hits(hits, sources)[0].count() == 5
    assert search.surplus_search_hits(hits, sources, 7).count() == 0


def test_context_apps_and_briefs(spark):
    apps = spark.createDataFrame([(1, "b", "ads"), (1, "a", "Gifts"), (1, "c", None), (1, "d", "Gifts"), (1, "e", "Odd")], "store_id int, name string, category string")
    stores = spark.createDataFrame([(1, None), (2, 15), (3, None)], "store_id int, apps_count bigint")
    got = {r.store_id: r.asDict(recursive=True) for r in documents.context_apps(apps, stores).collect()}
    assert set(got) == {1, 2}
    assert got[1]["total"] == 5 and got[1]["names"] == list("abcde") and got[1]["by_group"]["marketing"] == 1 and got[1]["by_group"]["other"] == 4
    assert got[1]["other"] == [{"category": "Gifts", "n": 2}, {"category": "Odd", "n": 1}]
    assert got[2]["total"] == 15 and got[2]["size"] == "high" and got[2]["names"] is None
    told = spark.createDataFrame([("SKIP",), ("NEW",), (None,), ("UX_PROBLEMS",)], "category string")
    rows = {r.category: r for r in letters.gate_letters(told).collect()}
    assert not rows["SKIP"].write and rows["SKIP"].brief is None and rows["SKIP"].known_category
    for name in ("NEW", None):
        assert rows[name].write and not rows[name].known_category and rows[name].brief == letters.BRIEFS[letters.DEFAULT_BRIEF]
    assert rows["UX_PROBLEMS"].brief == letters.BRIEFS["UX_PROBLEMS"]


def test_folding_reaches_all_single_letters(spark):
    texts = ["Nguyễn Đặng", "Ἀθῆναι Ά", "Йод ё", "Łódź ǖ ṩ", "İstanbul"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = df.select(fold(F.col("x")).alias("a"), fold_any(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a.startswith("nguyen")


def test_fetch_outcomes(spark):
    df = spark.createDataFrame([(s,) for s in (200, 301, 403, 404, 429, 500, 503, None)], "status int")
    got = {r.status: r.outcome for r in walls.fetch_outcomes(df).collect()}
    assert got == {200: "ok", 301: "ok", 403: "refused", 429: "refused", 503: "refused"}
