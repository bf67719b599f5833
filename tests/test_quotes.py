"""Quotes over the edges of pages against the joined text of each shop."""

from __future__ import annotations

import random

from retailscope.operators import contacts

PAGES = "store_id long, page_no long, kind string, url string, text string"
PEOPLE = "store_id long, person_no long, name string, role string, quote string, store_domain string"


def test_quotes_are_found_as_in_the_joined_text(spark):
    rng = random.Random(3)
    words = ["Anna", "Nowak", "runs", "the", "shop", "and", "a"]
    pages = [(s, p, "about", f"https://s/{s}/{p}", rng.choice(["", "  ", None, *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(9)]])) for s in range(12) for p in range(9)]
    pages.append((50, 1, "about", "u", "Anna Nowak"))
    people = [(s, 100 * s + n, "Anna Nowak", "", "  ".join(["Anna", "Nowak"] + [rng.choice(words) for _ in range(rng.randint(0, 3))]), "x.pl") for s in range(12) for n in range(60)]
    people += [(51, 9999, "Anna Nowak", "", "Anna Nowak runs", "x.pl")]
    found = contacts.ground_quotes(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(pages, PAGES)).collect()
    text = {}
    for store, _, _, _, body in sorted(pages, key=lambda p: p[:2]):
        text[store] = " ".join(f"{text.get(store, '')} {body or ''}".lower().split())
    held = {p[1]: " ".join(p[4].lower().split()) in text.get(p[0], "") for p in people}
    assert sum(held.values()) > 40 and {r["person_no"]: r["verdict"] in ("grounded", "repeated") for r in found} == held


def test_quotes_of_any_length_are_found_as_in_the_text(spark):
    rng = random.Random(5)
    words = ["ala", "łoś", "a", "al", "alabaster", "😀é", "of", "the", "x" * 70, "x" * 71]
    say = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
    texts = [(rng.randrange(3), n, say(60)) for n in range(150)] + [(0, 900, ""), (None, 901, "ala of the")]
    bodies = [t for _, _, t in texts if len(t) > 3]
    cut = lambda t, i, j: " ".join(t[min(i, j) : max(i, j)].split())
    quotes = {(rng.randrange(3), cut(t, rng.randrange(len(t)), rng.randrange(len(t)))) for t in bodies * 4} | {(rng.randrange(3), say(4)) for _ in range(200)}
    quotes = sorted(q for q in quotes if " " in q[1])
    want = sorted((n, q) for s, q in quotes for at, n, t in texts if at == s and q in t)
    for kind in ("long", "int"):
        asked, held = spark.createDataFrame([*quotes, (None, "ala of")], "store_id long, _quote string"), spark.createDataFrame(texts, f"store_id {kind}, page_no long, _text string")
        found = contacts.texts_with_quotes(asked, held, ["page_no"]).distinct().collect()
        assert len(want) > 500 and sorted((r["page_no"], r["_quote"]) for r in found) == want
    assert contacts.texts_with_quotes(asked.limit(0), held, ["page_no"]).collect() == []


def test_places_that_read_otherwise_stay_in_their_row(spark):
    quotes = spark.createDataFrame([(1, f"jan of the shop {n} in the town") for n in range(50)], "store_id long, _quote string")
    texts = spark.createDataFrame([(1, n, "all of the shops and of the people in the town " * 40 + f"jan of the shop {n} in the town") for n in range(50)], "store_id long, page_no long, _text string")
    found = contacts.texts_with_quotes(quotes, texts, ["page_no"])
    assert found.distinct().count() == 50
    found.collect()

    def written(node):
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            node = node.executedPlan()
        if "QueryStage" in node.getClass().getSimpleName():
            return written(node.plan())
        own = node.metrics().get("numOutputRows" if "Broadcast" in node.getClass().getSimpleName() else "shuffleRecordsWritten")
        return (own.get().value() if "Exchange" in node.getClass().getSimpleName() and own.isDefined() else 0) + sum(written(node.children().apply(i)) for i in range(node.children().size()))

    assert 50 <= written(found._jdf.queryExecution().executedPlan()) < 1000
