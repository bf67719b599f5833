"""Collocations against counting every phrase, with good and bad samples and small buffers."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from retailscope.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n long, rank string, m string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["a", "b", "ça", "D", "e-f", "日", "x\x00y"]
    joins = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\r\n", "\x0b", "\u00a0"]
    made = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randint(0, 60)))
        made.append((i, text, rng.choice(["en", "en", "en", "fr", None, ""])))
    made += [(500, None, "en"), (501, "", "fr"), (None, " . , ", None), (None, "a b ça D " * 3000, "en"), (7, "New York City. " * 40, "en"), (7, "New York City. " * 40, "en")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "c", "c") for r in rows], DOCS).repartition(4).cache()


def held(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


@pytest.mark.parametrize(("share", "buffer"), [(0.0, 500_000), (0.3, 200), (1.0, 500_000)])
def test_any_sample_gives_the_same(docs, rows, share, buffer, monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER_WORDS", buffer)
    monkeypatch.setattr(phrases, "SLICE_BYTES", buffer)
    monkeypatch.setattr(phrases, "KNOWN_WORDS", 3)
    found = phrases.collocations(docs, min_count=5, top=40, share=share)
    assert held(found) == sorted(brute.collocations([(r[2], r[1]) for r in rows], 5, 40))


def test_a_full_bitmap_changes_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_BITS", 64)
    monkeypatch.setattr(phrases, "MAX_BITS", 64)
    assert held(phrases.collocations(docs, min_count=5, top=3)) == sorted(brute.collocations([(r[2], r[1]) for r in rows], 5, 3))


def test_no_documents(docs):
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("text is null")).count() == 0


def test_shared_hashes_are_told_apart():
    x = np.array([1, 2, 3, 2, 3, 1, 2, 3])
    at = np.arange(7)
    first, counts = phrases.distinct(x, np.zeros(7, dtype=np.uint64), at, 2)
    assert {(*x[p : p + 2], n) for p, n in zip(first, counts, strict=True)} == {(1, 2, 2), (2, 3, 3), (3, 2, 1), (3, 1, 1)}


def test_scores_pass_64_bits(spark):
    counts = [("en", 1, "a", 3_000_000_000_000), ("en", 1, "b", 1_000_003), ("en", 2, "a b", 1_000_001)]
    frequent = spark.createDataFrame(counts, "lang string, m int, phrase string, n long")
    totals = spark.createDataFrame([("en", 10**15 + 7)], "lang string, total long")
    found = phrases.score_phrases(frequent, totals).collect()[0]
    assert found["score"] == 1000 * 1_000_001 * (10**15 + 7) // (3_000_000_000_000 * 1_000_003)
