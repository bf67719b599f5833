"""Licence scans against comparing every place, and spans of damaged notices."""

from __future__ import annotations

import random

import brute
import pytest

from retailscope.llm import licences
from retailscope.llm.licences import Template
from retailscope.llm.queries import registry
from retailscope.session import table

DOCS = "doc_id long, text string, spans string, found string, cover string, n_words string"
MIT = next(t.text for t in licences.NOTICES if t.label == "mit" and len(t.text) > 200)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["all", "rights", "reserved", "cc", "by", "general", "public", "license", "the", "CC-BY", "é", "x"]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    made += [(100, None), (101, ""), (102, "..."), (103, "ALL  Rights\nReserved"), (104, "all rights reserved " * 3000), (105, "callçrights all rights"), (None, "cc by cc by"), (60, "cc by"), (60, "cc by")]
    made += [(106, "Intro. " + MIT + " Then more."), (107, "Released under the MIT License."), (108, MIT.replace("without restriction", "with no limit").replace("sublicense", "hand on"))]
    return made + [(109, "a " * 50 + MIT[: len(MIT) // 3])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], DOCS).repartition(3).cache()


def plain(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_whole"], r["first_word"], r["last_word"], ",".join(r["whole_labels"])) for r in found), key=repr)


@pytest.mark.parametrize(("part", "size"), [(50_000, 4_000_000), (60, 11)])
def test_places_of_whole_phrases(docs, rows, part, size, monkeypatch):
    want = licences.scan_licences(docs).collect()
    assert plain(want) == sorted(((i, *brute.phrase_places(t)) for i, t in rows), key=repr)
    monkeypatch.setattr(licences, "PART_WORDS", part)
    monkeypatch.setattr(licences, "SLICE_BYTES", size)
    assert sorted(map(str, licences.scan_licences(docs).collect())) == sorted(map(str, want))


def test_spans_of_notices(docs):
    found = {r["doc_id"]: r for r in licences.scan_licences(docs).where("doc_id > 105").collect()}
    whole, short, changed, third = (found[i] for i in (106, 107, 108, 109))
    assert [(s["label"], s["first_word"], s["cover"]) for s in whole["spans"]] == [("mit", 1, 1.0)] and whole["cover"] == 1.0
    assert [(s["label"], s["first_word"], s["last_word"]) for s in short["spans"]] == [("mit", 1, 4)]
    assert [s["label"] for s in changed["spans"]] == ["mit"] and 0.8 < changed["cover"] < 1.0
    assert third["spans"] == [] and third["cover"] == 0.0


def test_the_fuller_of_two_versions(spark):
    docs = spark.createDataFrame([(1, "x. This work is licensed under the GNU General Public License, version 2. y")], "doc_id long, text string")
    found = licences.scan_licences(docs).collect()[0]
    assert [(s["label"], s["first_word"], s["last_word"]) for s in found["spans"]] == [("gpl-2.0", 1, 12)] and found["whole_labels"] == ["gpl"]


def test_matching_statistics():
    rng = random.Random(8)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        automaton = licences.Automaton(sequences, [False] * 4)
        words = [rng.randrange(4) for _ in range(30)]
        each = [brute.longest_runs(words, s) for s in sequences]
        got = list(automaton.read(words))
        assert [n for _, n in got] == [max(at) for at in zip(*each, strict=True)]
        for i, (state, length) in enumerate(got):
            if length >= licences.MIN_MATCH:
                held = {t: min(length, most) for t, most, _ in automaton.longest[state]}
                assert held == {t: each[t][i] for t in range(4) if each[t][i] >= licences.MIN_MATCH}
                for t, _, of in automaton.longest[state]:
                    assert all(sequences[t][p - held[t] : p] == words[i + 1 - held[t] : i + 1] for p in automaton.places[of][t])


def test_no_documents_and_no_templates(docs, rows):
    assert licences.scan_licences(docs.where("false")).count() == 0
    found = licences.scan_licences(docs, ()).collect()
    assert len(found) == len(rows) and all(r["n_whole"] == 0 and r["spans"] == [] and r["cover"] == 0.0 for r in found)
    one = licences.scan_licences(docs, (Template("c", "CC", True),)).where("doc_id = 60").collect()
    assert [(r["n_whole"], r["first_word"]) for r in one] == [(1, 0), (1, 0)]


def test_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    found = registry.queries["op11_license_scans"].build(spark, sf_dir).collect()
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted((i, *brute.phrase_places(t)) for i, t in rows)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
