"""Conversation repair against exhaustive search and a plain table."""

from __future__ import annotations

import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F

from retailscope.llm import conversations
from retailscope.llm.queries import registry
from retailscope.session import table

TURNS = "conv_id long, turn long, role string, text string, audit string, piece string, part string"


@pytest.fixture(scope="module")
def messy():
    """Nulls in every column, empty and long texts, ties, repeats, a long conversation and one of equal rows."""
    rng = random.Random(11)
    texts = ["", " \n", "Yes.", "No", "What?", "x" * 5000 + ".", None, "é日", "Yes. ", "a", "b!", "c"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(77, t, ["user", "assistant"][t % 2] if rng.random() < 0.8 else "system", f"turn {t}" + rng.choice(["", ".", "?"])) for t in range(400)]
    rows += [(78, 1, "user", "the same.")] * 120 + [(78, None, "assistant", "first")]
    rows += [(None, 1, "user", "lost."), (None, 2, "assistant", "too."), (5, None, "user", "early."), (5, 1, "user", "tie"), (5, 1, "user", "tie")]
    rows += [(79, t, None, None) for t in range(3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], TURNS)


def folded(found):
    return sorted((tuple(r) for r in conversations.fold_pieces(found).collect()), key=repr)


def wanted(held):
    return sorted(((c, *brute.repaired(rows)) for c, rows in held.items()), key=repr)


def test_edits_are_the_cheapest_and_least():
    rows = conversations.Rows()
    kinds = [(i, cut) for i in ("s", "u", "a", "") for cut in (False, True)] + [(None, False)]
    for size in range(3):
        for picked in itertools.product(kinds, repeat=size):
            classes = bytes(conversations.GONE if i is None else conversations.class_of(i, cut) for i, cut in picked)
            leave = rows.leave(classes)
            letters = rows.solve(classes, conversations.START, leave) + conversations.ENDING[leave][1]
            cost, _, _ = conversations.replay(classes, letters, conversations.START, [i or "" for i, _ in picked], [b""] * size)
            want = brute.all_edits([i or "" for i, _ in picked], [i is None for i, _ in picked], [cut for _, cut in picked])
            assert (cost, letters) == want, picked


def test_pieces_meet_as_rows_do():
    rng, rows = random.Random(3), conversations.Rows()
    for _ in range(200):
        kinds = bytes(rng.randrange(9) for _ in range(rng.randint(1, 60)))
        edges = sorted({0, len(kinds), *(rng.randrange(len(kinds) + 1) for _ in range(5))})
        parts = [kinds[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)] + [b""]
        leaves = conversations.solve_pieces([rows.summary(p) for p in parts])
        letters = "".join(rows.solve(p, e, q) for p, e, q in zip(parts, [conversations.START, *leaves], leaves, strict=False))
        leave = rows.leave(kinds)
        assert leaves[-1] == leave and letters == rows.solve(kinds, conversations.START, leave)


@pytest.mark.parametrize("piece_rows", [7, 20_000])
def test_repair_of_messy_rows(spark, messy, piece_rows):
    held = {}
    for conv, turn, role, text in messy:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for rows in held.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], brute.sha(str(len(r[1].encode())).encode() + b" " + (r[1] + r[2]).encode())))
    assert folded(conversations.repair_conversations(frame(spark, messy).repartition(5), piece_rows)) == wanted(held)


def test_repair_of_damaged_rows(spark, messy):
    found = conversations.repair_conversations(conversations.damage_turns(frame(spark, messy)), 9)
    assert folded(found) == wanted(brute.damaged(messy))
    pieces = found.where("conv_id = 77").orderBy("piece").collect()
    assert len(pieces) > 5 and [r["piece"] for r in pieces] == list(range(len(pieces)))


def test_no_rows(spark, messy):
    none = frame(spark, messy).where("false")
    assert folded(conversations.repair_conversations(none)) == []
    absent = frame(spark, messy).withColumn("present", F.lit(False))
    found = folded(conversations.repair_conversations(absent))
    assert len(found) == 44 and {r[1:] for r in found} == {(0, 0, 0, 0, 0, 0, "", brute.sha(b""))}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = registry.queries["op13_conversation_repair"].build(spark, sf_dir)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == wanted(brute.damaged(rows))
