"""Status changes against a plain loop over each entity's history."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from retailscope.operators import states

CHANGES = "id long, to_status string, seq long, changed_at timestamp, note string"
ENTITIES = "id long, status string, status_reason string, finished_at timestamp"
START = dt.datetime(2024, 1, 1)


def looped(entities, changes, kind):
    table = {i: [status, reason, done] for i, status, reason, done in entities}
    refused = []
    for i, to, seq, at, note in sorted(changes, key=lambda c: (c[2], c[1] or "")):
        if i not in table:
            refused.append((i, seq, None, to, "not found"))
            continue
        row = table[i]
        if to in states.TRANSITIONS[kind].get(row[0], ()) or (kind != "decision" and to is not None and to == row[0]):
            row[0], row[1] = to, row[1] if note is None else note
            if to in states.FINISHED:
                row[2] = at
        else:
            refused.append((i, seq, row[0], to, "illegal"))
    return sorted(((i, *row) for i, row in table.items()), key=repr), sorted(refused, key=repr)


@pytest.mark.parametrize(("kind", "block"), [("store", 256), ("store", 7), ("audit", 5), ("decision", 3)])
def test_long_histories_equal_a_loop(spark, monkeypatch, kind, block):
    monkeypatch.setattr(states, "BLOCK", block)
    monkeypatch.setattr(states, "FAN", block)
    rng, names = random.Random(kind + str(block)), list(states.TRANSITIONS[kind])
    entities = [(i, rng.choice(names), rng.choice([None, "old"]), None) for i in range(12)] + [(50, "ODD", None, START), (51, None, None, None)]
    sizes = {1: 1000, 2: 40, 3: 0, 50: 9, 51: 4, 77: 30}
    changes = []
    for i in (*range(12), 50, 51, 77):
        for n in range(sizes.get(i, rng.randint(0, 6))):
            changes.append((i, rng.choice([*names, "ODD", None]), n * (1000 if i == 2 else 1), START + dt.timedelta(minutes=n), rng.choice([None, f"n{n}"])))
    changes.append((None, names[0], 1, START, None))
    asked = spark.createDataFrame(changes, CHANGES).repartition(3)
    updated, refused = states.apply_status_changes(spark.createDataFrame(entities, ENTITIES), asked, kind, "status_reason")
    want = looped(entities, changes, kind)
    assert updated.columns == ["id", "status", "status_reason", "finished_at"]
    assert sorted(map(tuple, updated.collect()), key=repr) == want[0]
    assert sorted(map(tuple, refused.collect()), key=repr) == want[1]


def test_no_changes(spark):
    entities = spark.createDataFrame([(1, "NEW", "x", None)], ENTITIES)
    updated, refused = states.apply_status_changes(entities, spark.createDataFrame([], CHANGES), "store")
    assert [tuple(r) for r in updated.collect()] == [(1, "NEW", "x", None)] and refused.count() == 0
