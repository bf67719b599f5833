"""Pairs of many dimensions that lie across the edge of two lists."""

from __future__ import annotations

import numpy as np

from retailscope.llm import vectors


def test_pairs_across_list_edges_are_found(spark, monkeypatch):
    rng, dim = np.random.default_rng(7), 384

    def turned(degrees, spread):
        flat = np.zeros(dim)
        flat[0], flat[1] = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        return flat + rng.normal(size=dim) * spread

    lists = [turned(side, 0.02) for side in (-40, 40) for _ in range(150)]
    pairs = [turned(side, 0.0001) for _ in range(5) for side in (-8.6, 8.6)]
    points = np.array(lists + pairs)
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    near = unit @ unit.T >= vectors.COSINE
    np.fill_diagonal(near, False)
    assert near[300:310:2, 301:310:2].all() and 0.95 < unit[300] @ unit[301] < 0.96
    monkeypatch.setattr(vectors, "LIST_SIZE", 150)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.find_near_vectors(frame).collect()}
    assert [got[i] for i in range(len(points))] == near.sum(axis=1).tolist()
