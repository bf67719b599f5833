"""Embedding near-copies: inverted lists, product-quantised residuals, table-lookup distances, exact cosines.

Every vector is indexed in the list of its nearest centroid, with the codes of its residual's subspaces and the norm of
what the codes leave over. A query looks into every list whose edge lies within half its radius, so that of every pair
one finds the other, sums looked-up squares per code, and keeps what may lie within the radius, given each vector's own coding error; so the filter loses
nothing. What is kept is decided by cosine in double precision. Pairs are counted and joined where they are found and
never leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retailscope.llm.common import map_arrow, stored, to_batch
from retailscope.llm.components import connect
from retailscope.session import cut_lineage

COSINE = 0.95
#: The index is fitted on about this many vectors, chosen by hash.
FIT_VECTORS = 16_384
#: Vectors per list aimed at; lists at most; subspaces and codes of each.
LIST_SIZE, MAX_LISTS, SUBSPACES, CODES = 200, 4096, 8, 64
#: A list is probed if its edge lies within this part of the radius. The distances of two vectors of a pair to the edge
#: between their lists add up to at most the radius, so one of the two finds the other, whatever the dimension.
REACH = 0.5
#: Vectors of a list, and queries to it, that meet in one task; larger lists are cut into tiles.
TILE, STEP = 2048, 128
CODED = "id long, n long, cell int, probes array<int>, codes binary, error double, vector binary"
TILES = "list int, part int, side int, asks boolean, id long, n long, cell int, probes array<int>, codes binary, error double, vector binary"
FOUND = "id long, root long, links long"


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def fit(sample: np.ndarray, n: int) -> dict:
    """Centroids and codebooks from unit vectors; ``n`` vectors will be indexed."""
    lists = int(np.clip(n // LIST_SIZE, 1, min(MAX_LISTS, len(sample))))
    centres = k_means(sample, lists, 8, 1)
    rest = sample - centres[np.argmax(sample @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)]
    cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
    return {"centres": centres, "cuts": cuts, "books": [k_means(rest[:, c], CODES, 6, 2) for c in cuts]}


def place(index: dict, unit: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """List, lists to probe, codes and coding error of unit vectors."""
    centres = index["centres"]
    apart = (centres**2).sum(axis=1) - 2 * unit @ centres.T
    cell = np.argmin(apart, axis=1)
    if "between" not in index:
        size = (centres**2).sum(axis=1)
        index["between"] = np.sqrt(np.maximum(0, size[:, None] + size - 2 * centres @ centres.T))
    between = index["between"]
    reach = radius * REACH
    rows = np.arange(len(unit))
    probed = apart - apart[rows, cell][:, None] <= 2 * reach * between[cell] + 1e-12
    rest = unit - centres[cell]
    codes = np.zeros((len(unit), len(index["cuts"])), dtype=np.uint8)
    for m, (cut, book) in enumerate(zip(index["cuts"], index["books"], strict=True)):
        codes[:, m] = np.argmin((book**2).sum(axis=1) - 2 * rest[:, cut] @ book.T, axis=1)
        rest[:, cut] -= book[codes[:, m]]
    return cell, [np.flatnonzero(p) for p in probed], codes, np.sqrt((rest**2).sum(axis=1))


def merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest member) after joining a[i] with b[i]."""
    while len(a):
        low, high = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(roots, high[open_], low[open_])
        while (shorter := roots[roots]).tolist() != roots.tolist():
            roots = shorter
    return roots


def match_tile(index: dict, cell: int, asks: dict, held: dict, cosine: float, radius: float) -> dict:
    """Links between queries and vectors of a list: each id's root among those here and its number of links.

    A pair that both lists would find is counted in one of them only.
    """
    ids = np.unique(np.concatenate((asks["id"], held["id"])))
    at_ask, at_held = np.searchsorted(ids, asks["id"]), np.searchsorted(ids, held["id"])
    roots, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    moved = asks["unit"] - index["centres"][cell]
    for start in range(0, len(at_ask), STEP):
        own = slice(start, start + STEP)
        apart = np.zeros((len(at_ask[own]), len(at_held)))
        for m, (cut, book) in enumerate(zip(index["cuts"], index["books"], strict=True)):
            table = ((moved[own][:, None, cut] - book[None]) ** 2).sum(axis=2)
            apart += table[:, held["codes"][:, m]]
        q, x = np.nonzero(apart <= (radius + held["error"] + 1e-9)[None] ** 2)
        q += start
        same = asks["cell"][q] == cell
        keep = np.where(same, asks["id"][q] < held["id"][x], ~held["sees"][x, asks["cell"][q]] | (asks["cell"][q] > cell))
        q, x = q[keep], x[keep]
        if len(q) > 0.05 * apart.size:
            near = (asks["unit"][own] @ held["unit"].T)[q - start, x] >= cosine
        else:
            near = np.zeros(len(q), dtype=bool)
            for i in range(0, len(q), 20_000):
                part = slice(i, i + 20_000)
                near[part] = np.einsum("ij,ij->i", asks["unit"][q[part]], held["unit"][x[part]]) >= cosine
        q, x = q[near], x[near]
        np.add.at(links, at_ask[q], held["n"][x])
        np.add.at(links, at_held[x], asks["n"][q])
        roots = merge(roots, at_ask[q], at_held[x])
    some = links > 0
    return {"id": ids[some], "root": ids[roots[some]], "links": links[some]}


def _link_size(classes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Partial links of the classes of one dimension, sent as numbers of ``kind``: ``id``, ``root``, ``links``."""
    spark = classes.sparkSession
    n = classes.count()
    share = min(1.0, FIT_VECTORS / max(1, n))
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < round(share * 1_000_000)).select("vector").toArrow()
    if not sample.num_rows:
        sample = classes.select("vector").limit(FIT_VECTORS).toArrow()
    shared = spark.sparkContext.broadcast(fit(scaled(numbers(sample.column("vector"))), n))
    radius = float(np.sqrt(2 - 2 * cosine))
    tiles_schema, found_schema = (to_arrow_schema(spark.createDataFrame([], s).schema) for s in (TILES, FOUND))

    def code(batch: pa.RecordBatch) -> dict:
        raw = numbers(batch.column("vector"))
        cell, probes, codes, error = place(shared.value, scaled(raw), radius)
        return {"id": batch.column("id"), "n": batch.column("n"), "cell": cell, "probes": probes, "codes": _cells(codes), "error": error, "vector": _cells(raw.astype(kind))}

    coded = stored(map_arrow(classes.select("id", "n", "vector"), code, CODED), "coded")
    held = {r[0]: r[1] for r in coded.groupBy("cell").count().collect()}
    asked = {r[0]: r[1] for r in coded.select(F.explode("probes").alias("list")).groupBy("list").count().collect()}
    parts = {c: (-(-held.get(c, 0) // TILE), -(-asked.get(c, 0) // TILE)) for c in held.keys() | asked.keys()}

    held_parts, asked_parts = (np.array([parts.get(c, (0, 0))[i] for c in range(MAX_LISTS + 1)]) for i in (0, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to every tile of its list, as a query to every tile of the lists it probes."""
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                lists_of = some.column("probes")
                per_row = pa.compute.list_value_length(lists_of).to_numpy()
                rows = np.concatenate((np.arange(some.num_rows), np.repeat(np.arange(some.num_rows), per_row)))
                lists = np.concatenate((some.column("cell").to_numpy(), lists_of.flatten().to_numpy()))
                asks = np.arange(len(rows)) >= some.num_rows
                own, others = np.where(asks, asked_parts[lists], held_parts[lists]), np.where(asks, held_parts[lists], asked_parts[lists])
                mine = (some.column("id").to_numpy()[rows] * 2654435761 >> 7) % np.maximum(own, 1)
                copies = np.where(own > 0, others, 0)
                nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                rows, lists, asks, mine = (np.repeat(x, copies) for x in (rows, lists, asks, mine))
                kept = some.take(pa.array(rows))
                none = pa.array(asks)
                columns = {name: kept.column(name) for name in ("id", "n", "cell", "vector")}
                columns |= {name: pa.compute.if_else(none, pa.scalar(None, kept.column(name).type), kept.column(name)) for name in ("probes", "codes", "error")}
                yield to_batch(columns | {"list": lists, "part": np.where(asks, nth, mine), "side": np.where(asks, mine, nth), "asks": asks}, tiles_schema)

    def match(table: pa.Table) -> pa.Table:
        index = shared.value
        cell = table.column("list")[0].as_py()
        sides = []
        for ask in (True, False):
            rows = table.filter(pa.compute.equal(table.column("asks"), ask))
            side = {c: rows.column(c).to_numpy() for c in ("id", "n", "cell")}
            raw = np.frombuffer(b"".join(rows.column("vector").to_pylist()), dtype=kind)
            side["unit"] = scaled(raw.reshape(rows.num_rows, -1).astype(np.float64)) if rows.num_rows else raw
            if not ask and rows.num_rows:
                side["error"] = rows.column("error").to_numpy()
                side["codes"] = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
                side["sees"] = np.zeros((rows.num_rows, len(index["centres"])), dtype=bool)
                for n, lists in enumerate(rows.column("probes").to_pylist()):
                    side["sees"][n, lists] = True
            sides.append(side)
        empty = {name: [] for name in ("id", "root", "links")}
        found = match_tile(index, cell, *sides, cosine, radius) if all(len(s["id"]) for s in sides) else empty
        return pa.Table.from_batches([to_batch(found, found_schema)])

    return coded.mapInArrow(deal, TILES).groupBy("list", "part", "side").applyInArrow(match, FOUND)


def _cells(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    edges = pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, edges, pa.py_buffer(raw.tobytes())])


def numbers(column) -> np.ndarray:
    """Vectors of one size as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def scaled(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    return values / np.sqrt((values**2).sum(axis=1))[:, None]


def find_near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Every row of ``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    vectors: ``vec_id`` long and ``embedding``, an array of numbers; other columns are not read. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without vec_id, link with nothing and are their own
    component. Equal vectors are one class, indexed once, however many rows hold them. Vectors of different sizes never
    link. A vec_id that occurs with several vectors counts as one vector that links where any of them does.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.xxhash64("embedding").alias("key"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = cut_lineage(rows.where("usable").groupBy("key", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    sizes = [r[0] for r in classes.select(F.size("vector").alias("size")).distinct().collect()]
    found = None
    for size in sizes:
        part = _link_size(classes.where(F.size("vector") == size), cosine, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found)
    labels = connect(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    placed = classes.select("key", "vector", "id", "n").join(degrees, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("key", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("label", "id").alias("label"))
    linked = rows.where("usable").join(placed, ["key", "vector"]).select("vec_id", F.col("links").alias("n_links"), F.col("label").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
