"""SimHash near-copies by the generalised pigeonhole principle.

The 64 bits are grouped into parts of correlated bits. Two fingerprints that differ in at most t bits differ in at most
t_i bits of some part i if the t_i + 1 add up to t + 1, so thresholds may be unequal: dynamic programming allots them by
the candidates each part is expected to yield. A fingerprint probes, for each part, all values within the part's
threshold; candidates are verified inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from retailscope.llm.common import map_arrow, stored, to_batch
from retailscope.llm.components import connect
from retailscope.session import cut_lineage

WORDS, DISTANCE, SEED = 4, 4, 42
#: Cost of shuffling a probe against that of verifying a candidate.
PROBE_COST = 3.0
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' XXH64."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest, flat = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t or b"", size) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), step, "doc_id long, fp long")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """Every pattern of at most ``threshold`` flipped bits of the part."""
        return [sum(1 << b for b in chosen) for n in range(self.threshold + 1) for chosen in combinations(self.bits, n)]


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often two bits are set together, over all of them."""
    schema = "row int, counts array<long>"
    target = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 64), dtype=np.int64)
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total[:64] += (bits.T @ bits).astype(np.int64)
            total[64, 0] += len(fps)
        yield to_batch({"row": np.arange(65), "counts": list(total)}, target)

    partial = nodes.select("fp").mapInArrow(run, schema).select("row", F.posexplode("counts").alias("col", "n"))
    out = np.zeros((65, 64))
    for row in partial.groupBy("row", "col").agg(F.sum("n").alias("n")).collect():
        out[row["row"], row["col"]] = row["n"]
    return int(out[64, 0]), out[:64]


def group_bits(n: int, together: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Parts of about equal width, each grown from the least balanced free bit by the bits most correlated with it."""
    share = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs(together / max(1, n) - np.outer(share, share)) / np.outer(spread, spread)
    free, groups = list(range(64)), []
    for left in range(parts, 0, -1):
        width = -(-len(free) // left)
        group = [min(free, key=lambda b: (spread[b], b))]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: (correlation[b, group].mean(), -b)))
            free.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def expected_share(bits: tuple[int, ...], share: np.ndarray) -> np.ndarray:
    """Chance that two fingerprints differ in at most t bits of the part, for every t."""
    chance = np.array([1.0])
    for b in bits:
        differ = 2 * share[b] * (1 - share[b])
        chance = np.convolve(chance, [1 - differ, differ])
    return np.cumsum(chance)


def allot(groups: list[tuple[int, ...]], n: int, share: np.ndarray, distance: int) -> tuple[float, list[int]]:
    """Least expected cost of a fingerprint, and the thresholds that give it (-1: the part is not probed)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        likely = expected_share(bits, share)
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(distance - used, len(bits)) + 1):
                probes = sum(comb(len(bits), k) for k in range(t + 1))
                more = cost + (probes * PROBE_COST + n * likely[t] if t >= 0 else 0.0)
                key = used + t + 1
                if key not in grown or more < grown[key][0]:
                    grown[key] = (more, [*chosen, t])
        best = grown
    return best[distance + 1]


def plan_parts(n: int, together: np.ndarray, distance: int = DISTANCE) -> list[Part]:
    share = np.diag(together) / max(1, n)
    plans = []
    for parts in range(2, distance + 2):
        groups = group_bits(n, together, parts)
        cost, thresholds = allot(groups, n, share, distance)
        plans.append((cost, [Part(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def link_fingerprints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a`` < ``b`` of the distinct ``fp`` in nodes that differ in at most ``distance`` bits, some repeated."""
    parts = plan_parts(*bit_statistics(nodes), distance)
    probes = index = None
    for n, part in enumerate(parts):
        cut = F.col("fp").bitwiseAND(F.lit(_signed(part.mask)))
        flips = F.array(*[F.lit(_signed(f)) for f in part.flips()])
        asked = nodes.select(F.lit(n).alias("part"), F.col("fp").alias("a"), cut.alias("own"), F.explode(flips).alias("flip"))
        asked = asked.select("part", "a", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
        held = nodes.select(F.lit(n).alias("part"), F.col("fp").alias("b"), cut.alias("key"))
        probes, index = (asked, held) if probes is None else (probes.unionByName(asked), index.unionByName(held))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    joined = probes.join(index, (probes["part"] == index["part"]) & (probes["key"] == index["key"]) & near)
    return joined.select("a", "b")


def label_fingerprints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp`` and ``first`` of nodes with the smallest fingerprint that links lead to, its own included, as ``label``."""
    labels = connect(link_fingerprints(nodes, distance))
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def find_near_copies(docs: DataFrame, distance: int = DISTANCE, size: int = WORDS) -> DataFrame:
    """Every document with its ``fp`` and ``component_id``, the smallest doc_id that links lead to, its own included.

    docs: ``doc_id`` long, ``text``; other columns are not read. Null and wordless texts have fingerprint zero and link
    like any other; texts of fewer words than a shingle are one shingle. Copies share a fingerprint, so only distinct
    fingerprints are linked, however many documents hold them. A null doc_id never is a component's id unless all are
    null. An empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs, size))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    grouped = label_fingerprints(nodes, distance)
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    placed = grouped.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return rows.join(placed, "fp").select("doc_id", "fp", "component_id")


def keep_first_copies(docs: DataFrame, distance: int = DISTANCE, size: int = WORDS) -> DataFrame:
    """One row, unchanged, of every component that ``find_near_copies`` finds.

    It is the row with the smallest doc_id, a null one being larger than any other. Of several such rows it is the one with
    the smallest fingerprint, then the smallest hash of the text and of the other columns; rows that agree in all are one.
    So a component keeps a row even if all its ids are null, rows that repeat an id and a text leave one, and a doc_id that
    holds texts of several components is judged in each of them.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), rest.alias("rest"))
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("_kept"), order.alias("_order"))
    target = StructType([*rows.schema.fields, StructField("fp", LongType())])

    def step(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"", size) for t in texts], dtype=np.uint64)
        return {name: batch.column(name) for name in batch.schema.names} | {"fp": found.view(np.int64)}

    found = map_arrow(rows, step, target).groupBy("fp").agg(F.min_by(F.struct("doc_id", "text", "_kept"), "_order").alias("row"))
    found = stored(found.select("fp", F.col("row.doc_id").alias("first"), F.col("row.text").alias("text"), F.col("row._kept").alias("_kept")), "fingerprints")
    nodes = cut_lineage(found.select("fp", "first"))
    winners = label_fingerprints(nodes, distance).groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("w"))
    kept = found.join(winners.select(F.col("w.fp").alias("fp")), "fp", "left_semi")
    own = {"doc_id": F.col("first"), "text": F.col("text")}
    return kept.select(*[(own[c] if c in own else F.col("_kept")[c]).alias(c) for c in docs.columns])
