"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Texts are scanned once. A-Z are lower-cased and every ASCII byte that is no letter or digit becomes a
space; the mapping is byte for byte, so offsets hold in the original text.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import map_arrow, stored

WINDOW = 10
#: Bytes of windows that one automaton holds, which takes some 50 times as much while it is built; larger benchmarks are
#: scanned for in several parts, packed of so many cells each.
PART_BYTES, CELLS_A_PART = 8_000_000, 16
_TO_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32
    for c in range(256)
)
SCHEMA = (
    "_row long, n_words long, hit_words array<struct<first:long,last:long>>, "
    "spans array<struct<start:long,end:long>>, items array<string>"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def windows_of(text: bytes, size: int = WINDOW) -> set[bytes]:
    """All runs of ``size`` words; an item of fewer words, but not none, is one window."""
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def build_automaton(items: list[tuple[str, bytes]], size: int) -> ahocorasick.Automaton | None:
    """Windows between spaces, so that matches begin and end at word edges."""
    holders: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows_of(text, size):
            holders.setdefault(window, set()).add(item)
    if not holders:
        return None
    automaton = ahocorasick.Automaton()
    for window, who in holders.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (len(window), window.count(b" ") + 1, tuple(who)))
    automaton.make_automaton()
    return automaton


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set cells."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2], edges[1::2] - 1


def find_hits(text: bytes, words: list[bytes], automaton) -> tuple[list, list, list] | None:
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(automaton.iter(flat))
    if not hits:
        return None
    starts = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    items: set[str] = set()
    at = np.searchsorted(starts, [end - length for end, (length, _, _) in hits])
    for first, (_, (_, count, who)) in zip(at, hits, strict=True):
        mark[first] += 1
        mark[first + count] -= 1
        items.update(who)
    first, last = _runs(np.cumsum(mark)[:-1] > 0)
    raw = np.frombuffer(text, dtype=np.uint8)
    left, right = _runs(np.frombuffer(text.translate(_TO_WORDS), dtype=np.uint8) != 32)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    spans = [{"start": int(s), "end": int(e)} for s, e in zip(chars[left[first]], chars[right[last] + 1], strict=True)]
    return [{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)], spans, sorted(items)


def _scan_part(rows: DataFrame, items: list[tuple[str, bytes]], size: int, with_text: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast({"items": items})

    def step(batch: pa.RecordBatch) -> dict:
        held = shared.value
        if "automaton" not in held:
            held["automaton"] = build_automaton(held["items"], size)
        automaton = held["automaton"]
        counts, hit_words, spans, who = [], [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text or b"")
            found = find_hits(text, words, automaton) if words and automaton is not None else None
            counts.append(len(words))
            for out, value in zip((hit_words, spans, who), found or ([], [], []), strict=True):
                out.append(value)
        keys = {name: batch.column(name) for name in batch.schema.names if name != "text" or with_text}
        return keys | {"n_words": counts, "hit_words": hit_words, "spans": spans, "items": who}

    key_type = dict(rows.dtypes)["_key"]
    return map_arrow(rows, step, SCHEMA.replace("_row long", f"_key {key_type}{', text binary' if with_text else ''}"))


def pack_cells(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring cells, each of at most ``most`` bytes or of one cell."""
    ranges: list[tuple[int, int]] = []
    held = 0
    for cell in sorted(sizes):
        if ranges and held + sizes[cell] <= most:
            ranges[-1], held = (ranges[-1][0], cell), held + sizes[cell]
        else:
            ranges.append((cell, cell))
            held = sizes[cell]
    return ranges


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Every document with its benchmark hits.

    docs: ``text`` and the columns named in ``carry``; benchmark: ``item_id``, ``text``. Other columns are not read.
    Returns the carried columns (and the text, if asked for), ``n_words``, ``n_hit`` (words inside a window's occurrence), ``items`` (ids as sorted
    strings), ``spans`` (hit runs as character offsets of the original text).

    Null or wordless texts have no words and no hits; null or wordless items have no window; an item without id counts
    as item ''. Repeated documents are judged row by row, repeated item ids count once. An empty benchmark hits nothing.
    The benchmark is gathered in parts whose windows have at most ``part_bytes`` together (or one item), each scanned with
    its own automaton. Several parts are scanned and stored one after another, and a document's hits are merged by row.
    """
    listed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    listed = listed.distinct().withColumn("bytes", (F.octet_length("text") + 1) * F.lit(size).cast("long"))
    total = listed.agg(F.sum("bytes")).head()[0] or 0
    cells = CELLS_A_PART * -(-total // part_bytes) if total > part_bytes else 1
    listed = listed.withColumn("cell", F.pmod(F.xxhash64("item", "text"), F.lit(cells)))
    sizes = {r["cell"]: r["bytes"] for r in listed.groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()} if cells > 1 else {}
    parts = pack_cells(sizes, part_bytes) or [(0, cells - 1)]
    rows = docs.select(F.struct(*carry).alias("_key"), F.col("text").cast("binary").alias("text"))
    if len(parts) > 1:
        rows = stored(rows.withColumn("_key", F.struct(F.monotonically_increasing_id().alias("_row"), F.col("_key").alias("_in"))), "numbered")
    found = None
    for low, high in parts:
        items = [(r["item"], bytes(r["text"])) for r in listed.where(F.col("cell").between(low, high)).select("item", "text").collect()]
        first = found is None
        more = _scan_part(rows, items, size, with_text and first)
        if len(parts) > 1:
            more = more.select(F.col("_key._row").alias("_row"), *[c for c in more.columns if c != "_key"], *([F.col("_key._in").alias("_in")] if first else []))
            more = stored(more if first else more.where(F.size("hit_words") > 0), "scanned")
        found = more if first else found.unionByName(more, allowMissingColumns=True)
    if len(parts) > 1:
        found = found.groupBy("_row").agg(
            F.any_value("_in", True).alias("_key"),
            F.max("n_words").alias("n_words"),
            *([F.any_value("text", True).alias("text")] if with_text else []),
            F.flatten(F.collect_list("hit_words")).alias("hit_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = found.withColumn("hit_words", _merged("hit_words", "first", "last", 1)).withColumn("spans", _merged("spans", "start", "end", 0))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    text = [F.col("text").cast("string").alias("text")] if with_text else []
    return found.select(*[F.col(f"_key.{c}").alias(c) for c in carry], *text, "n_words", n_hit.alias("n_hit"), "items", "spans")


def _merged(name: str, low: str, high: str, gap: int):
    """Overlapping intervals joined, by one pass over the sorted list."""
    kind = f"array<struct<{low}:long,{high}:long>>"

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last[low].alias(low), F.greatest(last[high], x[high]).alias(high))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        return F.when((F.size(done) > 0) & (x[low] <= last[high] + gap), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(name), F.array().cast(kind), add)
