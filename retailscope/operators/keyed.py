"""Per-key rows, ranks and running values that survive hot keys.

A row_number filter of at most k is cut to k rows per key in every map task
before the shuffle (WindowGroupLimit), so a hot key stays cheap there. Ranks
without a bound are worked out slice by slice instead: a key is split along its
own order into slices, each slice is numbered by its own task, and only the
slice sizes are summed per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows per key up to which Spark limits a window before the shuffle, and parts a key is cut in beyond that.
MAP_SIDE_ROWS, PARTS = 1000, 64
#: A row in how many is looked at for slices, the most kept of a key, and how many of them make a slice.
SAMPLE_RATE, SAMPLE_ROWS, SAMPLE_STEP = 64, 65_536, 64
#: Cuts of a key looked up together, and copies of a key's cuts that its rows are dealt over.
CUT_BLOCK, SALTS = 32, 16
#: Bits of the array that tells which rows may have a wanted hash, at most (16 MB).
HASH_BITS = 1 << 27


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key in the given order.

    Spark cuts small ``k`` in every map task. For a larger one each key is first cut to ``k`` rows in each of its parts,
    so no task meets more than ``k`` times ``PARTS`` rows of a key.
    """
    name = rank or "_rank"
    if k > MAP_SIDE_ROWS:
        part = W.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
        df = df.withColumn(name, F.row_number().over(part)).filter(F.col(name) <= k).drop(name, "_part")
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key: greatest order columns win."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def _sliced(df: DataFrame, keys: Sequence[str], slice_by: Column) -> DataFrame:
    """Rows with their slice as one struct ``_at``; structs compare equal where their fields are both null, so windows
    and the join below share one partitioning of the rows."""
    return df.withColumn("_slice", slice_by).withColumn("_at", F.struct(*keys, "_slice"))


def _before(sizes: DataFrame, keys: Sequence[str], value: Column, name: str, descending: bool = False) -> DataFrame:
    """A value over the slices before each slice of a key; there is a row per slice."""
    along = F.col("_at._slice").desc() if descending else F.col("_at._slice").asc()
    window = W.partitionBy(*[F.col(f"_at.{k}") for k in keys]).orderBy(along)
    return sizes.select("_at", value.over(window if name == "_carry" else window.rowsBetween(W.unboundedPreceding, -1)).alias(name))


def even_slices(
    df: DataFrame,
    keys: Sequence[str],
    along: Sequence[Column],
    name: str = "_slice",
    rate: int = SAMPLE_RATE,
    step: int = SAMPLE_STEP,
) -> DataFrame:
    """Adds a number that cuts every large key into even slices along ascending columns, whatever their values are.

    The cuts of a key are quantiles of a sample of its rows, picked by a hash of ``along`` and so the same each time the
    plan runs. A slice holds about ``rate * step`` rows; a key has at most ``SAMPLE_ROWS / step`` slices, beyond which
    they grow evenly. Rows alike in all of ``along`` share a slice; nulls come first. The sample decides sizes only,
    every row gets its slice.
    """
    rows = df.withColumn("_even_key", F.struct(F.lit(0).alias("_"), *keys)).withColumn("_even_along", F.struct(*[a.alias(f"c{i}") for i, a in enumerate(along)]))
    rows = rows.withColumn("_even_hash", F.xxhash64("_even_along"))
    picked = rows.select("_even_key", "_even_along", "_even_hash").filter(F.pmod("_even_hash", F.lit(rate)) == 0)
    kept = first_per_key(picked, ["_even_key"], [F.col("_even_hash"), F.col("_even_along")], SAMPLE_ROWS)
    ranked = kept.withColumn("_even_no", F.row_number().over(W.partitionBy("_even_key").orderBy("_even_along")))
    cuts = ranked.filter(F.col("_even_no") % step == 0).groupBy("_even_key").agg(F.array_sort(F.collect_set("_even_along")).alias("_even_cuts"))
    heads = F.filter("_even_cuts", lambda c, i: i % CUT_BLOCK == 0)
    salted = cuts.select("_even_key", "_even_cuts", heads.alias("_even_heads"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_even_salt"))
    met = rows.withColumn("_even_salt", F.pmod(F.xxhash64("_even_hash"), F.lit(SALTS)).cast("int")).join(salted, ["_even_key", "_even_salt"], "left")
    passed = lambda cut: cut <= F.col("_even_along")
    start = (F.size(F.filter("_even_heads", passed)) - 1) * CUT_BLOCK
    within = F.size(F.filter(F.slice("_even_cuts", F.col("_even_start") + 1, F.lit(CUT_BLOCK)), passed))
    found = met.withColumn("_even_start", start).withColumn(name, F.when(F.col("_even_start") >= 0, F.col("_even_start") + within).otherwise(F.lit(0)))
    return found.drop("_even_key", "_even_along", "_even_hash", "_even_salt", "_even_cuts", "_even_heads", "_even_start")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column | None = None,
    name: str = "row_no",
    descending: bool = False,
) -> DataFrame:
    """1-based position of every row within its key, for keys of any size.

    ``slice_by`` must not decrease along ``order`` (not increase, when
    ``descending``): a day of the time ordered by, or a range of the id. Without
    it ``order`` must be plain ascending columns, along which even slices are cut.
    """
    if slice_by is None:
        df, slice_by = even_slices(df, keys, order, "_even"), F.col("_even")
        return number_rows(df, keys, order, slice_by, name).drop("_even")
    rows = _sliced(df, keys, slice_by)
    inside = W.partitionBy("_at").orderBy(*order)
    sizes = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(sizes, keys, F.sum("_n"), "_before", descending)
    numbered = rows.withColumn("_in_slice", F.row_number().over(inside))
    joined = numbered.join(offsets, "_at", "left")
    return joined.withColumn(name, (F.col("_in_slice") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop(
        "_at", "_slice", "_in_slice", "_before"
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Running total including the current row, for keys of any size."""
    rows = _sliced(df, keys, slice_by).withColumn("_value", value)
    inside = W.partitionBy("_at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sizes = rows.groupBy("_at").agg(F.sum("_value").alias("_n"))
    offsets = _before(sizes, keys, F.sum("_n"), "_before")
    summed = rows.withColumn("_in_slice", F.sum("_value").over(inside))
    joined = summed.join(offsets, "_at", "left")
    return joined.withColumn(name, F.col("_in_slice") + F.coalesce("_before", F.lit(0))).drop(
        "_at", "_slice", "_value", "_in_slice", "_before"
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    value: str,
    name: str,
) -> DataFrame:
    """The value of the preceding row of the key, for keys of any size.

    Inside a slice it is ``lag``; the first row of a slice takes the last value
    of the nearest slice before it.
    """
    rows = _sliced(df, keys, slice_by)
    inside = W.partitionBy("_at").orderBy(*order)
    lasts = rows.groupBy("_at").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    carried = _before(lasts, keys, F.lag("_last"), "_carry")
    lagged = rows.withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    joined = lagged.join(carried, "_at", "left")
    return joined.withColumn(name, F.coalesce("_lag", "_carry")["v"]).drop("_at", "_slice", "_lag", "_carry")


def hash_bits(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """The test whether a hash is one of the ``n`` in ``_key``, by an array of bits.

    The array has four bits a hash or more and at most ``HASH_BITS``, so it is small however many there are. The test never
    misses a hash; what it lets through beyond them is for a join to tell.
    """
    size = min(HASH_BITS, max(1 << 12, 1 << (4 * n - 1).bit_length()))
    at = lambda key: key.bitwiseAND(F.lit(size - 1))
    place = lambda key: F.shiftright(at(key), 6).cast("int")
    bit = lambda key: key.bitwiseAND(F.lit(63)).cast("int")
    held = keys.filter("_key IS NOT NULL").select(place(F.col("_key")).alias("id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("_key"))).alias("_bit"))
    ranges = keys.sparkSession.range(size // 64).join(held.groupBy("id").agg(F.bit_or("_bit").alias("_bits")), "id", "left")
    bits = ranges.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0)).alias("_bits"))))["_bits"].alias("_all"))
    return lambda key: F.getbit(F.get(bits.scalar(), place(key)), bit(key)) == 1


def list_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column | None,
    item: Column,
    per_part: int = 500,
    descending: bool = False,
) -> DataFrame:
    """Ordered item lists per key, in numbered parts of bounded size.

    No list grows with the key: a key of a million rows yields many rows of
    ``per_part`` items each, and every row is kept.
    """
    numbered = number_rows(df, keys, order, slice_by, "_no", descending)
    return (
        numbered.withColumn("part", ((F.col("_no") - 1) / per_part).cast("bigint"))
        .groupBy(*keys, "part")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("_no").alias("no"), item.alias("item")))).alias("_items"),
        )
        .select(*keys, "part", F.col("_items")["item"].alias("items"), F.size("_items").alias("n"))
    )


def id_slice(c: str, width: int = 65_536) -> Column:
    """Ranges of a numeric id, as slices for the functions above."""
    return F.floor(F.col(c) / width)


def text_downward(c: Column) -> Column:
    """A text whose ascending order is the descending order of ``c``, nulls last."""
    turned = F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.coalesce(F.concat(turned, F.lit("G")), F.lit("H"))
