"""URL filter by a Bloom filter cascade, with built-in expressions only.

Level 1 encodes the listed keys. The corpus's keys that pass it wrongly are encoded in level 2, the listed keys that
pass level 2 in level 3, and so on until a level lets no key pass wrongly: over the keys that the corpus can ask for,
membership is then exact, and no row is joined with the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.llm.common import lower_ascii, stored

#: The rules of the contract (host, path, action).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A level may take this many bytes; a longer list is refused, not cut.
MAX_LEVEL_BYTES = 64_000_000
BITS_PER_KEY, HASHES = 16, 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path; both empty for null or without ``://``."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


@dataclass(frozen=True)
class Level:
    bits: int
    words: DataFrame  # one row: words array<long>

    def holds(self, key: Column, salt: int) -> Column:
        words = self.words.scalar()
        tests = [_bit(words, place) for place in _places(key, salt, self.bits)]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def _places(key: Column, salt: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(n)), F.lit(bits)) for n in range(HASHES)]


def _bit(words: Column, place: Column) -> Column:
    word = F.get(words, F.floor(place / 64).cast("int"))
    return F.getbit(word, (place % 64).cast("int")) == 1


def _level(keys: DataFrame, n_keys: int, salt: int) -> Level:
    bits = 64 * max(1, math.ceil(n_keys * BITS_PER_KEY / 64))
    if bits // 8 > MAX_LEVEL_BYTES:
        raise ValueError(f"a level of {bits // 8} bytes is over MAX_LEVEL_BYTES; split the list by host")
    places = keys.select(F.explode(F.array(*_places(F.col("key"), salt, bits))).alias("place"))
    filled = places.groupBy(F.floor(F.col("place") / 64).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("word")
    )
    spark = keys.sparkSession
    dense = spark.range(bits // 64).join(filled, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    listed = dense.agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("all")).select(F.col("all.word").alias("words"))
    return Level(bits, stored(listed, "level"))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Listed if the first level that does not hold the key is an even one."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(self.levels[n].holds(key, n), out).otherwise(F.lit(n % 2 == 1))
        return out


def build_cascade(listed: DataFrame, asked: DataFrame) -> Cascade:
    """listed, asked: frames of ``key``, asked with repeats. Exact for every key in either.

    Only asked keys that pass level 1 are shuffled; their number is that of the listed keys plus the false positives.
    """
    wanted = stored(listed.select("key").where("key is not null").distinct(), "listed")
    n_wanted = wanted.count()
    if not n_wanted:
        return Cascade(())
    levels = [_level(wanted, n_wanted, 0)]
    passed = asked.where(F.col("key").isNotNull() & levels[0].holds(F.col("key"), 0)).select("key", F.lit(0).alias("listed"))
    both = passed.unionByName(wanted.select("key", F.lit(1).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed"))
    both = stored(both, "passed")
    sides = [both.where("listed = 1").select("key"), both.where("listed = 0").select("key")]
    while True:
        salt = len(levels)
        wrong = sides[salt % 2]
        n_wrong = wrong.count()
        if not n_wrong:
            return Cascade(tuple(levels))
        levels.append(_level(wrong, n_wrong, salt))
        last = levels[-1]
        other = (salt + 1) % 2
        sides[other] = stored(sides[other].where(last.holds(F.col("key"), salt)), "passed")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every page with ``host``, ``path``, the longest fitting ``rule`` and its ``verdict``.

    pages: ``page_id``, ``url``; rules: ``host``, ``path``, ``action`` (allow or block); other columns are not read.
    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest rule wins, of equally
    long ones that with the longer host; a rule listed with both actions blocks. Where none fits, ``rule`` is null and
    the verdict ``default``: the key is not in either list. Null urls and urls without ``://`` have empty parts.
    Repeated pages are judged row by row. Empty rules leave every url to the default.
    """
    rules = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("key"), "action",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"),
    )
    shapes = [(r[0], r[1]) for r in rules.select("labels", "chars").distinct().collect()]
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1

    names = []
    for n, (labels, chars) in enumerate(sorted(shapes)):
        fits = (F.col("host") != "") & (dots >= labels) & (F.length("path") >= chars)
        tail = F.substring_index("host", ".", -labels)
        rows = rows.withColumns({f"tail{n}": F.when(fits, tail), f"key{n}": F.when(fits, F.concat(tail, F.substring("path", 1, chars)))})
        names.append((f"tail{n}", f"key{n}"))
    asked = rows.select(F.explode(F.array(*[F.col(k) for _, k in names])).alias("key"))
    block, allow = (build_cascade(rules.where(F.col("action") == a).select("key"), asked) for a in ("block", "allow"))
    found = []
    for tail, key in names:
        blocked, allowed = block.holds(F.col(key)), allow.holds(F.col(key))
        sized = F.struct(F.length(key).alias("chars"), F.length(tail).alias("host_chars"), F.col(key).alias("key"), blocked.alias("block"))
        found.append(F.when(F.col(key).isNotNull() & (blocked | allowed), sized))
    best = F.array_max(F.array(*found))  # passes over nulls
    rows = rows.select("page_id", "host", "path", best.alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def contract_rules(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))
