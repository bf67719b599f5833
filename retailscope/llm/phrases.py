"""Collocations: phrases of two to five words that go together, mined by sampling.

Toivonen's method: phrases frequent in a sample are proposed; a pass over all documents counts them and their border, the
phrases one word longer whose two shorter parts are both proposed. A border phrase that turns out frequent is a failure: what
it lets grow was not counted. An expansion pass counts that too, and takes each phrase it newly counts as possibly frequent,
so whatever could grow from it is counted in the same pass and no further one is needed. Every frequent phrase has only
frequent parts, so by induction it is counted.

The first pass counts hashes of 64 bits, so texts of the many rare border phrases are never sent; a hash has at least the
count of each phrase behind it. The expansion pass counts the words themselves of what reached the threshold, so results
never depend on a hash. Which windows are proposed or frequent is asked of bitmaps of bounded size. They never miss one; a
window that they let through by chance is counted like any other and costs time, not correctness.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retailscope.llm.common import stored, to_batch

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Share of documents in the sample, and how far below its part of the threshold a phrase is still proposed.
SAMPLE_SHARE, SLACK = 0.1, 0.7
#: Bits of the bitmap for each proposed phrase, and its least and greatest size in bits (32 MB).
BITS_EACH, MIN_BITS, MAX_BITS = 16, 1 << 20, 1 << 28
#: Words held before they are counted, distinct words a task remembers, bytes of a text read at once.
BUFFER_WORDS, KNOWN_WORDS, SLICE_BYTES = 1_000_000, 1_000_000, 4_000_000
#: Phrases whose counts a task adds up before it sends them.
HELD_PHRASES = 500_000
UNKNOWN = "und"
#: Ends of pieces become full stops, tabs become spaces, A-Z lower case.
_EDGE = b"."
_LETTERS = bytes(
    0x2E if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, m int, phrase binary, n long"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def phrase_hash(lang: str, words: Sequence[bytes]) -> int:
    """The hash of a phrase of a language, word by word; ``Windows`` works out the same over arrays."""
    found = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1)
    for word in words:
        found = (found * int(_STEP) + word_hash(word)) & 0xFFFFFFFFFFFFFFFF
    return found


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both places of each hash are set; the number of bits is a power of two, of at most 32."""
    last = np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(hashes), dtype=bool)
    for place in (hashes & last, (hashes >> np.uint64(32)) & last):
        found &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def bitmap(hashes: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits of hashes (``h``); words of 64 bits come back, so its size bounds what does."""
    places = hashes.select(F.explode(F.array(F.expr(f"h & {size - 1}L"), F.expr(f"shiftrightunsigned(h, 32) & {size - 1}L"))).alias("place"))
    slots = places.groupBy(F.expr("shiftright(place, 6)").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    found = slots.toArrow()
    words = np.zeros(size // 64, dtype=np.int64)
    words[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint8)


class Vocabulary(dict):
    """Numbers of words in the order met; number 0 is the edge of a piece."""

    def __init__(self) -> None:
        super().__init__({_EDGE: 0})
        self.words, self.hashes = [_EDGE], np.zeros(1, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def hashed(self) -> np.ndarray:
        new = [word_hash(w) for w in self.words[len(self.hashes) :]]
        self.hashes = np.concatenate([self.hashes, np.array(new, dtype=np.uint64)])
        return self.hashes


def numbered(text: bytes, vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """Word numbers of a text with edges between its pieces, in slices that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        part = text[at:end].translate(_LETTERS)
        while end < len(text) and part[-1:] not in b" .":
            more = text[end : end + 4096].translate(_LETTERS)
            cut = min((i for i in (more.find(b" "), more.find(b".")) if i >= 0), default=len(more) - 1)
            part, end = part + more[: cut + 1], end + cut + 1
        words = part.replace(b".", b" . ").split()
        yield np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))
        at = end


class Windows:
    """Windows of words by language, worked out buffer by buffer."""

    def __init__(self, lengths: Sequence[int], proposed: np.ndarray | None, frequent: np.ndarray | None = None) -> None:
        self.lengths, self.proposed, self.frequent = lengths, proposed, frequent
        self.vocabulary, self.parts, self.size = Vocabulary(), {}, 0

    def add(self, lang: str, text: bytes) -> bool:
        """Takes a text in and says whether the buffer is full. The last words of a slice go before the next one, where only
        windows that reach on count."""
        if not self.parts and len(self.vocabulary.words) > KNOWN_WORDS:
            self.vocabulary = Vocabulary()
        back = max(self.lengths) - 1
        carry = np.zeros(0, dtype=np.int64)
        for numbers in numbered(text, self.vocabulary):
            self.parts.setdefault(lang, []).append((carry, numbers))
            self.size += len(numbers)
            both = np.concatenate([carry, numbers])
            carry = both[len(both) - min(back, len(both)) :]
        return self.size >= BUFFER_WORDS

    def drain(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Per language the words held, which of them were carried over, and the hashes of single words."""
        hashes, edge = self.vocabulary.hashed(), np.zeros(1, dtype=np.int64)
        for lang, parts in self.parts.items():
            x = np.concatenate([a for carry, numbers in parts for a in (carry, numbers, edge)])
            again = np.concatenate([np.full(n, flag) for carry, numbers in parts for n, flag in ((len(carry), True), (len(numbers), False), (1, True))])
            yield lang, x, again, np.uint64(phrase_hash(lang, ()) * int(_STEP) & 0xFFFFFFFFFFFFFFFF) + hashes[x]
        self.parts, self.size = {}, 0

    def longer(self, x: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
        return h[:-1] * _STEP + self.vocabulary.hashes[x[m - 1 :]]

    def hashed(self) -> dict | None:
        """Hashes and counts of the proposed windows and their border."""
        found = []
        for _, x, again, h in self.drain():
            if 1 in self.lengths:
                found.append(h[(x > 0) & ~again])
            known = among(self.proposed, h, x > 0)
            for m in range(2, min(max(self.lengths), len(x)) + 1):
                both = known[:-1] & known[1:]
                h = self.longer(x, h, m)
                if m in self.lengths:
                    found.append(h[both & ~again[m - 1 :]])
                known = among(self.proposed, h, both)
        if not sum(map(len, found)):
            return None
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        return {"h": values.view(np.int64), "n": counts}

    def exact(self) -> Iterator[dict]:
        """Words and counts of the windows that the first pass found frequent by hash, and of those it did not count; both
        only where their parts are such windows as well."""
        words = self.vocabulary.words
        for lang, x, again, h in self.drain():
            size = int((~again & (x > 0)).sum())
            if not size:
                continue
            yield {"lang": lang, "m": 0, "phrase": [b""], "n": np.array([size])}
            known, open_ = among(self.proposed, h, x > 0), among(self.frequent, h, x > 0)
            for m in range(1, min(max(self.lengths), len(x)) + 1):
                if m > 1:
                    counted, both = known[:-1] & known[1:], open_[:-1] & open_[1:]
                    h = self.longer(x, h, m)
                    open_ = (both & ~counted) | among(self.frequent, h, both & counted)
                    known = among(self.proposed, h, counted)
                at = np.flatnonzero(open_ & ~again[m - 1 :])
                if len(at):
                    first, counts = distinct(x, h[at], at, m)
                    yield {"lang": lang, "m": m, "phrase": [b" ".join([words[i] for i in x[p : p + m].tolist()]) for p in first.tolist()], "n": counts}


def among(bits: np.ndarray | None, h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Which of some windows a bitmap holds."""
    found = np.zeros(len(h), dtype=bool)
    if bits is not None:
        at = np.flatnonzero(where)
        found[at] = held(bits, h[at])
    return found


def distinct(x: np.ndarray, h: np.ndarray, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the distinct windows. Equal hashes are checked word by word; should two windows share
    one, all are told apart by their words alone."""
    _, first, group, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    first = at[first]
    if all(np.array_equal(x[at + j], x[first[group] + j]) for j in range(m)):
        return first, counts
    _, first, counts = np.unique(np.stack([x[at + j] for j in range(m)]), axis=1, return_index=True, return_counts=True)
    return at[first], counts


def count_hashes(docs: DataFrame, lengths: Sequence[int], proposed: Broadcast | None) -> DataFrame:
    """Counts (``h``, ``n``) by hash of language and phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(lengths, proposed.value if proposed else None)

        def result() -> Iterator[pa.RecordBatch]:
            found = windows.hashed()
            for i in range(0, len(found["h"]) if found else 0, 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[c][i : i + 200_000]) for c in ("h", "n")], names=["h", "n"])

        for lang, text in texts_of(batches):
            if windows.add(lang, text):
                yield from result()
        yield from result()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, max_words: int, proposed: Broadcast, frequent: Broadcast) -> DataFrame:
    """Exact counts (``lang``, ``m`` words, ``phrase``, ``n``) of ``Windows.exact``; m = 0 counts all words."""
    target = to_arrow_schema(docs.sparkSession.createDataFrame([], _COUNTS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(range(1, max_words + 1), proposed.value, frequent.value)
        sums: dict[tuple[str, int], dict[bytes, int]] = {}

        def gather() -> None:
            for found in windows.exact():
                held = sums.setdefault((found["lang"], found["m"]), {})
                for phrase, n in zip(found["phrase"], found["n"].tolist(), strict=True):
                    held[phrase] = held.get(phrase, 0) + n

        def result() -> Iterator[pa.RecordBatch]:
            for (lang, m), held in sums.items():
                phrases, counts = list(held), list(held.values())
                for i in range(0, len(phrases), 100_000):
                    part = phrases[i : i + 100_000]
                    yield to_batch({"lang": [lang] * len(part), "m": [m] * len(part), "phrase": part, "n": counts[i : i + 100_000]}, target)
            sums.clear()

        for lang, text in texts_of(batches):
            if windows.add(lang, text):
                gather()
                if sum(map(len, sums.values())) > HELD_PHRASES:
                    yield from result()
        gather()
        yield from result()

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n"))


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            yield lang, text.as_py() or b""


def _bits_for(n: int) -> int:
    size = MIN_BITS
    while size < min(MAX_BITS, n * BITS_EACH):
        size *= 2
    return size


def propose(docs: DataFrame, min_count: int, max_words: int, share: float) -> Broadcast:
    """A bitmap of the phrases of fewer than ``max_words`` words frequent in a sample by hash, found length by length."""
    spark = docs.sparkSession
    share = min(1.0, max(0.0, share))
    picked = F.pmod(F.xxhash64("_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = stored(docs.where(picked).select("lang", "text"), "sample")
    least = max(2, int(min_count * share * SLACK))
    found, bits = None, None
    for m in range(1, max_words):
        level = stored(count_hashes(sample, (m,), bits).where(F.col("n") >= least).select("h"), "proposed")
        found = level if found is None else found.unionByName(level)
        bits = spark.sparkContext.broadcast(bitmap(found, _bits_for(found.count())))
        if not level.count():
            break
    return bits


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, share: float = SAMPLE_SHARE) -> tuple[DataFrame, DataFrame]:
    """All phrases with at least ``min_count`` occurrences (``lang``, ``m``, ``phrase``, ``n``), and all words per ``lang``.

    ``docs``: ``text``, ``lang`` (null: ``und``) and ``doc_id``, which only helps to draw the sample. Null and empty texts
    have no words; repeated rows count each time. An empty table gives empty frames. The sample decides how much the two
    passes count, never the result.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("_id"))
    proposed = propose(texts, min_count, max_words, share)
    texts = texts.select("lang", "text")
    reached = stored(count_hashes(texts, range(1, max_words + 1), proposed).where(F.col("n") >= min_count).select("h"), "reached")
    frequent = spark.sparkContext.broadcast(bitmap(reached, _bits_for(reached.count())))
    counted = count_phrases(texts, max_words, proposed, frequent)
    counted = stored(counted.where((F.col("n") >= min_count) | (F.col("m") == 0)), "counted")
    totals = counted.where("m = 0").select("lang", F.col("n").alias("total"))
    return counted.where("m > 0").withColumn("phrase", F.col("phrase").cast("string")), totals


def part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def score_phrases(frequent: DataFrame, totals: DataFrame, min_words: int = 2) -> DataFrame:
    """Each phrase's lowest-scoring cut: ``lang``, ``phrase``, ``m``, ``a``, ``l``, ``r``, ``n``, ``score``, ``cut``.

    Scores are floor(1000 * a * n / (l * r)) in decimals of 38 digits; of equal scores the smallest cut counts.
    """
    words = F.split("phrase", " ")
    cuts = (
        frequent.where(F.col("m") >= min_words).select("lang", "phrase", "m", F.col("n").alias("a"), words.alias("words"))
        .withColumn("cut", F.explode(F.expr("sequence(1, m - 1)")))
        .select("lang", "phrase", "m", "a", "cut", part(F.col("words"), F.lit(1), F.col("cut")).alias("left"), part(F.col("words"), F.col("cut") + 1, F.col("m") - F.col("cut")).alias("right"))
    )
    counts = frequent.select("lang", F.col("phrase").alias("of"), "n")
    joined = cuts.join(counts.select("lang", F.col("of").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    joined = joined.join(counts.select("lang", F.col("of").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(total as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = joined.withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "m", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "m", "a", "best.l", "best.r", "n", "best.score", "best.cut")


def drop_contained(scored: DataFrame, share: int = 100) -> DataFrame:
    """Phrases without a longer one that holds their words and has at least ``share`` percent of their occurrences."""
    words, start, length = F.split("phrase", " "), F.col("start"), F.col("length")
    parts = (
        scored.where("m > 2").select("lang", "m", "a", words.alias("words")).withColumn("length", F.explode(F.expr("sequence(2, m - 1)")))
        .withColumn("start", F.explode(F.expr("sequence(1, m - length + 1)"))).select("lang", part(F.col("words"), start, length).alias("phrase"), F.col("a").alias("longer"))
    )
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * share, F.lit(False))).drop("longer")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: float = SAMPLE_SHARE
) -> DataFrame:
    """The ``top`` phrases of each language by score, then occurrences, then phrase: ``lang``, ``rank``, ``phrase``, ``a``,
    ``l``, ``r``, ``n``, ``score``, and the ``cut`` that gave it."""
    frequent, totals = frequent_phrases(docs, min_count, max_words, share)
    kept = drop_contained(score_phrases(frequent, totals))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
