"""Language identification by inference over mixtures of languages.

A text is a mixture: each of its letter trigrams comes from some language, and expectation-maximisation finds the
languages' proportions. Languages join the set as long as the gain in likelihood beats a penalty per language, so a
text in one language is not split over relatives of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import map_arrow

#: Trigrams are hashed into this many cells; about so many labelled documents per language are learned from.
CELLS, SAMPLE_DOCS = 1 << 16, 4000
FOLDS = 5
ROUNDS, SETTLED = 40, 1e-4
#: Trigrams overlap, so a language must gain three times the usual half log of their number.
PENALTY, SMOOTHING = 1.5, 0.5
UNKNOWN = "und"
#: Letters in Spark's patterns; number signs such as superscripts, fractions and Roman numerals are none.
LETTERS = r"\p{L}"
_WORDS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
_EDGE = np.uint32(32)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams inside words (edges are spaces) and their counts."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_WORDS) + b" ", dtype=np.uint8).astype(np.uint32)
    left, middle, right = raw[:-2], raw[1:-1], raw[2:]
    mixed = ((left << np.uint32(16) | middle << np.uint32(8) | right) * np.uint32(2654435761)) >> np.uint32(16)
    return np.unique(mixed[middle != _EDGE], return_counts=True)


def settle(chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns) that the counted trigrams (rows) make likeliest, and the log likelihood."""
    share, n = np.full(chances.shape[1], 1 / chances.shape[1]), counts.sum()
    for _ in range(ROUNDS):
        new = share * (chances.T @ (counts / (chances @ share))) / n
        moved, share = np.abs(new - share).max(), new
        if moved < SETTLED:
            break
    return share, float(counts @ np.log(chances @ share))


def infer(chances: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The language set of highest penalised likelihood, largest share first, and its shares."""
    single = counts @ np.log(chances)
    chosen, shares, best = [int(np.argmax(single))], np.ones(1), float(single.max())
    if chances.shape[1] == 1:
        return chosen, shares
    overall, _ = settle(chances, counts)
    penalty = PENALTY * np.log(max(2, counts.sum()))
    for extra in np.argsort(-overall, kind="stable"):
        if extra in chosen or overall[extra] < SETTLED:
            continue
        grown = [*chosen, int(extra)]
        found, likelihood = settle(chances[:, grown], counts)
        if likelihood - best <= penalty:
            break
        chosen, shares, best = grown, found, likelihood
    order = np.argsort(-shares, kind="stable")
    return [chosen[i] for i in order], shares[order]


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in sorted order and, per language, the chance of every cell.

    Only ``text`` and non-null ``lang`` of documents outside the held-out fold are learned from. Each language gives about
    ``sample_docs`` documents (all, if it has fewer), chosen by a hash of their id. The counts that reach the driver are
    bounded by languages times ``CELLS``.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((CELLS, 0))
    parts = 1_000_000
    keep = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(parts, round(parts * sample_docs / n)))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < keep[F.col("lang")]).select("lang", "text")

    def step(batch: pa.RecordBatch) -> dict:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            cells, counts = trigram_counts(text)
            sums.setdefault(lang, np.zeros(CELLS, dtype=np.int64))[cells] += counts
        filled = {lang: np.flatnonzero(x) for lang, x in sums.items()}
        none = [np.zeros(0, dtype=np.int64)]
        return {
            "lang": [lang for lang, cells in filled.items() for _ in range(len(cells))],
            "cell": np.concatenate([*filled.values(), *none]).astype(np.int64),
            "n": np.concatenate([*(sums[lang][cells] for lang, cells in filled.items()), *none]).astype(np.int64),
        }

    counted = map_arrow(sample, step, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    totals = np.full((CELLS, len(languages)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(languages)}
    if counted.num_rows:
        at = np.array([column[x] for x in counted.column("lang").to_pylist()])
        totals[counted.column("cell").to_numpy(), at] += counted.column("n").to_numpy()
    return languages, totals / totals.sum(axis=0)


def predict(docs: DataFrame, languages: list[str], chances: np.ndarray, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The carried columns (and the text, if asked for) with ``lang_pred``, ``score`` (its share of the text) and ``lang_shares``; reads ``text`` alone.

    A null text or one without a letter is ``und`` with score 0, as is every text if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"chances": chances})
    rows = docs.select(F.struct(*carry).alias("_key"), "text")

    def step(batch: pa.RecordBatch) -> dict:
        table = shared.value["chances"]
        names, scores, shares = [], [], []
        for text in batch.column("text").to_pylist():
            found: list[tuple[str, float]] = []
            if text and languages and any(map(str.isalpha, text)):
                cells, counts = trigram_counts(text)
                chosen, share = infer(table[cells], counts)
                found = [(languages[c], min(1.0, float(s))) for c, s in zip(chosen, share, strict=True)]
            names.append(found[0][0] if found else UNKNOWN)
            scores.append(found[0][1] if found else 0.0)
            shares.append(found)
        own = {"_key": batch.column("_key")} | ({"text": batch.column("text")} if with_text else {})
        return own | {"lang_pred": names, "score": scores, "lang_shares": shares}

    kind = dict(rows.dtypes)["_key"]
    text = ["text"] if with_text else []
    found = map_arrow(rows, step, f"_key {kind}, {'text string, ' if text else ''}lang_pred string, score double, lang_shares map<string,double>")
    return found.select(*[F.col("_key")[c].alias(c) for c in carry], *text, "lang_pred", "score", "lang_shares")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``lang_shares`` of every document.

    Repeated documents are judged row by row; a null doc_id is in neither fold: it is not learned from and not held out.
    """
    languages, chances = learn(docs)
    found = predict(docs, languages, chances)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_shares")
