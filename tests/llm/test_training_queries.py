"""The registered queries and the pipeline over whole tables, against plain versions and SQL."""

from __future__ import annotations

import hashlib
import zlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import canonical

from retailscope.llm.queries import registry
from retailscope.session import table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def rows_of(spark, sf_dir, name, *columns):
    return sorted(tuple(r) for r in registry.queries[name].build(spark, sf_dir).select(*columns).collect())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries) == list(range(1, 14))


def test_vectors_query(spark, sf_dir):
    found = registry.queries["op1_embedding_near_dedup"].build(spark, sf_dir).collect()
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    unit = np.array([r["embedding"] for r in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in found}
    assert len(found) == len(rows) and all(got[r["vec_id"]] <= n for r, n in zip(rows, near.sum(axis=1), strict=True))
    assert sum(got.values()) >= 0.9 * near.sum()


def test_simhash_query(spark, sf_dir, texts):
    want = brute.near_copies(texts)
    assert rows_of(spark, sf_dir, "op2_simhash_near_dedup", "doc_id", "fingerprint", "component_id") == sorted((i, *w) for i, w in want.items())


def test_suffix_query(spark, sf_dir, texts):
    want = sorted((i, n, g, s, brute.sha(k)) for (i, _), (n, g, s, k, _) in zip(texts, brute.repeats(texts), strict=True))
    assert rows_of(spark, sf_dir, "op3_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_sentencepiece_query(spark, sf_dir, texts, pieces):
    coded = [(i, pieces.encode(t or "")) for i, t in texts]
    want = [(i, len(x), brute.sha(",".join(map(str, x)).encode()), brute.sha(pieces.decode(x).encode() if x else b"")) for i, x in coded]
    assert rows_of(spark, sf_dir, "op4_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_token_files_query(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    whole, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(spark, sf_dir, "op5_token_id_files", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_token_counts_query(spark, sf_dir, texts):
    found = registry.queries["op6_token_counts"].build(spark, sf_dir).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "max", "section": "max"}).collect()
    assert len(found) == len(texts) and all(r["sum(n_tokens)"] == r["max(doc_tokens)"] for r in found)
    lines = {i: len(t.removesuffix("\n").split("\n")) for i, t in texts}
    assert all(r["max(section)"] + 1 == lines[r["doc_id"]] for r in found)


def test_contamination_query(spark, sf_dir, texts, items):
    want = [(i, n, h, len(w), brute.sha(",".join(w).encode()), h > 0) for (i, _), (n, h, w) in zip(texts, brute.contamination(texts, items), strict=True)]
    assert rows_of(spark, sf_dir, "op7_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


@pytest.mark.parametrize("name", ["op9_warc", "op10_url_filters"])
def test_queries_against_sql(spark, sf_dir, duck, name):
    query = registry.queries[name]
    assert canonical(query.build(spark, sf_dir).toPandas()).equals(canonical(duck.execute(query.sql).df()))


def cut_characters(text: str, gone) -> str:
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not gone[at : at + n].all():
            out.append(c)
        at += n
    return "".join(out)


def test_pipeline(spark, sf_dir, texts, items, pieces):
    docs = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    first = brute.near_copies(docs)
    docs = [(i, t) for i, t in docs if first[i][1] == i]
    cut = brute.repeats(docs)
    docs = [(i, cut_characters(t, gone)) for (i, t), (*_, gone) in zip(docs, cut, strict=True)]
    docs = [(i, t) for i, t in docs if t]
    docs = [d for d, (_, hit, _) in zip(docs, brute.contamination(docs, items), strict=True) if not hit]
    want = [(i, hashlib.sha256(str(pieces.encode(t)).encode()).hexdigest(), pieces.decode(pieces.encode(t))) for i, t in docs]
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids", "text").orderBy("doc_id").collect()
    assert [(r["doc_id"], hashlib.sha256(str(list(r["ids"])).encode()).hexdigest(), r["text"]) for r in found] == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]


def test_stages_take_messy_rows(spark, tmp_path, sf_dir):
    rows = [(1, None, None, "s", 1, "x"), (1, None, None, "s", 1, "x"), (2, "", "en", None, None, "x"), (None, "word of a text " * 9, "en", "s", 1, "x"), (3, "word of a text " * 9, "en", "s", 1, "x"), (4, "!!", "de", "s", 2, "x")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(path)
    for n in (len(rows), 0):
        docs = spark.read.parquet(path).limit(n)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == n
