"""Readings that differ, and groups whose size must follow a bound."""

from __future__ import annotations

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from retailscope.llm import decontaminate, suffixes


def test_another_order_of_the_second_reading_fails(spark, tmp_path):
    """``ask`` and ``pack`` see other texts: a column that is new at every reading."""
    fresh = F.udf(lambda i: __import__("uuid").uuid4().hex * 4, "string").asNondeterministic()
    docs = spark.range(0, 20, 1, 2).select(F.col("id").alias("doc_id"), fresh("id").alias("text"))
    with pytest.raises(Exception, match="not read twice in the same order"):
        suffixes.find_repeats(docs).collect()
    short = docs.withColumn("text", F.substring("text", 1, 20))
    with pytest.raises(Exception, match="not read twice in the same order"):
        suffixes.find_repeats(short).collect()


def test_suffix_buckets_follow_the_input(spark, monkeypatch):
    texts = [(i, f"{i % 7} " + "passage that many of the documents hold in the same words " * (1 + i % 3)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 50)
    total, partitions = sum(len(t) for _, t in texts), int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = suffixes.find_repeats(docs)
    assert suffixes.bucket_count(docs) == -(-total // 50) > partitions
    want = {i: kept for (i, _), (*_, kept, _) in zip(texts, brute.repeats(texts), strict=True)}
    assert {r["doc_id"]: bytes(r["kept"]) for r in found.collect()} == want


def test_benchmark_parts_are_bounded_by_their_windows(spark, monkeypatch):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(12))) for n in range(30)]
    docs = [(i, f"begin {items[i % 30][1]} middle {items[(i * 7) % 30][1]} end" if i % 3 else "nothing of it") for i in range(30)] + [(None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    parts, plain = [], decontaminate._scan_part
    monkeypatch.setattr(decontaminate, "_scan_part", lambda rows, held, *a: parts.append(held) or plain(rows, held, *a))
    for with_text in (False, True):
        parts.clear()
        found = decontaminate.find_contamination(frame, bench, part_bytes=8000, with_text=with_text)
        assert 1 < len(parts) < 30 and sum(len(p) for p in parts) == 30
        assert all(sum(len(w) for _, t in p for w in decontaminate.windows_of(t)) <= 8000 for p in parts)
        want = sorted(((i, *w) for (i, _), w in zip(docs, brute.contamination(docs, items), strict=True)), key=repr)
        rows = found.collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr) == want
        assert not with_text or {(r["doc_id"], r["text"]) for r in rows} == set(docs)


def test_chunk_encoder_equals_the_library(monkeypatch):
    import random

    from tokenizers import Tokenizer

    from retailscope.llm import tokenfiles

    monkeypatch.setattr(tokenfiles, "KNOWN_CHUNKS", 40)
    path = "/opt/tokenizers/byte_bpe_50k.json"
    with open(path) as file:
        encoder = tokenfiles.ChunkEncoder(file.read())
    parts = ["word", "Word.", "word!?", "don't.", "it's", "ó.", "naïve,", "x1.", "1.", ".", "..", "a.\nB", "\n", "\t.", " ", "", "日本。", "é.", "².", "Ġ", "Ġa.", "a'.", "<|endoftext|>", "ꟲ."]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(300)] + parts + [f"w{i}. q{i * 7919}" for i in range(200)]
    library = Tokenizer.from_file(path)
    for start in range(0, len(texts), 50):
        some = texts[start : start + 50]
        want = [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
        assert [list(memoryview(x).cast("H")) for x in encoder.encode(some)] == want
    assert encoder.older


ODD_CHUNKS = ["a", "The", " ", "  ", "\n", ".\nB", "\u00a0 ", "\u2003 ", "\u3000 ", "\u180e ", "\u1680 ", "\u0085 ", "\x1c ", "\u2019 ", "\u200b ", "\u3002 "]
ODD_CHUNKS += ["\u00e9 ", "\u00f1.", "\u00d7.", "\u024f,", "\u0250.", "\u0120", "\u042f,", "\u4e2d ", "\U0001f600 ", "'s", "l'eau", "x, ", "12.", "<|", "endoftext", "|>", "<|endoftext|>", "$$$"]


def test_cut_texts_have_the_ids_of_whole_ones(monkeypatch):
    """Whatever stands on either side of a cut, chunks and whole texts have the same ids."""
    import random

    from retailscope.llm import tokenfiles

    monkeypatch.setattr(tokenfiles, "KNOWN_CHUNKS", 200)
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        encoder = tokenfiles.ChunkEncoder(file.read())
    draw = random.Random(5)
    texts = ["".join(draw.choices(ODD_CHUNKS, k=draw.randint(0, 12))) for _ in range(4000)] + ["", ""]
    want = [np.array(x.ids, dtype=encoder.kind).tobytes() for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 90) for x in encoder.encode(texts[i : i + 90])] == want


def test_a_word_is_encoded_once_whatever_follows_it():
    """The library is not asked again for a word it has encoded, with a mark behind it or in another text."""
    from tokenizers.pre_tokenizers import ByteLevel

    from retailscope.llm import tokenfiles

    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        encoder = tokenfiles.ChunkEncoder(file.read())
    asked, ids = [], encoder._ids

    def counted(texts, *kind):
        asked.extend(texts)
        return ids(texts, *kind)

    encoder._ids = counted
    words = ["anthe", "jado\u00f1", "\u00e9\u00e7\u00e9ment", "schkeit"]
    texts = [f"Of {word}{mark} {word} of" for word in words for mark in (".", ",", "$$$", "&&&", "!!", ".\nOf")]
    want = [np.array(x.ids, dtype=encoder.kind).tobytes() for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(encoder.encode(texts)) == want
    for word in words:
        spelled = ByteLevel(add_prefix_space=False).pre_tokenize_str(word)[0][0]
        assert sum(text.count(word) + (spelled != word) * text.count(spelled) for text in asked) == 1
