"""Each operator against its plain version, on messy rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import zlib
from itertools import accumulate

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from retailscope.llm import decontaminate, language, sentencepieces, simhash, suffixes, tokencounts, tokenfiles, urlfilter, vectors, warc
from retailscope.llm.components import connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, spans string, fp string, kept string, label string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "ré", "ti", "kö", "n", "s"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 12, 40, 200, 200)]
    passage = sentence(rng, 30)
    texts = [None, "", "   ", "\n\t", "12 34 !!", *base, base[3], base[3] + " end", passage, f"{base[1]}. {passage}", f"{passage}\n{base[2]} {passage}"]
    texts += ["x", "ab" * 4000, "ab" * 4000 + "c", "same", "same", "a  b   c ", " ▁ lead", "nul\x00byte <s> <|endoftext|> é日😀", base[4].upper(), sentence(rng, 9000)]
    listed = [(i, t) for i, t in enumerate(texts)]
    return listed + [(7, base[2]), (None, passage), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(i, t, "aa" if n % 2 else None, "s", 1, "c", "c", "c", "c", "c") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(clash, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def table_docs(docs, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("false")


def held(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_simhash(docs, rows, no_docs):
    unique = sorted({r[0]: r for r in rows if r[0] is not None and r[0] != 7}.values())
    found = simhash.find_near_copies(docs.where("doc_id is not null and doc_id <> 7"))
    want = brute.near_copies(unique)
    assert {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found.collect()} == want
    assert simhash.find_near_copies(docs).count() == len(rows)
    assert simhash.find_near_copies(no_docs).count() == 0


def test_pigeonhole_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < 0.5
    together = bits.T.astype(float) @ bits
    for n in (500, 10**6, 10**10):
        parts = simhash.plan_parts(n, together * n / 500)
        assert sum(p.threshold + 1 for p in parts) == simhash.DISTANCE + 1
        masks = [p.mask for p in parts]
        assert sum(masks) == sum({m: m for m in masks}) and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
        for _ in range(300):
            differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any((differ & p.mask).bit_count() <= p.threshold for p in parts)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (3, 2)]
    got = {r["node"]: r["label"] for r in connect(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}
    assert connect(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup(table_docs, docs, no_docs, monkeypatch):
    read = [(r["doc_id"], r["text"]) for r in table_docs.select("doc_id", "text").collect()]
    want = sorted([(i, n, g, s, k) for (i, _), (n, g, s, k, _) in zip(read, brute.repeats(read), strict=True)], key=repr)

    def got(characters=False):
        found = suffixes.find_repeats(table_docs, characters=characters)
        return sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in found.collect()), key=repr)

    assert got() == want
    for name, value in (("BLOCK_BYTES", 3000), ("SLICE_BYTES", 500), ("SORT_BYTES", 200), ("HOT_DOCS", 3)):
        monkeypatch.setattr(suffixes, name, value)
    assert got() == want
    for row in suffixes.find_repeats(table_docs, characters=True).collect():
        assert "\ufffd" not in bytes(row["kept"]).decode()
    assert suffixes.find_repeats(no_docs).count() == 0


def test_two_stage_order():
    rng = random.Random(2)
    for n in range(1, 120):
        text = bytes(rng.choice(b"ab\x00\xff" if n % 2 else bytes(range(256))) for _ in range(n))
        raw = np.frombuffer(text, dtype=np.uint8)
        padded = np.concatenate((raw, np.zeros(suffixes.WINDOW + 16, dtype=np.uint8)))
        loads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)
        order = suffixes.two_stage_order(raw, loads).tolist()
        assert sorted(order) == list(range(n))
        long_ = [i for i in order if i + suffixes.WINDOW <= n]
        assert [text[i : i + 50] for i in long_] == sorted(text[i : i + 50] for i in long_)


def test_contamination(docs, rows, spark):
    items = [(1, rows[8][1]), (2, "Same"), (2, "same"), (3, None), (4, "!!"), (None, rows[6][1]), (5, rows[9][1].upper())]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_hit string")
    read = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted([(i, *w) for (i, _), w in zip(read, brute.contamination(read, items), strict=True)], key=repr)
    for part_bytes in (decontaminate.PART_BYTES, 700):
        found = decontaminate.find_contamination(docs, bench, part_bytes=part_bytes)
        assert held(found, "doc_id", "n_words", "n_hit", "items") == want
    for row, text in ((r, dict(read)[r["doc_id"]]) for r in found.where("n_hit > 0 and doc_id <> 7 and doc_id is not null").collect()):
        assert sum(len(brute.WORD.findall(brute.low(text[s["start"] : s["end"]]))) for s in row["spans"]) == row["n_hit"]
    clean = decontaminate.find_contamination(docs, bench.where("false"))
    assert clean.agg(F.sum("n_hit")).head()[0] == 0 and clean.count() == len(rows)


def test_sentencepiece(table_docs, no_docs, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    read = [(r["doc_id"], r["text"] or "") for r in table_docs.select("doc_id", "text").collect()]
    want = sorted([(i, whole.encode(t), whole.decode(whole.encode(t)) if t else "") for i, t in read], key=repr)
    assert held(sentencepieces.encode_documents(table_docs, path), "doc_id", "ids", "decoded") == want
    monkeypatch.setattr(sentencepieces, "BLOCK_CHARS", 500)
    monkeypatch.setattr(sentencepieces, "KNOWN_CHUNKS", 20)
    assert held(sentencepieces.encode_documents(table_docs, path), "doc_id", "ids", "decoded") == want
    assert sentencepieces.encode_documents(no_docs, path).count() == 0


def test_chunks_of_random_texts():
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "é", "▁", " ", "  ", "\n", "<s>", "<0x0A>", "the", "日", "\x00", ".", "\u2581a"]) for _ in range(rng.randint(0, 12)))
        assert [i for ids in sentencepieces.segment(whole, sentencepieces.chunks_of(text)) for i in ids] == whole.encode(text)


def test_token_files(docs, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    read = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    ids = [(i, whole.encode(t, add_special_tokens=False).ids + [0]) for i, t in read]
    monkeypatch.setattr(tokenfiles, "KNOWN_CHUNKS", 50)
    monkeypatch.setattr(tokenfiles, "SLICE_CHARS", 300)
    found = sorted((tuple(r) for r in tokenfiles.read_token_files(tokenfiles.write_token_files(docs, path)).collect()), key=lambda r: r[1])
    assert sorted((r[0], r[2], r[3]) for r in found if r[0] is not None) == sorted((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids if i is not None)
    assert [r[1] for r in found] == [0, *accumulate(r[2] for r in found)][:-1]
    known = [r[0] for r in found if r[0] is not None]
    assert known == sorted(known) and found[0][0] is None and len(found) == len(read)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(no_docs, path)).count() == 0


def test_token_files_leave_other_files(docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = tmp_path / "somebody-elses.txt"
    other.write_text("kept")
    first = tokenfiles.write_token_files(docs, path, folder=str(tmp_path))
    want = sorted(map(str, tokenfiles.read_token_files(first).collect()))
    second = tokenfiles.write_token_files(docs, path, folder=str(tmp_path))
    assert other.read_text() == "kept"
    assert sorted(map(str, tokenfiles.read_token_files(first).collect())) == want
    assert sorted(map(str, tokenfiles.read_token_files(second).collect())) == want


def test_token_counts(docs, no_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = tokencounts.count_tokens(docs.where("doc_id is not null and doc_id <> 7"), path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null and doc_id <> 7").select("doc_id", "text").collect()}
    for doc_id, text in texts.items():
        own = sorted((r for r in found if r["doc_id"] == doc_id), key=lambda r: r["section"])
        assert "".join(text[r["start"] : r["end"]] for r in own) == text and [r["section"] for r in own] == list(range(len(own)))
        assert sum(r["n_tokens"] for r in own) == len(whole.encode(text, add_special_tokens=False).ids) == own[0]["doc_tokens"]
    assert tokencounts.count_tokens(no_docs, path).count() == 0


def test_crossing_tokens_go_to_the_larger_part():
    counts, crossing = tokencounts.allocate(np.array([0, 3, 7, 9]), np.array([0, 4, 5, 9]))
    assert counts.tolist() == [1, 0, 2] and crossing.tolist() == [0, 0, 1]
    counts, crossing = tokencounts.allocate(np.array([0, 4]), np.array([0, 2, 4]))
    assert counts.tolist() == [1, 0] and crossing.tolist() == [1, 0]


def test_language(spark, docs, no_docs, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.95 * len(found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    languages, chances = language.learn(table)
    texts = {r["lang"]: r["text"] for r in table.where("length(text) > 1500").collect()}
    both = [(1, f"{texts['en'][:1200]} {texts['de'][:1200]}", 0), (2, None, 0), (3, "12 !", 0), (4, "é", 0)]
    mixed = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(both, "doc_id long, text string, score int"), languages, chances).collect()}
    assert set(mixed[1]["lang_shares"]) == {"en", "de"} and all(0.35 < s < 0.65 for s in mixed[1]["lang_shares"].values())
    assert [mixed[i]["lang_pred"] for i in (2, 3)] == ["und", "und"] and mixed[4]["lang_pred"] in languages
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und", "aa"}
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(no_docs).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc(spark, compress):
    trap = "x" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" + "y" * 9 + "\r\n\r\n" + "z" * 400
    data = [(i, f"http://a/{i} é\r\n", trap + str(i) if i % 3 else "p" * (i % 160)) for i in range(300)]
    data += [(400, None, None), (777, "u", "same" * 50), (777, "u", "same" * 50), (None, "u", "other" * 30), (None, "u", "other" * 30), (401, "u", "short")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(4)
    manifest = warc.write_archives(pages, compress=compress)
    found = warc.read_archives(manifest, range_bytes=2000).collect()
    assert len(found) == len(data) == manifest.agg(F.sum("n_records")).head()[0]
    first: dict[str, int] = {}
    for i, _, html in data:
        if i is not None and len(html or "") >= 100:
            first[html] = min(first.get(html, i), i)
    for row in found:
        if row["record_id"] is None:
            continue
        page = int(row["record_id"])
        html = {i: h or "" for i, _, h in data}[page]
        again = first.get(html, page) != page
        if page != 777:
            assert (row["record_type"], row["refers_to"]) == (("revisit", str(first[html])) if again else ("response", None))
        assert row["payload_bytes"] == len(html) and row["payload_digest"] == brute.sha(html.encode())
        assert row["record_type"] == "revisit" or bytes(row["payload"]) == html.encode()
    kinds = [r["record_type"] for r in found if r["payload_digest"] == brute.sha(b"same" * 50)]
    assert kinds == ["response", "response"]
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_urls(spark):
    urls = ["http://a.org/x", "https://EXAMPLE.org/es/1?q#f", "http://b.example.org/en/12", "http://example.org/en/2", "http://notexample.org", "http://org/", "x.com/fr/", "ftp://x.com/fr/a", "http://com/de/", None, "", "://", "http://x.com?/de/", "http://a..com/de/", "HTTP://shop.COM/de/#", "a\n://b.com/fr/\n"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    found = urlfilter.judge_urls(pages, urlfilter.contract_rules(spark))
    want = [(i, *brute.url_verdict(u, urlfilter.RULES)) for i, u in enumerate([*urls, urls[0]])]
    assert sorted(map(tuple, found.collect())) == want
    none = urlfilter.judge_urls(pages, urlfilter.contract_rules(spark).where("false"))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(want)
    assert urlfilter.judge_urls(pages.where("false"), urlfilter.contract_rules(spark)).count() == 0


def test_cascade_is_exact_over_many_keys(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 3)
    asked = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = asked.where("hash(key) % 7 = 0")
    cascade = urlfilter.build_cascade(listed, asked)
    assert len(cascade.levels) > 2
    wrong = asked.withColumn("told", cascade.holds(F.col("key"))).where("told <> (hash(key) % 7 = 0)")
    assert wrong.count() == 0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    base[200:260] = base[0] + rng.normal(size=(60, 16)) * 0.12
    base[260:] = base[100:140] * 3
    listed = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    listed += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [], 1), (905, base[5].tolist(), 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, base[5].tolist(), 1)]
    frame = spark.createDataFrame(listed, "vec_id long, embedding array<double>, n_links int").repartition(4)
    unit = [np.array(v) / np.linalg.norm(v) if v and None not in v and np.isfinite(v).all() and any(v) and i is not None else None for i, v, _ in listed]

    def linked(a, b):
        return unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95

    root = brute.components(len(listed), linked)
    want = {r[0]: (sum(linked(i, j) for j in range(len(listed)) if j != i), listed[root[i]][0]) for i, r in enumerate(listed)}
    for tile in (vectors.TILE, 40):
        monkeypatch.setattr(vectors, "TILE", tile)
        monkeypatch.setattr(vectors, "LIST_SIZE", 40)
        found = vectors.find_near_vectors(frame).collect()
        assert len(found) == len(listed)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
        links = sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.98 * links
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None) for r in found)
    assert vectors.find_near_vectors(frame.where("false")).count() == 0
    assert vectors.find_near_vectors(frame.where("vec_id in (900, 901)")).count() == 2
