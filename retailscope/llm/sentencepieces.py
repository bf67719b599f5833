"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses from a non-marker to a white-space marker, so a text falls into chunks that begin with a
marker and are segmented independently. Tasks name a block of documents by its distinct chunks and the documents by
positions in that list. The distinct chunks meet by hash, each is segmented once, and the ids go back to the blocks that
asked, where they are joined by position. Texts themselves are never shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retailscope.llm.common import planes, to_batch, unplanes

#: Characters of a block of documents; distinct chunks that a task of the table remembers.
BLOCK_CHARS, KNOWN_CHUNKS = 4_000_000, 400_000
MARKER = "▁"
_EDGE = re.compile(f"(?<=[^ {MARKER}])[ {MARKER}]")
ASKED = "block long, bucket int, sign long, n long, chunks binary"
CODED = "block long, sign long, doc_ids binary, counts binary, codes binary"
REPLY = "block long, bucket int, sign long, n long, ids binary"
RESULT = "doc_id long, ids array<int>, decoded string"


def check_model(model: bytes) -> None:
    """Refuses a model for which texts may not be cut before markers."""
    from sentencepiece import sentencepiece_model_pb2 as description

    read = description.ModelProto()
    read.ParseFromString(model)
    spec = read.normalizer_spec
    crosses = any(MARKER in p.piece.lstrip(MARKER) for p in read.pieces)
    own = any(p.type == p.USER_DEFINED for p in read.pieces)
    plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    if crosses or own or not plain or read.trainer_spec.treat_whitespace_as_suffix or read.trainer_spec.model_type != read.trainer_spec.BPE:
        raise ValueError("pieces of this model may cross white-space markers")


def chunks_of(text: str) -> list[str]:
    """Chunks without their first marker; an empty text has none."""
    if not text:
        return []
    single = not (text[0] == " " or MARKER in text or "  " in text)
    return text.split(" ") if single else _EDGE.split(text)


def load(held: dict):
    if "processor" not in held:
        import sentencepiece

        held["processor"] = sentencepiece.SentencePieceProcessor(model_proto=held["model"])
    return held["processor"]


def segment(processor, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk, its first marker put back; the library adds that marker to all but empty texts."""
    alone = [processor.piece_to_id(MARKER)]
    return [ids if chunk else alone for chunk, ids in zip(chunks, processor.encode(chunks, num_threads=1), strict=True)]


def pack(strings: list[str]) -> bytes:
    coded = [s.encode("utf-8", "surrogatepass") for s in strings]
    return zlib.compress(np.array([len(c) for c in coded], dtype="<u4").tobytes() + b"".join(coded), 1)


def unpack(n: int, blob: bytes) -> list[str]:
    raw = zlib.decompress(blob)
    ends = 4 * n + np.cumsum(np.frombuffer(raw, dtype="<u4", count=n).astype(np.int64))
    starts = np.concatenate(([4 * n], ends[:-1]))
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[list[str]]]]:
    """Documents of a partition in blocks: block id, document ids, chunks."""
    block, ids, cut, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            cut.append(chunks_of(text or ""))
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield block, ids, cut
                block, ids, cut, size = block + 1, [], [], 0
    if ids:
        yield block, ids, cut


def _distinct(cut: list[list[str]], buckets: int) -> tuple[list[list[str]], int]:
    """The distinct chunks by bucket, sorted, and a sign of them."""
    dealt: list[list[str]] = [[] for _ in range(buckets)]
    for chunk in sorted(set().union(*cut)):
        dealt[zlib.crc32(chunk.encode("utf-8", "surrogatepass")) % buckets].append(chunk)
    sign = xxhash.xxh64()
    for part in dealt:
        sign.update("\n".join(part).encode("utf-8", "surrogatepass"))
    return dealt, int(np.uint64(sign.intdigest()).view(np.int64))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every document, as the library gives them for the whole text.

    docs: ``doc_id`` long and ``text``, read twice in the same order, as a table is; other columns are not read. If the
    two readings differ, the job fails. Null and empty texts have no ids and decode to ''. Repeated documents give
    repeated rows, an empty table none.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    check_model(model)
    shared = spark.sparkContext.broadcast({"model": model})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = {name: to_arrow_schema(spark.createDataFrame([], text).schema) for name, text in (("asked", ASKED), ("coded", CODED), ("reply", REPLY), ("result", RESULT))}
    rows = docs.select("doc_id", "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, cut in _blocks(batches):
            dealt, sign = _distinct(cut, buckets)
            filled = [(b, part) for b, part in enumerate(dealt) if part]
            yield to_batch({"block": [block] * len(filled), "bucket": [b for b, _ in filled], "sign": [sign] * len(filled), "n": [len(p) for _, p in filled], "chunks": [pack(p) for _, p in filled]}, schema["asked"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, cut in _blocks(batches):
            dealt, sign = _distinct(cut, buckets)
            place = {chunk: n for n, chunk in enumerate(chunk for part in dealt for chunk in part)}
            codes = np.array([n for chunks in cut for n in map(place.__getitem__, chunks)], dtype=np.int64)
            names = pa.array(ids, type=pa.int64())
            packed = pa.RecordBatch.from_arrays([names], names=["doc_id"]).serialize().to_pybytes()
            yield to_batch({"block": [block], "sign": [sign], "doc_ids": [packed], "counts": [planes(np.array([len(c) for c in cut]))], "codes": [planes(codes)]}, schema["coded"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, known = load(shared.value), {}
        for batch in batches:
            replies = []
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                chunks = unpack(n, blob)
                if len(known) > KNOWN_CHUNKS:
                    known = {}
                new = [c for c in chunks if c not in known]
                known.update(zip(new, (np.array(ids, dtype="<u4").tobytes() for ids in segment(processor, new)), strict=True))
                found = [known[c] for c in chunks]
                counts = np.array([len(x) // 4 for x in found])
                replies.append(planes(np.concatenate((counts, np.frombuffer(b"".join(found), dtype="<u4")))))
            yield to_batch({"block": batch.column("block"), "bucket": batch.column("bucket"), "sign": batch.column("sign"), "n": batch.column("n"), "ids": replies}, schema["reply"])

    def join(coded: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        processor = load(shared.value)
        got = {b: (s, n, x) for b, s, n, x in zip(*(replies.column(c).to_pylist() for c in ("bucket", "sign", "n", "ids")), strict=True)}
        signs = {s for s, _, _ in got.values()}
        if coded.num_rows != 1 or signs - set(coded.column("sign").to_pylist()):
            raise ValueError("the documents were not read twice in the same order")
        lengths, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for bucket in sorted(got):
            _, n, blob = got[bucket]
            values = unplanes(blob)
            lengths.append(values[:n])
            ids.append(values[n:])
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        names = pa.ipc.read_record_batch(coded.column("doc_ids")[0].as_py(), pa.schema([("doc_id", pa.int64())])).column(0)
        counts, codes = unplanes(coded.column("counts")[0].as_py()), unplanes(coded.column("codes")[0].as_py())
        edges = np.concatenate(([0], np.cumsum(counts)))
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = codes[a:b]
            size = lengths[own]
            offset = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(own) else np.zeros(0, dtype=np.int64)
            tokens = ids[offset + np.arange(len(offset))]
            out.append((names[n].as_py(), tokens.astype(np.int32), processor.decode(tokens.tolist()) if len(tokens) else ""))
        columns = {"doc_id": [x[0] for x in out], "ids": [x[1] for x in out], "decoded": [x[2] for x in out]}
        return pa.Table.from_batches([to_batch(columns, schema["result"])])

    asked = rows.mapInArrow(ask, ASKED).repartition(buckets, "bucket")
    replies = asked.mapInArrow(answer, REPLY)
    coded = rows.mapInArrow(code, CODED)
    return coded.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(join, RESULT)
