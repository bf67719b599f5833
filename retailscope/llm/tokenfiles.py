"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id; each task encodes its documents and writes one file of ids, one of offsets and
one of document ids. A manifest row per file is committed with Spark's own writer, so files of lost or repeated attempts
are never read. The start of a file among all ids is the prefix sum of the counts before it.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retailscope.llm.common import shared_folder, stored, to_batch

END_ID = 0
#: Characters of text whose chunks are looked up together, and chunks that a task remembers.
SLICE_CHARS, KNOWN_CHUNKS = 2_000_000, 300_000
#: Pieces encoded in one text, texts encoded at once (the library's results are large), and the byte-level alphabet's letter for a space.
RUN_PIECES, BATCH_TEXTS, SPACE = 200, 16, "\u0120"
#: Letters of words that need no pattern, and what may be cut off behind a letter: no pre-token holds it there.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", string.punctuation
#: White space of three bytes, as numbers; U+180E was one in older Unicode.
WIDE_SPACES = [int.from_bytes(c.encode()) for c in map(chr, range(0x800, 0xD800)) if c.isspace() or c == "\u180e"]
#: How a missing document id is written.
NO_ID = np.iinfo(np.int64).min
MANIFEST = "part long, path string, n_docs long, n_tokens long, width int"
_WORD = re.compile(f" [{LETTERS}]+\\Z")


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct chunk once while a task remembers it.

    A space after a non-space always begins a new pre-token of a byte-level tokenizer, and so does punctuation after a letter;
    texts can be cut there and the ids of the chunks joined. Texts are cut and joined as arrays, Python sees a chunk once a slice.
    Chunks not asked for since ``KNOWN_CHUNKS`` others were learned are forgotten.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(model)
        # For words, written in the byte-level alphabet: no pattern has to be matched.
        self.words = Tokenizer.from_str(model)
        self.words.pre_tokenizer = WhitespaceSplit()
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {ord(c): spell(c)[0][0] for c in map(chr, range(0x250)) if _WORD.match(f" {c}")}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True
        # A cut is where the bits of a byte meet those of the byte before. Added tokens are never cut at a mark.
        self.here, self.before = np.zeros(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
        added = "".join(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        self.here[[ord(c) for c in MARKS if c not in added]] = 1
        self.here[ord(" ")] = 2
        self.before[0x21:0x7F] = 2
        self.before[[ord(c) for c in string.ascii_letters]] = 3

    def _ids(self, texts: list[str], words: bool = False) -> list[bytes]:
        encode, out = (self.words if words else self.tokenizer).encode_batch_fast, []
        for i in range(0, len(texts), BATCH_TEXTS):
            out += [np.array(x.ids, dtype=self.kind).tobytes() for x in encode(texts[i : i + BATCH_TEXTS], add_special_tokens=False)]
        return out

    def _learn_runs(self, pieces: list[str], words: bool) -> list[str]:
        """Ids of pieces that hold one opening token each, encoded many in one text; returns those that do not."""
        width, other = self.kind.itemsize, []
        runs = [pieces[i : i + RUN_PIECES] for i in range(0, len(pieces), RUN_PIECES)]
        joined = ["".join(run) for run in runs]
        if words:
            joined = [(text if text.isascii() else text.translate(self.alphabet)).replace(" ", f" {SPACE}") for text in joined]
        for run, coded in zip(runs, self._ids(joined, words), strict=True):
            starts = np.flatnonzero(self.opens[np.frombuffer(coded, dtype=self.kind)]) * width
            if len(starts) != len(run):
                other += run
                continue
            edges = [*starts.tolist(), len(coded)]
            self.known.update((piece, coded[a:b]) for piece, a, b in zip(run, edges[:-1], edges[1:], strict=True))
        return other

    def _learn(self, pieces: list[str]) -> None:
        """Ids of distinct pieces."""
        words = list(filter(_WORD.match, pieces))
        rest = set(pieces).difference(words)
        plain = [p for p in rest if p[0] == " " and " " not in p[1:] and not p[1:2].isspace() and not p[-1].isspace()]
        other = list(rest.difference(plain)) + self._learn_runs(words, True) + self._learn_runs(plain, False)
        self.known.update(zip(other, self._ids(other), strict=True))

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those not remembered are learned."""
        if len(self.known) > KNOWN_CHUNKS:
            self.known, self.older = {}, self.known
        coded = list(map(self.known.get, pieces))
        missing = [piece for piece, ids in zip(pieces, coded, strict=True) if ids is None]
        again = {piece: ids for piece, ids in zip(missing, map(self.older.get, missing), strict=True) if ids is not None}
        self.known.update(again)
        self._learn([piece for piece in missing if piece not in again])
        return [self.known[piece] if ids is None else ids for piece, ids in zip(pieces, coded, strict=True)]

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        """Places in UTF-8 bytes where a pre-token surely begins, before a space or a mark."""
        here, before = self.here[raw[1:]], raw[:-1]
        places = np.flatnonzero(here & self.before[before]) + 1
        wide = np.flatnonzero((here != 0) & (before >= 0x80)) + 1
        last, lead, first = (raw[wide - i].astype(np.int64) for i in (1, 2, 3))
        latin = (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        blank = (lead == 0xC2) | np.isin(first << 16 | lead << 8 | last, WIDE_SPACES)
        return np.concatenate((places, wide[np.where(raw[wide] == ord(" "), ~blank, latin)]))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes of ``kind``."""
        coded = [text.encode() for text in texts]
        data, bounds = b"".join(coded), np.cumsum([0, *map(len, coded)])
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self._cuts(np.frombuffer(data, dtype=np.uint8))] = True
        edge[bounds] = True
        edges = np.flatnonzero(edge)
        chunks = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self._look_up(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), type=pa.large_binary()).take(chunks.indices)
        held = pa.ListArray.from_arrays(pa.array(np.searchsorted(edges, bounds), type=pa.int32()), ids)
        yield from pc.binary_join(held, pa.scalar(b"", type=ids.type)).to_pylist()


def slices(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all ids of ``docs`` (``doc_id`` long, ``text``) in ascending doc_id order; returns the manifest.

    A null text is empty; every document ends with ``end_id``. Documents without id come first; those of one id follow
    each other in the order read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    with open(tokenizer_path) as file:
        shared = spark.sparkContext.broadcast({"model": file.read()})
    target = to_arrow_schema(spark.createDataFrame([], MANIFEST).schema)
    token = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        encoder = held.setdefault("encoder", None) or ChunkEncoder(held["model"])
        held["encoder"] = encoder
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        first = next(batches, None)
        if first is None:
            return
        store, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        store.create_dir(path)
        name = f"{token}-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        with store.open_output_stream(f"{path}/{name}.ids") as ids, store.open_output_stream(f"{path}/{name}.offsets") as offsets, store.open_output_stream(f"{path}/{name}.docs") as names:
            offsets.write(np.zeros(1, dtype="<u8").tobytes())
            for batch in _chain(first, batches):
                keys = batch.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
                names.write(keys.astype("<i8").tobytes())
                for part in slices(batch.column("text").to_pylist()):
                    coded = [x + end for x in encoder.encode(part)]
                    ids.write(b"".join(coded))
                    ends = n_tokens + np.cumsum([len(x) // encoder.kind.itemsize for x in coded])
                    offsets.write(ends.astype("<u8").tobytes())
                    n_docs, n_tokens = n_docs + len(part), int(ends[-1])
        if n_docs:
            row = {"part": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": [encoder.kind.itemsize]}
            yield to_batch(row, target)

    rows = docs.select("doc_id", "text").withColumn("_order", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order")
    manifest = stored(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")
    drop_orphans(manifest, folder, token)
    return manifest


def _chain(first, rest):
    yield first
    yield from rest


def drop_orphans(manifest: DataFrame, folder: str, token: str) -> None:
    """Deletes files of this write's attempts that were not committed; their names begin with its ``token``.

    Files of other writes and of others stay. There are as many names as files.
    """
    store, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
    keep = {r[0].rsplit("/", 1)[-1] for r in manifest.select("path").collect()}
    for info in store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.startswith(f"{token}-") and info.base_name.partition(".")[0] not in keep:
            store.delete_file(info.path)


def _mapped(path: str, kind: str) -> np.ndarray:
    """A file's numbers: mapped where the folder is mounted, else read from the store."""
    store, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return np.memmap(inner, dtype=kind, mode="r")
    with store.open_input_file(inner) as file:
        return np.frombuffer(file.read(), dtype=kind)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` among all ids, ``n_tokens``, ``ids_crc32``.

    The checksum is over the ids as little-endian unsigned 32-bit integers. One file is one task's work.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    target = to_arrow_schema(manifest.sparkSession.createDataFrame([], schema).schema)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n_files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(f"{row['path']}.ids", f"<u{row['width']}")
                offsets = _mapped(f"{row['path']}.offsets", "<u8").astype(np.int64)
                keys = _mapped(f"{row['path']}.docs", "<i8")
                if len(keys) != row["n_docs"] or len(ids) != row["n_tokens"]:
                    raise ValueError(f"{row['path']} does not match the manifest")
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                names = pa.array(np.array(keys), mask=np.array(keys == NO_ID))
                yield to_batch({"doc_id": names, "start": row["base"] + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": sums}, target)

    return based.repartition(n_files, "part").mapInArrow(read, schema)
