"""WARC archives: one record per page, exact payload revisits, and reading that proves record boundaries.

Reading does not trust a magic number. Tasks scan fixed byte ranges of the files, take every place where a record could
begin as a candidate and work out where its successor would begin. Each candidate of a range is led along its chain out
of the range; pointer jumping over these links from the file's start keeps the candidates that are really reached. Magic
bytes inside payloads start chains that nothing leads to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retailscope.llm.common import map_arrow, shared_folder, stored, to_batch
from retailscope.session import cut_lineage

#: Payloads of fewer bytes are always kept whole.
REVISIT_BYTES = 100
#: Bytes of a file that one scan step looks for candidates in.
RANGE_BYTES = 4_000_000
#: Most tasks that read ranges; beyond it a task reads several.
MAX_TASKS = 20_000
_READ = 1 << 20
DATE = "2024-01-01T00:00:00Z"
GZIP_MAGIC, PLAIN_MAGIC = b"\x1f\x8b\x08", b"WARC/1."
RECORD = "path string, offset long, record_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _store(path: str):
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Pages with ``payload``, ``payload_digest``, ``payload_bytes`` and, for a repeated payload, ``first_id``.

    The first holder of each repeated payload comes from one partial aggregate; the join's large side is split by
    adaptive execution if one payload holds a large part of the pages.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = first.where("n > 1 and first_id is not null").drop("n")
    joined = rows.join(first.hint("merge"), "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload_digest", "payload_bytes", F.when(again, F.col("first_id")).alias("first_id"), F.when(~again, F.col("payload")).alias("payload"))


def _header_text(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str | None) -> str | None:
    """What ``_name`` was made of."""
    return (name or "")[len("<urn:page:") : -1] or None


def make_record(page_id, url: str | None, digest: str, size: int, payload: bytes | None, first_id=None) -> bytes:
    """A response with its HTTP head and payload, or, without payload, a revisit with the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(first_id)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, compress: bool = True) -> DataFrame:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) as WARC files; returns the manifest (file, path, size, n_records).

    Null html is an empty payload, a null url leaves the target out. Of equal payloads of at least ``REVISIT_BYTES``
    the smallest page_id is a response, the others revisit it; rows that repeat that id, or if no row has an id, are all
    responses. With ``compress``
    every record is a gzip member. The manifest is committed by Spark's writer: files of lost attempts are not in it.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    schema = "file long, path string, size long, n_records long"
    target = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        store, inner = _store(folder)
        store.create_dir(inner)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
        size = n = 0
        with store.open_output_stream(f"{inner}/{name}", compression=None) as file:
            while first is not None:
                for r in first.to_pylist():
                    record = make_record(r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], r["payload"], r["first_id"])
                    if compress:
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        record = packer.compress(record) + packer.flush()
                    file.write(record)
                    size, n = size + len(record), n + 1
                first = next(batches, None)
        if n:
            yield to_batch({"file": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"], "size": [size], "n_records": [n]}, target)

    return stored(mark_revisits(pages).mapInArrow(write, schema), "archives")


class RangeReader:
    """Bytes of a file by offset, read ahead in steps."""

    def __init__(self, path: str) -> None:
        store, inner = _store(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def get(self, offset: int, length: int) -> bytes:
        if not (self.start <= offset and offset + length <= self.start + len(self.held)):
            self.start, self.held = offset, self.file.read_at(max(length, _READ), offset) if offset < self.size else b""
        at = offset - self.start
        return self.held[at : at + length]

    def close(self) -> None:
        self.file.close()


def read_record(reader: RangeReader, offset: int) -> tuple[bytes, int] | None:
    """The record that begins at ``offset`` and where the next one would; None if none can begin there."""
    if reader.get(offset, 3) == GZIP_MAGIC:
        unpack, at, parts = zlib.decompressobj(31), offset, []
        try:
            while not unpack.eof:
                part = reader.get(at, min(1 << 16, reader.size - at)) if at < reader.size else b""
                if not part:
                    return None
                parts.append(unpack.decompress(part))
                at += len(part)
                if len(parts) == 1 and not parts[0].startswith(PLAIN_MAGIC[: len(parts[0])]):
                    return None
        except zlib.error:
            return None
        record = b"".join(parts)
        return (record, at - len(unpack.unused_data)) if record.startswith(PLAIN_MAGIC) else None
    if reader.get(offset, len(PLAIN_MAGIC)) != PLAIN_MAGIC:
        return None
    head = b""
    while b"\r\n\r\n" not in head:
        part = reader.get(offset + len(head), min(4096, reader.size - offset - len(head)))
        if not part or len(head) > 1 << 20:
            return None
        head += part
    head = head[: head.index(b"\r\n\r\n") + 4]
    length = _fields(head).get("content-length", "")
    end = offset + len(head) + int(length) + 4 if length.isdigit() else -1
    if end < 0 or end > reader.size or reader.get(end - 4, 4) != b"\r\n\r\n":
        return None
    return reader.get(offset, end - offset), end


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines if name.strip()}


def candidates(reader: RangeReader, start: int, end: int) -> dict[int, int]:
    """Every offset in the range where a record could begin, with its successor's offset."""
    found: dict[int, int] = {}
    for magic in (GZIP_MAGIC, PLAIN_MAGIC):
        window = reader.get(start, min(end + len(magic) - 1, reader.size) - start)
        at = window.find(magic)
        while at >= 0:
            record = read_record(reader, start + at)
            if record:
                found[start + at] = record[1]
            at = window.find(magic, at + 1)
    return found


def _ranges(manifest: DataFrame, range_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    cut = manifest.where("size > 0").select("file", "path", "size", F.explode(starts).alias("start"))
    return cut.select("file", "path", "size", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"))


def _dealt(ranges: DataFrame) -> DataFrame:
    """A task for about each range; without a number the small rows would be put into one task."""
    return ranges.repartition(max(1, min(ranges.count(), MAX_TASKS)), "file", "start")


def find_links(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Candidates with the offset where their chain leaves their range: ``file``, ``start`` of the range, ``offset``, ``leaves``."""

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"file": [], "start": [], "offset": [], "leaves": []}
        for r in batch.to_pylist():
            reader = RangeReader(r["path"])
            next_of = candidates(reader, r["start"], r["stop"])
            reader.close()
            leaves: dict[int, int] = {}
            for offset in sorted(next_of, reverse=True):
                leaves[offset] = leaves.get(next_of[offset], next_of[offset])
            for offset, leave in leaves.items():
                for name, value in zip(out, (r["file"], r["start"], offset, leave), strict=True):
                    out[name].append(value)
        return out

    ranges = _ranges(manifest, range_bytes)
    return map_arrow(_dealt(ranges), step, "file long, start long, offset long, leaves long")


def reachable(links: DataFrame) -> DataFrame:
    """The links whose offset the chain from the start of their file reaches, by pointer jumping.

    After round n the jumps lead over 2^n ranges and all links within 2^n ranges of the start are known, so the rounds
    are the logarithm of the ranges of the longest file.
    """
    jumps = cut_lineage(links.select("file", "offset", F.col("leaves").alias("to")))
    reached = cut_lineage(jumps.where("offset = 0").select("file", "offset"))
    n = reached.count()
    while n:
        onward = reached.join(jumps.hint("merge"), ["file", "offset"]).select("file", F.col("to").alias("offset"))
        known = jumps.select("file", "offset").hint("merge")
        grown = cut_lineage(reached.union(onward.join(known, ["file", "offset"], "left_semi")).distinct())
        before, n = n, grown.count()
        reached = grown
        if n == before:
            break
        far = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("further")).hint("merge")
        jumps = cut_lineage(jumps.join(far, ["file", "to"], "left").select("file", "offset", F.coalesce("further", "to").alias("to")))
    return links.join(reached.hint("merge"), ["file", "offset"], "left_semi")


def parse_record(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    size = int(_fields(http)["content-length"]) if kind == "revisit" else len(payload)
    return {
        "record_id": _id(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": _id(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records that the chains from the files' starts reach, with their payloads unless left out.

    A revisit has the digest and size of the payload it refers to and no payload of its own. A file whose chain breaks
    gives the records before the break. An empty manifest gives no records.
    """
    entries = reachable(cut_lineage(find_links(manifest, range_bytes)))
    entries = entries.groupBy("file", "start").agg(F.min("offset").alias("offset"))
    entries = entries.join(manifest.select("file", "path").hint("merge"), "file")
    names = ("record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader, at = RangeReader(r["path"]), r["offset"]
                out: dict[str, list] = {name: [] for name in ("path", "offset", *names)}
                while at < r["start"] + range_bytes and at < reader.size and (found := read_record(reader, at)):
                    record = parse_record(found[0])
                    for name in names:
                        out[name].append(record[name] if payloads or name != "payload" else None)
                    out["path"].append(r["path"])
                    out["offset"].append(at)
                    at = found[1]
                reader.close()
                yield to_batch(out, target)

    target = to_arrow_schema(manifest.sparkSession.createDataFrame([], RECORD).schema)
    return _dealt(cut_lineage(entries)).mapInArrow(run, RECORD)

