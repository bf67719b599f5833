"""Token counts per section: whole documents are encoded once, token spans are joined with section spans.

A byte-level tokenizer's tokens tile the text's bytes, so token edges are running sums of token lengths. Sections are
lines, each with its line feed. A token that crosses section edges goes whole to the section that holds most of its
bytes, of equal ones to the earliest.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from retailscope.llm.common import map_arrow
from retailscope.llm.tokenfiles import slices

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def section_edges(raw: np.ndarray) -> np.ndarray:
    """Byte edges of the lines; an empty text is one empty line, a final line feed opens none."""
    ends = np.flatnonzero(raw == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate(([0], ends))


def allocate(token_edges: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and edge-crossing tokens per section, by the rule above."""
    n = len(edges) - 1
    start, end = token_edges[:-1], token_edges[1:]
    first = np.searchsorted(edges, start, side="right") - 1
    last = np.searchsorted(edges, end, side="left") - 1
    owner, crossing = first.copy(), last > first
    for token in np.flatnonzero(crossing):
        parts = np.diff(np.clip(edges[first[token] : last[token] + 2], start[token], end[token]))
        owner[token] += int(np.argmax(parts))
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Every section of every document: ``doc_id``, ``section`` (from 0), its character span, ``n_tokens``,
    ``n_crossing`` (tokens among them that reach into another section) and the document's ``doc_tokens``.

    docs: ``doc_id`` long and ``text``; other columns are not read. A null or empty text is one empty section without
    tokens. Repeated documents give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": load_ranks(ranks_path)})

    def step(batch: pa.RecordBatch) -> dict:
        held = shared.value
        if "encoding" not in held:
            import tiktoken

            held["encoding"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=held["ranks"], special_tokens={})
            lengths = np.zeros(max(held["ranks"].values()) + 1, dtype=np.int64)
            for token, rank in held["ranks"].items():
                lengths[rank] = len(token)
            held["lengths"] = lengths
        encode, lengths = held["encoding"].encode_ordinary, held["lengths"]
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        rows = []
        for part in slices(batch.column("text").to_pylist()):
            for text in part:
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                token_edges = np.concatenate(([0], np.cumsum(lengths[encode(text)])))
                edges = section_edges(raw)
                counts, crossing = allocate(token_edges, edges)
                chars = edges if len(raw) == len(text) else np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[edges]
                n = len(counts)
                rows.append(n)
                for held_back, values in zip(out, (np.arange(n), chars[:-1], chars[1:], counts, crossing, np.full(n, len(token_edges) - 1)), strict=True):
                    held_back.append(values)
        ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), rows)))
        joined = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]
        return dict(zip(("doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"), (ids, *joined), strict=True))

    return map_arrow(docs.select("doc_id", "text"), step, SCHEMA)
