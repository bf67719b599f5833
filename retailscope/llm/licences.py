"""Licence scans: a generalised suffix automaton of the templates' words, read over the texts.

The automaton's states are the classes of word runs that occur in some template. Reading a text gives its matching
statistics: after each word, the longest run ending there that occurs in a template, and its state. A phrase to be found whole
occurs where its state lies on the suffix links from there. Other templates are found by chaining: matches that cannot grow
are put in line when both text and template go forward and neither leaves too wide a gap, and a chain that covers enough of
its template is a span of it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retailscope.llm.common import to_batch

#: Shortest match that is chained, widest gap in words in text or template, and the part of a template to be covered.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 12, 0.6
#: Words of templates in one automaton (a few MB); more templates are scanned for by several, one after another.
PART_WORDS = 50_000
#: Bytes of text whose words are looked up together.
SLICE_BYTES = 4_000_000
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
SPAN = "struct<label: string, template: int, first_word: long, last_word: long, covered: long, cover: double>"
FOUND = f"n_words long, n_whole long, first_word long, last_word long, whole_labels array<string>, spans array<{SPAN}>, cover double"


class Template(NamedTuple):
    """A text to be found: ``whole`` for a phrase whose every word must stand in a row."""

    label: str
    text: str
    whole: bool = False


# Phrases that must be found, with their labels.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

# Notices as their publishers give them.
NOTICES = (
    Template("mit", "under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of a text, lower case, in slices that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        part = text[at:end].translate(_WORDS)
        while end < len(text) and part[-1] != 32:
            more = text[end : end + 4096].translate(_WORDS)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        yield part.split()
        at = end


class Automaton:
    """The suffix automaton of several word sequences; state 0 is the empty run."""

    def __init__(self, sequences: Sequence[Sequence[int]], whole: Sequence[bool]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, set[int]]] = [{}]
        for t, sequence in enumerate(sequences):
            state = 0
            for word in sequence:
                state = self._extend(state, word)
            state = 0
            for i, word in enumerate(sequence):
                state = self.step[state][word]
                while len(ends) < len(self.length):
                    ends.append({})
                ends[state].setdefault(t, set()).add(i + 1)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for t, places in ends[state].items():
                ends[self.link[state]].setdefault(t, set()).update(places)
        #: Per state and template to be chained, where its runs end there.
        self.places = [{t: sorted(found) for t, found in held.items() if not whole[t]} if s else {} for s, held in enumerate(ends)]
        #: Per state each template that holds the end of its runs: longest such end and the state of that.
        self.longest: list[list[tuple[int, int, int]]] = [[] for _ in self.length]
        #: Per state the whole phrases that end with its runs: (length, template), those of shorter runs included.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for t, sequence in enumerate(sequences):
            if whole[t] and sequence:
                state = 0
                for word in sequence:
                    state = self.step[state][word]
                self.whole[state].append((len(sequence), t))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.whole[state] += self.whole[self.link[state]]
            if self.length[state] >= MIN_MATCH:
                more = [x for x in self.longest[self.link[state]] if x[0] not in self.places[state]]
                self.longest[state] = [(t, self.length[state], state) for t in self.places[state]] + more

    def _new(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        """A state for the runs of ``state`` that are no longer than one word more than those of ``before``."""
        twin = self._new(dict(self.step[state]), self.link[state], self.length[before] + 1)
        self.link[state] = twin
        while before >= 0 and self.step[before].get(word) == state:
            self.step[before][word] = twin
            before = self.link[before]
        return twin

    def _extend(self, last: int, word: int) -> int:
        state = self.step[last].get(word)
        if state is not None:
            return state if self.length[state] == self.length[last] + 1 else self._split(last, word, state)
        grown, before = self._new({}, 0, self.length[last] + 1), last
        while before >= 0 and word not in self.step[before]:
            self.step[before][word] = grown
            before = self.link[before]
        if before >= 0:
            state = self.step[before][word]
            self.link[grown] = state if self.length[state] == self.length[before] + 1 else self._split(before, word, state)
        return grown

    def read(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word the state and length of the longest run that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            after = self.step[state].get(word)
            state, length = (after, length + 1) if after is not None else (0, 0)
            yield state, length


class Scanner:
    """Templates ready to be looked for."""

    def __init__(self, templates: Sequence[tuple[int, Template]]) -> None:
        self.numbers: dict[bytes, int] = {}
        sequences = []
        for _, template in templates:
            found = [w for part in words_of(template.text.encode("utf-8", "surrogatepass")) for w in part]
            sequences.append([self.numbers.setdefault(w, len(self.numbers)) for w in found])
        self.indexes = [i for i, _ in templates]
        self.labels = [t.label for _, t in templates]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences, [t.whole for _, t in templates])
        #: Template words that follow each other, as one number; and phrases of a single word.
        pairs = {a * len(self.numbers) + b for s in sequences for a, b in zip(s[:-1], s[1:], strict=True)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.singles = np.array(sorted({s[0] for s, (_, t) in zip(sequences, templates, strict=True) if t.whole and len(s) == 1}), dtype=np.int64)

    def numbered(self, text: bytes) -> np.ndarray:
        """Words as numbers of the templates' words, others as -1."""
        get = self.numbers.get
        parts = [np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words)) for words in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def stretches(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where something can be found: runs of words whose neighbours follow each other in some template."""
        if not len(words):
            return
        follows = np.zeros(len(words) + 1, dtype=bool)
        if len(self.pairs) and len(words) > 1:
            a, b = words[:-1], words[1:]
            keys = np.where((a >= 0) & (b >= 0), a * len(self.numbers) + b, -1)
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            follows[1:-1] = self.pairs[at] == keys
        alone = np.isin(words, self.singles) & ~follows[:-1] & ~follows[1:]
        edges = np.flatnonzero(np.diff(follows.astype(np.int8)))
        found = [(int(s), int(e) + 1) for s, e in zip(edges[::2], edges[1::2], strict=True)]
        yield from sorted(found + [(int(i), int(i) + 1) for i in np.flatnonzero(alone)])

    def scan(self, text: bytes) -> dict:
        words = self.numbered(text)
        n, first, last, labels = 0, None, None, set()
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        automaton = self.automaton
        for start, end in self.stretches(words):
            before: dict[int, tuple[int, int]] = {}
            for at, (state, length) in enumerate((*automaton.read(words[start:end].tolist()), (0, 0)), start):
                now = {t: (min(length, most), of) for t, most, of in automaton.longest[state] if length >= MIN_MATCH}
                for t, (size, of) in before.items():
                    if now.get(t, (0, 0))[0] <= size:
                        matches[t] += ((at, place, size) for place in automaton.places[of][t])
                before = now
                for size, t in automaton.whole[state]:
                    if size <= length:
                        n, place = n + 1, at - size + 1
                        first, last = place if first is None else min(first, place), place if last is None else max(last, place)
                        labels.add(self.labels[t])
        spans = [span for t, found in matches.items() for span in self.chains(t, found)]
        return {"n_words": len(words), "n_whole": n, "first_word": first, "last_word": last, "whole_labels": labels, "spans": spans}

    def chains(self, t: int, found: list[tuple[int, int, int]]) -> Iterator[dict]:
        """Spans of a template: chains of matches (end in text, end in template, length) that cover enough of it, the fullest
        first, none over another."""
        size = self.sizes[t]
        cover, start, oldest = [], [], 0
        widest = max(length for _, _, length in found)
        for i, (end, place, length) in enumerate(found):
            while found[oldest][0] < end - widest - MAX_GAP:
                oldest += 1
            best, begin = length, end - length
            for j in range(oldest, i):
                far, near = end - found[j][0], place - found[j][1]
                if far > 0 and near > 0 and far - length <= MAX_GAP and near - length <= MAX_GAP:
                    grown = cover[j] + min(length, far, near)
                    if grown > best:
                        best, begin = grown, start[j]
            cover.append(best)
            start.append(begin)
        taken: list[tuple[int, int]] = []
        for i in sorted(range(len(found)), key=lambda i: (-cover[i], found[i][0])):
            if cover[i] < MIN_COVER * size:
                break
            a, b = start[i], found[i][0]
            at = bisect_left(taken, (a, b))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                continue
            insort(taken, (a, b))
            yield {"label": self.labels[t], "template": self.indexes[t], "first_word": a, "last_word": b - 1, "covered": cover[i], "cover": cover[i] / size}


def _parts(templates: Sequence[Template]) -> Iterator[list[tuple[int, Template]]]:
    part, size = [], 0
    for i, template in enumerate(templates):
        n = len(template.text.split())
        if part and size + n > PART_WORDS:
            yield part
            part, size = [], 0
        part.append((i, template))
        size += n
    yield part


def scan_licences(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``; ``n_whole``, ``first_word``, ``last_word`` and ``whole_labels`` of the phrases
    found whole (places count each, overlaps included; words from 0, null if none); ``spans`` of the other templates in order,
    with the words of the template they cover, none where another covers more; and ``cover``, the greatest part of a template
    covered, 0 to 1.

    A null text is empty; rows with null or repeated keys are scanned like any other; other columns are not read. Without
    templates nothing is found. Labels are distinct and sorted. Texts are read whole, in slices.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], FOUND).schema
    types = {f.name: f.dataType for f in empty}
    held = docs.select(F.col(key), F.col("text").cast("binary").alias("text"), F.struct(*[F.lit(None).cast(types[n]).alias(n) for n in types]).alias("found"))
    schema, target = held.schema, to_arrow_schema(held.schema)
    parts = list(_parts(templates))
    for part in parts:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=part is parts[-1]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value)
            for batch in batches:
                texts, before = batch.column("text"), batch.column("found").to_pylist()
                found = [merged(old, scanner.scan(text.as_py() or b""), last) for text, old in zip(texts, before, strict=True)]
                yield to_batch({key: batch.column(key), "text": pa.nulls(len(found), pa.binary()) if last else texts, "found": found}, target)

        held = held.mapInArrow(run, schema)
    return held.select(key, "found.*")


def fullest(spans: list[dict]) -> list[dict]:
    """Spans without those that meet one which covers more words of its template, as a later version's notice does."""
    taken: list[list[int]] = []
    kept = []
    for _, group in groupby(sorted(spans, key=lambda s: -s["covered"]), key=lambda s: s["covered"]):
        free = []
        for s in group:
            at = bisect_left(taken, [s["last_word"] + 1])
            if not at or taken[at - 1][1] < s["first_word"]:
                free.append(s)
        kept += free
        joined: list[list[int]] = []
        for a, b in sorted(taken + [[s["first_word"], s["last_word"]] for s in free]):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        taken = joined
    return kept


def merged(old: dict, new: dict, last: bool) -> dict:
    """What an earlier part of the templates has found, and what this one has; ``last`` lets spans of one place compete."""
    places = [p for p in (old["first_word"], old["last_word"], new["first_word"], new["last_word"]) if p is not None]
    found = (old["spans"] or []) + new["spans"]
    spans = sorted(fullest(found) if last else found, key=lambda s: (s["first_word"], s["last_word"], s["template"]))
    whole = (old["n_whole"] or 0) + new["n_whole"]
    return {
        "n_words": new["n_words"], "n_whole": whole, "first_word": min(places, default=None), "last_word": max(places, default=None),
        "whole_labels": sorted({*(old["whole_labels"] or ()), *new["whole_labels"]}), "spans": spans,
        "cover": max([1.0 if whole else 0.0, *(min(1.0, s["cover"]) for s in spans)]),
    }
