"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, linked) -> list[int]:
    """Smallest member of each member's component, by a plain search."""
    root = [-1] * n
    for start in range(n):
        if root[start] < 0:
            root[start], open_ = start, [start]
            while open_:
                at = open_.pop()
                for other in range(n):
                    if root[other] < 0 and linked(at, other):
                        root[other] = start
                        open_.append(other)
    return root


def near_copies(docs: list[tuple]) -> dict:
    """doc_id to (fingerprint, component), for documents sorted by id."""
    prints = [fingerprint(text) for _, text in docs]
    root = components(len(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    return {doc_id: (f"{prints[i]:016x}", docs[root[i]][0]) for i, (doc_id, _) in enumerate(docs)}


def repeats(docs: list[tuple], size: int = 50) -> list[tuple]:
    """Per document: length, removed bytes, spans, kept bytes; a null id is larger than any other."""
    rank = lambda i: float("inf") if i is None else i
    texts = [(rank(i), (t or "").encode()) for i, t in docs]
    first: dict[bytes, float] = {}
    for i, t in texts:
        for p in range(len(t) - size + 1):
            w = t[p : p + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < i:
                gone[p : p + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g), gone))
    return out


def contamination(docs: list[tuple], items: list[tuple], size: int = 10) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = WORD.findall(low(text))
        for i in range(max(1, len(words) - size + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for _, text in docs:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                who = windows.get(tuple(words[i : i + length]))
                if who:
                    hit |= set(range(i, i + length))
                    found |= who
        out.append((len(words), len(hit), sorted(found)))
    return out


def url_verdict(url: str | None, rules) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = low(host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def all_edits(initials, forced, cut):
    """Every way to edit a short conversation as (cost, letters), tried without any table."""

    def go(row, shape):
        for inserted in ("", "u", "a", "ua", "au"):
            paid, letters = 3 * len(inserted), "I" * len(inserted)
            if row == len(initials):
                yield paid, letters, shape + inserted
                continue
            kept = [] if forced[row] else [(0, "K", initials[row]), (3, "R", "u"), (3, "R", "a")]
            for cost, letter, initial in [(4, "D", None), *kept]:
                more = 3 if letter != "D" and cut[row] else 0
                for rest, tail, whole in go(row + 1, shape + inserted + ("" if initial is None else initial or "?")):
                    yield paid + cost + more + rest, letters + letter + tail, whole

    return min((c, x) for c, x, shape in go(0, "") if re.fullmatch(r"(s?(ua)+)?", shape))


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's (turn, role, text) in order."""
    space = " \t\n\x0b\x0c\r"
    seen, state, count = set(), {"": (0, "", ())}, [0, 0, 0]

    def grown(before, paid, letters, lines):
        found = dict(before)
        for shape, (cost, audit, text) in before.items():
            for initial, line in lines:
                after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[shape].get(initial)
                if after and (letters == "K" or initial != "s"):
                    found[after] = min(found.get(after, (10**9, "", ())), (cost + paid, audit + letters, (*text, line)))
        return found

    def inserted(before):
        for _ in range(3):
            before = grown(before, 3, "I", [("u", "user:"), ("a", "assistant:")])
        return before

    for _, role, text in rows:
        left = text.rstrip(space)
        fault = 0 if not left.strip(space) else 1 if (role, text) in seen else 2 if left[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            count[fault] += 1
        options = inserted(state)
        state = {s: (c + 4, a + "D", t) for s, (c, a, t) in options.items()}
        if fault >= 2:
            more = 3 if fault == 2 else 0
            for paid, letter, lines in ((more, "K", [(role[:1], f"{role}:{text}")]), (3 + more, "R", [("u", f"user:{text}"), ("a", f"assistant:{text}")])):
                for s, option in options.items():
                    for after, value in grown({s: option}, paid, letter, lines).items():
                        if value is not option:
                            state[after] = min(state.get(after, (10**9, "", ())), value)
    final = inserted(state)
    cost, audit, lines = min(final[s] for s in ("", "a") if s in final)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *count, illegal, cost, audit, sha("\n".join(lines).encode()))


def damaged(rows):
    """Conversations after damage: id to its ordered (turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        held = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for held in found.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(str(len(r[1].encode())).encode() + b" " + (r[1] + r[2]).encode())))
    return found


def collocations(rows, least, top):
    """Rows of (lang, rank, phrase, a, l, r, n, score) of (lang, text), by counting every phrase."""
    counts, totals = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low(text)):
            words = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    key = lang, tuple(words[i : i + m])
                    counts[key] = counts.get(key, 0) + 1
    kept = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    inside = set()
    for (lang, words), f in counts.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if 100 * f >= 100 * counts[lang, words[i : i + size]]:
                    inside.add((lang, words[i : i + size]))
    out = []
    for lang in totals:
        found = []
        for (of, words), a in kept.items():
            if of == lang and (lang, words) not in inside:
                cuts = ((1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words)))
                score, k = min(cuts)
                found.append((-score, -a, " ".join(words).encode(), " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
        out += [(lang, n, *row[3:]) for n, row in enumerate(sorted(found)[:top], 1)]
    return out


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def phrase_places(text):
    """(n_words, n_base, first_word, last_word, base_labels) by comparing every place with every phrase."""
    words, places, labels = WORD.findall(low(text)), [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def longest_runs(words, template):
    """After each word the longest run ending there that occurs in the template."""
    found = []
    for i in range(len(words)):
        size = 0
        while size <= i and any(template[j : j + size + 1] == words[i - size : i + 1] for j in range(len(template) - size)):
            size += 1
        found.append(size)
    return found
