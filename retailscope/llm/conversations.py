"""Conversation repair: the cheapest edits that make turns alternate, by Hirschberg's divide and conquer.

A repaired conversation is empty or an optional system turn followed by pairs of user and assistant. Reading it takes four
states: nothing yet, system, user, assistant. Over any stretch of rows the cheapest edits are a four-by-four table of costs
(state before, state after), so a stretch is known by 32 small numbers, and two stretches meet in four states: forward costs
of the left and backward costs of the right one choose the crossing, and each half is solved by itself. The same recursion
runs over pieces of a long conversation, solved in different tasks, and over the rows of a piece.

Edits are written as letters: Keep, Rerole (to user or assistant, as the place asks), Delete, Insert (an empty turn). Inserts
are written before the row they precede, so stretches of as many rows end in a row's letter, no such string begins another,
and of equally cheap ones the least is known from the ranks of the left strings alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from retailscope.llm.common import map_arrow, stored, to_batch

#: Rows and bytes of text of a conversation that one task solves at once.
PIECE_ROWS, PIECE_BYTES = 20_000, 2_000_000
#: Solutions of short conversations that a task remembers, and what is short.
KNOWN, SHORT = 50_000, 24
#: Pieces and bytes of output in one Arrow batch.
BATCH, BATCH_BYTES = 2000, 8_000_000

RESTORE, DELETE, REROLE, INSERT, TRUNCATED = 0, 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that an inserted or reroled turn leads to, and the inserts that end a conversation.
NEXT = (USER, USER, ASSISTANT, USER)
ENDING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: What a kept turn leads to, by state and initial of its role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = frozenset(("su", "ua", "au"))
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
FAR = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"
#: Classes of rows: forced out, or the role's initial with a mark if the text is cut off.
GONE, INITIALS = 0, ("s", "u", "a", "")

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, n_turns long, repaired binary"
RAW = "turns array<long>, roles array<string>, texts array<binary>, digests array<binary>"
FLAGS = "classes binary, blank long, duplicate long, truncated long, initials array<string>, ends array<long>, costs array<int>, ranks array<int>"


def class_of(initial: str, truncated: bool) -> int:
    return 1 + 2 * (INITIALS.index(initial) if initial in INITIALS else 3) + truncated


def _edits(kind: int) -> list[list[tuple[int, str]]]:
    """Cheapest, then least letters from state to state over one row of a class."""
    best = [[(FAR, "") for _ in STATES] for _ in STATES]
    for p in STATES:
        state, paid, letters = p, 0, ""
        for _ in range(3):
            options = [(state, DELETE, "D")]
            if kind != GONE:
                more = TRUNCATED * ((kind - 1) % 2)
                options.append((NEXT[state], REROLE + more, "R"))
                kept = KEPT.get((state, INITIALS[(kind - 1) // 2]))
                if kept is not None:
                    options.append((kept, RESTORE + more, "K"))
            for q, cost, letter in options:
                best[p][q] = min(best[p][q], (paid + cost, letters + letter))
            state, paid, letters = NEXT[state], paid + INSERT, letters + "I"
    return best


EDITS = [_edits(kind) for kind in range(1 + 2 * len(INITIALS))]


def _ranked(values: list) -> tuple[int, ...]:
    order = {v: i for i, v in enumerate(sorted(set(values)))}
    return tuple(order[v] for v in values)


#: Per class: costs and, per state before, the ranks of the letters by state after.
STEPS = [([[c for c, _ in row] for row in table], [_ranked([e for _, e in row]) for row in table]) for table in EDITS]


def forward(costs: tuple, ranks: tuple, step: tuple) -> tuple[tuple, tuple]:
    """Costs of the four states after a stretch, and the order of the least letters that lead to them."""
    table, order = step
    reached, keys = [], []
    for q in STATES:
        cost, rank, p = min((costs[p] + table[p][q], ranks[p], p) for p in STATES)
        reached.append(min(cost, FAR))
        keys.append((rank, order[p][q]) if cost < FAR else (FAR, q))
    return tuple(reached), _ranked(keys)


def backward(costs: tuple, step: tuple) -> tuple:
    """Costs from each state before a stretch to the end, given those after it."""
    table = step[0]
    return tuple(min(FAR, *(table[p][q] + costs[q] for q in STATES)) for p in STATES)


def at(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in STATES)


def crossing(left: tuple, right: tuple) -> int:
    """The state in which two stretches meet: cheapest in all, then the least letters on the left."""
    costs, ranks = left
    return min(STATES, key=lambda s: (costs[s] + right[s], ranks[s]))


class Rows:
    """Row classes with remembered steps: costs are kept relative to the least, of which there are few."""

    def __init__(self) -> None:
        self.ahead: dict[tuple, tuple] = {}
        self.back: dict[tuple, tuple] = {}
        self.solved: dict[tuple, str] = {}

    def forward(self, vector: tuple, kind: int) -> tuple[tuple, int]:
        found = self.ahead.get((vector, kind))
        if found is None:
            costs, ranks = forward(*vector, STEPS[kind])
            least = min(costs)
            found = (tuple(c - least if c < FAR else FAR for c in costs), ranks), least
            self.ahead[vector, kind] = found
        return found

    def backward(self, vector: tuple, kind: int) -> tuple:
        found = self.back.get((vector, kind))
        if found is None:
            costs = backward(vector, STEPS[kind])
            least = min(costs)
            found = self.back[vector, kind] = tuple(c - least if c < FAR else FAR for c in costs)
        return found

    def after(self, kinds: bytes, first: int, last: int, state: int) -> tuple[tuple, int]:
        vector, paid = (at(state), (0, 0, 0, 0)), 0
        for i in range(first, last):
            vector, more = self.forward(vector, kinds[i])
            paid += more
        return vector, paid

    def summary(self, kinds: bytes) -> tuple[list[int], list[int]]:
        """Costs and ranks by state before and after, in one list each."""
        costs: list[int] = []
        ranks: list[int] = []
        for state in STATES:
            (relative, order), paid = self.after(kinds, 0, len(kinds), state)
            costs += [c + paid if c < FAR else FAR for c in relative]
            ranks += order
        return costs, ranks

    def solve(self, kinds: bytes, enter: int, leave: int) -> str:
        """The letters for the rows, from state to state."""
        key = (kinds, enter, leave)
        if len(kinds) <= SHORT and key in self.solved:
            return self.solved[key]
        letters: list[str] = []
        stretches = [(0, len(kinds), enter, leave)]
        while stretches:
            first, last, p, q = stretches.pop()
            if last - first <= 1:
                letters += (EDITS[kinds[i]][p][q][1] for i in range(first, last))
                continue
            middle = (first + last) // 2
            left, _ = self.after(kinds, first, middle, p)
            right = at(q)
            for i in range(last - 1, middle - 1, -1):
                right = self.backward(right, kinds[i])
            met = crossing(left, right)
            stretches += [(middle, last, met, q), (first, middle, p, met)]
        found = "".join(letters)
        if len(kinds) <= SHORT:
            if len(self.solved) >= KNOWN:
                self.solved.clear()
            self.solved[key] = found
        return found

    def leave(self, kinds: bytes, enter: int = START) -> int:
        """The state in which the cheapest, then least letters of a whole conversation leave its rows."""
        left, _ = self.after(kinds, 0, len(kinds), enter)
        return crossing(left, tuple(cost for cost, _ in ENDING))


def solve_pieces(summaries: list[tuple]) -> list[int]:
    """The states in which the pieces of a conversation are left, by the same recursion over their summaries."""
    steps = [([c[i : i + 4] for i in range(0, 16, 4)], [r[i : i + 4] for i in range(0, 16, 4)]) for c, r in summaries]
    left = (at(START), (0, 0, 0, 0))
    for step in steps:
        left = forward(*left, step)
    found = [0] * len(steps)
    if not steps:
        return found
    found[-1] = crossing(left, tuple(cost for cost, _ in ENDING))
    stretches = [(0, len(steps), START, found[-1])]
    while stretches:
        first, last, p, q = stretches.pop()
        if last - first <= 1:
            continue
        middle = (first + last) // 2
        left, right = (at(p), (0, 0, 0, 0)), at(q)
        for step in steps[first:middle]:
            left = forward(*left, step)
        for step in reversed(steps[middle:last]):
            right = backward(right, step)
        met = found[middle - 1] = crossing(left, right)
        stretches += [(middle, last, met, q), (first, middle, p, met)]
    return found


def judge(roles: list[str], texts: list[bytes], digests: list[bytes], earlier: frozenset | set = frozenset()) -> tuple[bytes, int, int, int]:
    """Classes of the rows and how many are blank, duplicate and truncated; each row's first fault counts."""
    seen = set(earlier)
    kinds, blank, duplicate, truncated = bytearray(), 0, 0, 0
    for role, text, digest in zip(roles, texts, digests, strict=True):
        held = text.rstrip(SPACE)
        if not held:
            blank += 1
            kinds.append(GONE)
        elif digest in seen:
            duplicate += 1
            kinds.append(GONE)
        else:
            cut = held[-1:] not in b".!?"
            truncated += cut
            kinds.append(class_of(role[:1], cut))
        seen.add(digest)
    return bytes(kinds), blank, duplicate, truncated


def gaps_of(turns: list[int | None]) -> int:
    """Missing turns between the first and the last of ascending turns, nulls aside."""
    known = [t for t in turns if t is not None]
    return known[-1] - known[0] + 1 - len(set(known)) if known else 0


def illegal_of(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))


def replay(kinds: bytes, letters: str, enter: int, roles: list[str], texts: list[bytes]) -> tuple[int, int, bytes]:
    """Cost, number of turns and text of the repaired rows."""
    state, cost, row, lines = enter, 0, 0, []
    for letter in letters:
        if letter == "D":
            cost, row = cost + DELETE, row + 1
            continue
        if letter == "I":
            state, cost = NEXT[state], cost + INSERT
            lines.append(ROLES[state] + b":")
            continue
        cost += TRUNCATED * ((kinds[row] - 1) % 2)
        if letter == "R":
            state, cost = NEXT[state], cost + REROLE
            lines.append(ROLES[state] + b":" + texts[row])
        else:
            state = KEPT[state, INITIALS[(kinds[row] - 1) // 2]]
            lines.append(roles[row].encode("utf-8", "surrogatepass") + b":" + texts[row])
        row += 1
    return cost, len(lines), b"\n".join(lines)


def damage_turns(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20, a null being one space throughout.

    0 drops the row (it stays with ``present`` false, so that its conversation is known), 1 empties the text, 2 removes its
    ``.``, ``!`` and ``?``, 3 repeats the row, 4 makes the role user.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    fault = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("present"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def cut_pieces(turns: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """Conversations in order, cut to pieces; those known to lie whole in one piece are solved at once.

    Rows are sorted over all tasks by conversation and turn, so a long conversation runs through several of them. The first
    and the last conversation of a task may go on in its neighbours and come back as pieces (``whole`` false), as do
    conversations beyond the size of a piece.
    """
    schema = turns.select("conv_id").schema.add("part", "long").add("seq", "long").add("whole", "boolean")
    spark = turns.sparkSession
    for field in spark.createDataFrame([], f"{RAW}, {RESULT}").schema:
        schema = schema.add(field)
    target = to_arrow_schema(schema)
    raw_names, result_names = (tuple(c.split()[0] for c in text.split(", ")) for text in (RAW, RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = Rows(), {name: [] for name in target.names}
        part, seq, runs = None, 0, 0
        conv = held = None
        size = volume = 0

        def emit(whole: bool) -> None:
            nonlocal held, seq, size, volume
            raw, result = held, dict.fromkeys(result_names)
            if whole:
                kinds, blank, duplicate, truncated = judge(*held[1:])
                leave = rows.leave(kinds)
                letters = rows.solve(kinds, START, leave) + ENDING[leave][1]
                cost, n, text = replay(kinds, letters, START, held[1], held[2])
                values = (gaps_of(held[0]), blank, duplicate, truncated, illegal_of([r[:1] for r in held[1]]), cost, letters, n, text)
                raw, result = (None,) * 4, dict(zip(result_names, values, strict=True))
            for name, value in (("conv_id", conv), ("part", part), ("seq", seq), ("whole", whole), *zip(raw_names, raw, strict=True), *result.items()):
                out[name].append(value)
            held, seq, size, volume = ([], [], [], []), seq + 1, 0, volume + size

        cut = False
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "digest", "present", "part")]
            for name, turn, role, text, digest, present, part_of in zip(*columns, strict=True):
                if held is None or name != conv:
                    if held is not None:
                        emit(whole=runs > 1 and not cut)
                    conv, part, held, cut, size = name, part_of, ([], [], [], []), False, 0
                    runs += 1
                if not present:
                    continue
                if held[0] and (len(held[0]) >= piece_rows or size + len(text) > piece_bytes):
                    emit(whole=False)
                    cut = True
                for column, value in zip(held, (turn, role, text, digest), strict=True):
                    column.append(value)
                size += len(text)
                if len(out["seq"]) >= BATCH or volume > BATCH_BYTES:
                    yield to_batch(out, target)
                    out, volume = {name: [] for name in target.names}, 0
        if held is not None:
            emit(whole=False)
        if out["seq"]:
            yield to_batch(out, target)

    present = F.col("present") if "present" in turns.columns else F.lit(True)
    text = F.coalesce(F.col("text"), F.lit(" ")).cast("binary")
    role = F.coalesce(F.col("role"), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b" "), role.cast("binary"), text), 256))
    keyed = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"), present.alias("present"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ("conv_id", "turn", "role", "digest", "_row")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions(*order)
    return dealt.drop("_row").mapInArrow(run, schema)


def judge_pieces(pieces: DataFrame) -> DataFrame:
    """Per open piece its rows' classes, counts, ends and summary.

    A row that repeats one of an earlier piece is found by digest: each piece names a digest once, so a text that fills a
    third of a conversation is as many rows as there are pieces.
    """
    here = F.struct("part", "seq")
    named = pieces.select("conv", "part", "seq", F.explode(F.array_distinct("digests")).alias("digest"))
    first = F.min(here).over(Window.partitionBy("conv", "digest"))
    late = named.withColumn("first", first).where(F.col("first") < here)
    earlier = late.groupBy("part", "seq").agg(F.collect_list("digest").alias("earlier"))
    joined = pieces.select("conv", "part", "seq", "turns", "roles", "texts", "digests").join(earlier, ["part", "seq"], "left")
    names = tuple(c.split()[0] for c in FLAGS.split(", "))

    def step(batch: pa.RecordBatch) -> dict:
        rows, out = Rows(), {name: [] for name in names}
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            kinds, blank, duplicate, truncated = judge(r["roles"], r["texts"], r["digests"], set(r["earlier"] or ()))
            known = [t for t in r["turns"] if t is not None]
            initials = [x[:1] for x in (r["roles"][:1] + r["roles"][-1:])]
            values = (kinds, blank, duplicate, truncated, initials, known[:1] + known[-1:], *rows.summary(kinds))
            for name, value in zip(names, values, strict=True):
                out[name].append(value)
        return out | {name: batch.column(name) for name in ("conv", "part", "seq")}

    return map_arrow(joined, step, f"conv string, part long, seq long, {FLAGS}")


def meet(frame: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation: states before and after each, and what the rows before it end in."""
    frame = frame.sort_values(["part", "seq"], ignore_index=True)
    leaves = solve_pieces([(list(c), list(r)) for c, r in zip(frame["costs"], frame["ranks"], strict=True)])
    initial, turn, initials, turns = None, None, [], []
    for pair, ends in zip(frame["initials"], frame["ends"], strict=True):
        initials.append(initial)
        turns.append(turn)
        initial = pair[-1] if len(pair) else initial
        turn = int(ends[-1]) if len(ends) else turn
    last = [False] * (len(leaves) - 1) + [True]
    return pd.DataFrame(
        {
            "part": frame["part"], "seq": frame["seq"], "piece": range(len(leaves)), "enter": [START, *leaves[:-1]], "leave": leaves, "last": last,
            "initial": pd.Series(initials, dtype=object), "turn": pd.array(turns, dtype="Int64"),
        }
    )


def repair_conversations(turns: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Repaired conversations of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``, optional boolean ``present``).

    A row per conversation, or per piece of a long one: ``conv_id``, ``piece`` (from 0), ``whole``, the faults' counts
    (each row's first fault: blank, duplicate, truncated), ``gaps``, ``illegal`` and ``cost``, which add up over pieces,
    ``audit`` (the edits' letters), ``n_turns`` and ``repaired`` (``role:text`` joined by newlines, UTF-8), to be joined in
    order. Null roles and texts are one space. Rows follow ``turn``, nulls first; those of one turn follow role and then
    the SHA-256 of role and text, so the result does not depend on the order read. Rows without ``conv_id`` are one
    conversation. A conversation of which no row is ``present`` has zeros and an empty audit; no rows give no conversations.
    """
    spark = turns.sparkSession
    cut = stored(cut_pieces(turns, piece_rows, piece_bytes), "pieces")
    names = ["conv_id", "piece", "whole", *(c.split()[0] for c in RESULT.split(", "))]
    whole = cut.where("whole").select(*[F.lit(0).cast("long").alias(n) if n == "piece" else F.col(n) for n in names])

    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    pieces = cut.where("not whole").select("conv_id", key.alias("conv"), "part", "seq", *(c.split()[0] for c in RAW.split(", ")))
    flags = stored(judge_pieces(pieces), "flags")
    met = flags.select("conv", "part", "seq", "initials", "ends", "costs", "ranks").groupBy("conv").applyInPandas(
        meet, "part long, seq long, piece long, enter int, leave int, last boolean, initial string, turn long"
    )
    kept = flags.select("part", "seq", "classes", "blank", "duplicate", "truncated")
    ready = pieces.select("conv_id", "part", "seq", "turns", "roles", "texts").join(kept, ["part", "seq"]).join(met, ["part", "seq"])
    schema = whole.schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                letters = rows.solve(r["classes"], r["enter"], r["leave"])
                if r["last"]:
                    letters += ENDING[r["leave"]][1]
                cost, n, text = replay(r["classes"], letters, r["enter"], r["roles"], r["texts"])
                before = [r["initial"]] if r["initial"] is not None else []
                known = [t for t in r["turns"] if t is not None]
                gaps = gaps_of(known) + (max(0, known[0] - r["turn"] - 1) if known and r["turn"] is not None else 0)
                illegal = illegal_of(before + [x[:1] for x in r["roles"]])
                values = (r["conv_id"], r["piece"], False, gaps, r["blank"], r["duplicate"], r["truncated"], illegal, cost, letters, n, text)
                yield to_batch({name: [value] for name, value in zip(target.names, values, strict=True)}, target)

    return whole.unionByName(ready.mapInArrow(run, schema))


def fold_pieces(repaired: DataFrame) -> DataFrame:
    """A row per conversation: sums, the joined audit and the SHA-256 of the repaired text (lower-case hex).

    Conversations of one piece stay where they are. The pieces of others are read in order, one at a time; only the
    audit is held, a letter or so a row.
    """
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = repaired.where("whole").select("conv_id", *sums, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    schema = whole.schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, totals, audit, digest, n = None, None, [], None, 0

        def result() -> pa.RecordBatch:
            row = {"conv_id": conv} | totals | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            return to_batch({name: [value] for name, value in row.items()}, target)

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if totals is None or r["conv_id"] != conv:
                    if totals is not None:
                        yield result()
                    conv, totals, audit, digest, n = r["conv_id"], dict.fromkeys(sums, 0), [], hashlib.sha256(), 0
                for name in sums:
                    totals[name] += r[name]
                audit.append(r["audit"])
                if r["n_turns"]:
                    digest.update(b"\n" * (n > 0) + r["repaired"])
                    n += r["n_turns"]
        if totals is not None:
            yield result()

    cut = repaired.where("not whole")
    dealt = cut.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(dealt.mapInArrow(run, schema))
