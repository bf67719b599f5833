"""Status machines: allowed transitions as data, checked and applied."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.operators.keyed import number_rows, previous_value
from retailscope.session import cut_lineage

#: Changes of an entity worked out in one row, and blocks of them composed at a time.
BLOCK, FAN = 256, 256

# Statuses and where each may go.
RUN_TRANSITIONS = {
    "PENDING": ("RUNNING", "CANCELLED"),
    "RUNNING": ("COMPLETED", "FAILED", "CANCELLED"),
    "COMPLETED": (),
    "FAILED": (),
    "CANCELLED": (),
}
STORE_TRANSITIONS = {
    "NEW": ("AUDITED", "SKIPPED", "DUPLICATE", "FAILED"),
    "AUDITED": ("ANALYZED", "SKIPPED", "FAILED"),
    "ANALYZED": ("CONTACTED", "SKIPPED", "FAILED"),
    "CONTACTED": ("EMAIL_READY", "SKIPPED", "FAILED"),
    "EMAIL_READY": ("APPROVED", "SKIPPED", "FAILED"),
    "APPROVED": (),
    "SKIPPED": (),
    "DUPLICATE": (),
    "FAILED": ("NEW", "AUDITED", "ANALYZED", "CONTACTED", "EMAIL_READY", "SKIPPED"),
}
AUDIT_TRANSITIONS = {
    "PENDING": ("RUNNING", "FAILED"),
    "RUNNING": ("OK", "PARTIAL", "BLOCKED", "FAILED"),
    "OK": ("RUNNING",),
    "PARTIAL": ("RUNNING",),
    "BLOCKED": ("RUNNING",),
    "FAILED": ("RUNNING",),
}
LETTER_TRANSITIONS = {
    "DRAFT": ("READY", "QC_FAILED", "SKIPPED"),
    "QC_FAILED": ("DRAFT", "SKIPPED"),
    "READY": ("APPROVED", "SKIPPED", "DRAFT"),
    "APPROVED": (),
    "SKIPPED": ("DRAFT",),
}
# What a person may decide, by the status it is decided from.
DECISION_TRANSITIONS = {
    "DRAFT": ("SKIPPED",),
    "QC_FAILED": ("SKIPPED",),
    "READY": ("APPROVED", "SKIPPED"),
    "APPROVED": (),
    "SKIPPED": (),
}
TRANSITIONS = {
    "run": RUN_TRANSITIONS,
    "store": STORE_TRANSITIONS,
    "audit": AUDIT_TRANSITIONS,
    "letter": LETTER_TRANSITIONS,
    "decision": DECISION_TRANSITIONS,
}
FINISHED = ("COMPLETED", "FAILED", "CANCELLED", "OK", "PARTIAL", "BLOCKED")


def allowed(start: Column, end: Column, transitions: Mapping[str, Sequence[str]], stay: bool = True) -> Column:
    """Whether a status may follow another; staying put is no change."""
    none = F.array().cast("array<string>")
    table = F.create_map(
        *chain.from_iterable(
            (F.lit(k), F.array(*map(F.lit, v)) if v else none) for k, v in transitions.items()
        )
    )
    moves = F.coalesce(F.array_contains(F.try_element_at(table, start), end), F.lit(False))
    return (moves | (start == end)) if stay else moves


def check_transitions(history: DataFrame, kind: str, slice_by: Column) -> DataFrame:
    """Illegal steps of a recorded history (entity_id, seq, status).

    ``slice_by`` splits a long history along ``seq``.
    """
    stepped = previous_value(history, ["entity_id"], ["seq"], slice_by, "status", "from_status")
    legal = allowed(F.col("from_status"), F.col("status"), TRANSITIONS[kind], stay=kind != "decision")
    return stepped.filter(F.col("from_status").isNotNull() & ~legal).select(
        "entity_id", "seq", "from_status", F.col("status").alias("to_status")
    )


def _moved(status: Column, target: Column, transitions: Mapping[str, Sequence[str]]) -> Column:
    return F.when(allowed(status, target, transitions, stay=False), target).otherwise(status)


def _through(moves: Column, status: Column) -> Column:
    """Where a map of statuses leads; a status it does not name stays."""
    return F.coalesce(F.try_element_at(moves, status), status)


def start_statuses(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """The status before each block of an entity's changes: ``id``, ``block``, ``start``.

    ``blocks``: id, block (from 0) and ``moves``, the map of statuses that the block's changes come to; ``entities``: id,
    status. Maps compose in any grouping, so ``FAN`` blocks become one, level by level, until an entity has a single map;
    then statuses are handed down again. No row grows with an entity's history.
    """
    # maps have no order, so only the numbers are compared
    listed = F.array_sort(F.collect_list(F.struct("block", "moves")), lambda x, y: F.when(x["block"] < y["block"], -1).otherwise(1)).alias("_blocks")
    groups = blocks.groupBy("id", F.floor(F.col("block") / FAN).alias("_group")).agg(listed)
    if (blocks.agg(F.max("block")).head()[0] or 0) < FAN:
        known = groups.join(entities.select("id", F.col("status").alias("_start")), "id")
    else:
        first, rest = F.col("_blocks")[0]["moves"], F.expr("slice(_blocks, 2, size(_blocks))")
        whole = F.aggregate(rest, first, lambda acc, b: F.transform_values(acc, lambda _, s: _through(b["moves"], s)))
        parents = cut_lineage(groups.select("id", F.col("_group").alias("block"), whole.alias("moves")))
        above = start_statuses(parents, entities).select("id", F.col("block").alias("_group"), F.col("start").alias("_start"))
        known = groups.join(above, ["id", "_group"])
    none = F.array().cast("array<struct<block:bigint,start:string>>")
    steps = F.aggregate(
        "_blocks",
        F.struct(F.col("_start").alias("s"), none.alias("out")),
        lambda acc, b: F.struct(_through(b["moves"], acc["s"]).alias("s"), F.array_append(acc["out"], F.struct(b["block"].alias("block"), acc["s"].alias("start"))).alias("out")),
    )
    return known.select("id", F.explode(steps["out"]).alias("_o")).select("id", "_o.block", "_o.start")


def judge_status_changes(entities: DataFrame, changes: DataFrame, kind: str, slice_by: Column | None = None) -> DataFrame:
    """Every change with the status its entity has by then (``from_status``) and whether it is made (``legal``).

    An entity's changes are taken in the order of ``seq`` (of equal ones by target, then time); each starts where the last
    one that was made has led. A change of an entity that is not there has no ``from_status``. Histories are cut into
    blocks of ``BLOCK`` changes; a block is a map from status to status, so those of one entity are worked out in parallel.
    ``slice_by`` splits a long history along ``seq``, which is a number where it is left out.
    """
    transitions = TRANSITIONS[kind]
    names = F.array(*map(F.lit, transitions))
    note = F.col("note") if "note" in changes.columns else F.lit(None).cast("string")
    asked = changes.select("id", "to_status", "seq", "changed_at", note.alias("note"))
    order = [F.col("seq"), F.col("to_status"), F.col("changed_at"), F.col("note")]
    numbered = number_rows(asked, ["id"], order, F.floor(F.col("seq") / 65_536) if slice_by is None else slice_by, "_no")
    rows = F.array_sort(F.collect_list(F.struct(F.col("_no").alias("no"), "seq", "to_status", "changed_at", "note"))).alias("_rows")
    block = F.floor((F.col("_no") - 1) / BLOCK).alias("block")
    blocks = cut_lineage(numbered.groupBy("id", block).agg(rows).withColumn("_last", F.max("block").over(Window.partitionBy("id"))))
    moved = F.aggregate("_rows", names, lambda acc, r: F.transform(acc, lambda s: _moved(s, r["to_status"], transitions)))
    long = blocks.filter(F.col("_last") > 0).select("id", "block", F.map_from_arrays(names, moved).alias("moves"))
    starts = start_statuses(long, entities)
    begun = blocks.join(starts, ["id", "block"], "left").join(entities.select("id", F.col("status").alias("_now")), "id", "left")
    begun = begun.withColumn("_start", F.when(F.col("_last") > 0, F.col("start")).otherwise(F.col("_now")))
    judged = "struct<no:bigint,from_status:string,legal:boolean>"

    def step(acc: Column, r: Column) -> Column:
        legal = F.coalesce(allowed(acc["s"], r["to_status"], transitions, stay=kind != "decision"), F.lit(False))
        row = F.struct(r["no"].alias("no"), acc["s"].alias("from_status"), legal.alias("legal"))
        return F.struct(_moved(acc["s"], r["to_status"], transitions).alias("s"), F.array_append(acc["out"], row).alias("out"))

    replay = F.aggregate("_rows", F.struct(F.col("_start").alias("s"), F.array().cast(f"array<{judged}>").alias("out")), step)
    found = begun.select("id", F.explode(F.arrays_zip(F.col("_rows"), replay["out"].alias("_out"))).alias("_z"))
    return found.select("id", "_z._rows.no", "_z._rows.seq", "_z._rows.to_status", "_z._rows.changed_at", "_z._rows.note", "_z._out.from_status", "_z._out.legal")


def apply_status_changes(
    entities: DataFrame, changes: DataFrame, kind: str, reason: str | None = None, slice_by: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Entities after the allowed changes, and the changes that were not made.

    ``changes``: id, to_status, seq, changed_at and an optional note; an
    entity may have any number of them (``judge_status_changes``). ``reason``
    names the entity column that takes the note; without a note the old text
    stays. The finish time is that of the last change made to a finished status.
    """
    judged = cut_lineage(judge_status_changes(entities, changes, kind, slice_by))
    made, no = judged.filter("legal"), F.col("no")
    ended, noted = F.col("to_status").isin(*FINISHED), F.col("note").isNotNull()
    after = made.groupBy("id").agg(
        F.max_by("to_status", no).alias("_status"),
        F.max_by(F.struct("changed_at"), F.when(ended, no)).alias("_ended"),
        F.max_by("note", F.when(noted, no)).alias("_note"),
    )
    joined = entities.join(after, "id", "left")
    replaced = {"status": F.coalesce("_status", "status")}
    if "finished_at" in entities.columns:
        replaced["finished_at"] = F.when(F.col("_ended").isNotNull(), F.col("_ended.changed_at")).otherwise(F.col("finished_at"))
    if reason:
        replaced[reason] = F.coalesce("_note", reason)
    updated = joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in entities.columns])

    known = entities.select("id", F.lit(True).alias("_known"))
    refusal = F.when(F.col("_known").isNull(), F.lit("not found")).otherwise(F.lit("illegal"))
    refused = judged.filter(~F.col("legal")).join(known, "id", "left").select("id", "seq", "from_status", "to_status", refusal.alias("refusal"))
    return updated, refused


def mark_abandoned(runs: DataFrame, live_run_id: int | None, now: Column) -> DataFrame:
    """Running runs without a live owner, as failed."""
    lost = (F.col("status") == "RUNNING") & ~F.col("id").eqNullSafe(F.lit(live_run_id))
    changed = {
        "status": F.when(lost, F.lit("FAILED")).otherwise(F.col("status")),
        "finished_at": F.when(lost, now).otherwise(F.col("finished_at")),
        "error": F.when(lost, F.lit("abandoned: the process that started this run is gone")).otherwise(F.col("error")),
    }
    return runs.select(*[changed.get(c, F.col(c)).alias(c) for c in runs.columns])
