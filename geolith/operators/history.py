"""The classification log: folds, audits, replays and snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.tables import save

#: A building without a row in the current state has this class.
DEFAULT = "unclassified"


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    value = F.struct(*log.columns)
    return log.groupBy(key).agg(F.max_by(value, F.col(order)).alias("row")).select("row.*")


def accepted_actions(actions: DataFrame, identities: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The actions on active identities, and those that are refused, with the reason 'unknown', 'inactive' or 'retired'.

    identities: key and identity_status, a row each; actions without a key are on unknown ones.
    """
    j = actions.join(identities.select(key, F.col("identity_status").alias("__status")), key, "left")
    sound = F.coalesce(F.col("__status") == "active", F.lit(False))
    reason = F.coalesce("__status", F.lit("unknown")).alias("reason")
    return j.where(sound).drop("__status"), j.where(~sound).select(*actions.columns, reason)


# Folds.  A key's actions are cut into segments of bounded size; what a segment does to the state of a key is a transition,
# and the transitions of a key's segments, applied in order, give the state that each segment starts from.

#: Actions of a segment at most.
SEGMENT = 1024
#: Stands for a class that a segment doesn't name.
OTHER = "\0"
UNDO = "undo"
STATE = "previous string, current string, changes long, last long"


def segments(actions: DataFrame, key: str, order: str, size: int = SEGMENT) -> DataFrame:
    """key, part, block, rows (at, action in order) of each segment, and several: whether its key has more than one.

    Actions are dealt out by ranges of key and order, so that a long history spans several parts; no array holds
    more than ``size`` actions.  Rows whose action is null are no actions.
    """
    rows = actions.where("action IS NOT NULL").select(F.col(key), F.col(order).cast("long").alias("at"), "action").repartitionByRange(key, "at")
    ranged, _ = save(rows.withColumn("part", F.spark_partition_id()), "actions")
    own = F.row_number().over(Window.partitionBy(key, "part").orderBy("at", "action"))
    cut = ranged.withColumn("block", F.floor((own - 1) / size).cast("int"))
    made = cut.groupBy(key, "part", "block").agg(F.sort_array(F.collect_list(F.struct("at", "action"))).alias("rows"))
    saved, _ = save(made, "segments")
    many = saved.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__key"))
    return saved.join(many.withColumn("several", F.lit(True)), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("several", F.coalesce("several", F.lit(False)))


def transition(rows: list[tuple[int, str]]) -> dict:
    """What the actions (at, action) do to any state (previous, current), as a table.

    Undos that come first only swap the two, or do nothing where there is no previous class.  After that the first class x
    is set: a current class u that differs from x is then the previous one, and what u was before is forgotten; if u is x,
    only the previous class v is open.  So the rest is a table by u, and one by v for u = x, of the classes that the
    segment names, OTHER for all else, and null for v.  Entries that have come to one state go on together.
    """
    lead = next((i for i, (_, a) in enumerate(rows) if a != UNDO), len(rows))
    swaps = [at for at, _ in rows[:lead]]
    if lead == len(rows):
        return {"swaps": len(swaps), "swapped_at": swaps[-1], "first": None, "by_u": {}, "by_v": {}}
    at, first = rows[lead]
    named = sorted({a for _, a in rows if a not in (UNDO, first)}) + [OTHER]
    # A group has a state, its changes, the last of them, and entries: (table, class, changes of its own, at its joining, last before that).
    groups = [[u, first, 1, at, [("by_u", u, 0, 0, None)]] for u in named] + [[v, first, 0, None, [("by_v", v, 0, 0, None)]] for v in [*named, None]]
    for at, action in rows[lead + 1 :]:
        seen: dict[tuple, list] = {}
        for g in groups:
            undo = action == UNDO
            if not (g[0] is None if undo else action == g[1]):
                g[0], g[1], g[2], g[3] = g[1], g[0] if undo else action, g[2] + 1, at
            # OTHER of the two tables may be different classes, so that only states without it can be the same.
            state = (g[0], g[1]) if OTHER not in (g[0], g[1]) else (g[0], g[1], g[4][0][0])
            if (into := seen.get(state)) is None:
                seen[state] = g
                continue
            for table, given, more, joined, last in g[4]:
                total = g[2] + more
                into[4].append((table, given, total - into[2], into[2], g[3] if g[2] > joined else last))
        groups = list(seen.values())
    out: dict = {"swaps": len(swaps), "swapped_at": swaps[-1] if swaps else None, "first": first, "by_u": {}, "by_v": {}}
    for previous, current, changes, at, entries in groups:
        for table, given, more, joined, last in entries:
            out[table]["" if given is None else f"={given}"] = [previous, current, changes + more, at if changes > joined else last]
    return out


def applied(t: dict, previous: str | None, current: str, changes: int, last: int | None) -> tuple:
    """The state after a transition."""
    u, v = current, previous
    if v is not None and t["swaps"]:
        changes, last = changes + t["swaps"], t["swapped_at"]
        if t["swaps"] % 2:
            u, v = v, u
    if t["first"] is None:
        return v, u, changes, last
    table, given = (t["by_v"], v) if u == t["first"] else (t["by_u"], u)
    found = table[""] if given is None else table.get(f"={given}") or table[f"={OTHER}"]
    own = lambda c: given if c == OTHER else c
    return own(found[0]), own(found[1]), changes + found[2], last if found[3] is None else found[3]


def starts(cut: DataFrame, key: str) -> DataFrame:
    """key, part, block, and the states before (previous, current, changes, last) and after (end_...) of the segments of keys that have several.

    Each segment's transition is found by itself; a task then applies the transitions of one key in order, a row for each segment.
    """
    kind = cut.schema[key].dataType.simpleString()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(transition([(r["at"], r["action"]) for r in rows])) for rows in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], ["key", "part", "block", "transition"])

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("block", "ascending")])
        state: tuple = (None, DEFAULT, 0, None)
        before, after = [], []
        for text in rows.column("transition").to_pylist():
            before.append(state)
            state = applied(json.loads(text), *state)
            after.append(state)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([s[i] for s in side], k) for side in (before, after) for i, k in enumerate(kinds)]
        names = [n.split()[0] for n in STATE.split(", ")]
        return pa.table([*rows.select(["key", "part", "block"]).columns, *columns], ["key", "part", "block", *names, *[f"end_{n}" for n in names]])

    found = cut.where("several").select(F.col(key).alias("key"), "part", "block", "rows").mapInArrow(tables, f"key {kind}, part int, block int, transition string")
    ends = ", ".join(f"end_{x}" for x in STATE.split(", "))
    return found.groupBy("key").applyInArrow(compose, f"key {kind}, part int, block int, {STATE}, {ends}").withColumnRenamed("key", key)


def _step(state: Column, row: Column) -> tuple[Column, Column, Column]:
    """Whether an action changes nothing, whether it is an undo, and the class that it leads to."""
    undo = row["action"] == UNDO
    nothing = F.when(undo, state["previous"].isNull()).otherwise(row["action"] == state["current"])
    return nothing, undo, F.when(undo, state["previous"]).otherwise(row["action"])


def fold(actions: DataFrame, key: str, order: str, size: int = SEGMENT) -> DataFrame:
    """key, previous and current class, and how many actions changed something.

    actions: key, order (whole numbers) and action, which is a class or 'undo'.  An action that sets the class that holds,
    and an undo without history, change nothing.  An undo brings back the class before; an undo of an undo redoes.
    A key of one segment is folded as it is, one of several by the transitions of its segments.
    """
    start = F.struct(F.lit(None).cast("string").alias("previous"), F.lit(DEFAULT).alias("current"), F.lit(0).cast("long").alias("changes"))

    def step(state: Column, row: Column) -> Column:
        nothing, _, new = _step(state, row)
        return F.when(nothing, state).otherwise(F.struct(state["current"].alias("previous"), new.alias("current"), (state["changes"] + 1).alias("changes")))

    cut = segments(actions, key, order, size)
    short = cut.where("NOT several").select(key, F.aggregate("rows", start, step).alias("state")).select(key, "state.previous", "state.current", "state.changes")
    end = F.max_by(F.struct("end_previous", "end_current", "end_changes"), F.struct("part", "block")).alias("s")
    long = starts(cut, key).groupBy(key).agg(end).select(key, F.col("s.end_previous").alias("previous"), F.col("s.end_current").alias("current"), F.col("s.end_changes").alias("changes"))
    return short.unionByName(long)


def events_of(actions: DataFrame, key: str, order: str, size: int = SEGMENT) -> DataFrame:
    """The log that the actions leave: one event for each that changed something.

    Columns: key, order, previous_classification, new_classification, event_kind, predecessor and reverses (the
    order of the event before and of the event undone).  Each segment's events follow from the state that it starts from.
    """
    cut = segments(actions, key, order, size)
    known = starts(cut, key).select(F.col(key).alias("__key"), F.col("part").alias("__part"), F.col("block").alias("__block"), "previous", "current", "last")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part")) & (F.col("block") == F.col("__block"))
    begun = cut.join(known, same, "left")
    state = F.struct(
        F.col("previous"), F.coalesce("current", F.lit(DEFAULT)).alias("current"), F.col("last"), F.array().cast("array<struct<at:long,previous:string,current:string,kind:string,before:long>>").alias("out")
    )

    def step(s: Column, row: Column) -> Column:
        nothing, undo, new = _step(s, row)
        kind = F.when(undo, UNDO).when(s["last"].isNull(), "classification").otherwise("correction")
        event = F.struct(row["at"].alias("at"), s["current"].alias("previous"), new.alias("current"), kind.alias("kind"), s["last"].alias("before"))
        return F.when(nothing, s).otherwise(F.struct(s["current"].alias("previous"), new.alias("current"), row["at"].alias("last"), F.concat(s["out"], F.array(event)).alias("out")))

    out = begun.select(key, F.explode(F.aggregate("rows", state, step)["out"]).alias("e"))
    return out.select(
        key, F.col("e.at").alias(order), F.col("e.previous").alias("previous_classification"), F.col("e.current").alias("new_classification"), F.col("e.kind").alias("event_kind"),
        F.col("e.before").alias("predecessor"), F.when(F.col("e.kind") == UNDO, F.col("e.before")).alias("reverses"),
    )


def chain_audit(log: DataFrame, key: str, order: str) -> DataFrame:
    """key, order and the rule that each faulty event breaks."""
    w = Window.partitionBy(key).orderBy(order)
    before, was = F.lag(order).over(w), F.lag("new_classification").over(w)
    rows = log.withColumns({"__before": before, "__was": was})
    first = F.col("__before").isNull()
    rules = {
        "predecessor": ~F.col("predecessor").eqNullSafe(F.col("__before")),
        "previous_class": F.col("previous_classification") != F.coalesce("__was", F.lit(DEFAULT)),
        "first_kind": first & (F.col("event_kind") != "classification"),
        "reversal": (F.col("event_kind") == "undo") & ~F.col("reverses").eqNullSafe(F.col("__before")),
        "no_change": F.col("previous_classification") == F.col("new_classification"),
    }
    faults = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, order, F.explode(faults).alias("rule"))


def current_of(log: DataFrame, key: str, order: str) -> DataFrame:
    """key and classification: the sparse current state, without those that are back at the default."""
    last = log.groupBy(key).agg(F.max_by("new_classification", F.col(order)).alias("classification"))
    return last.where(F.col("classification") != DEFAULT)


def current_audit(log: DataFrame, current: DataFrame, key: str, order: str) -> DataFrame:
    """key, logged and stored class where the stored state differs from the log."""
    a = current_of(log, key, order).withColumnRenamed("classification", "logged")
    b = current.select(key, F.col("classification").alias("stored"))
    return a.join(b, key, "full_outer").where(~F.col("logged").eqNullSafe(F.col("stored")))


def replay(log: DataFrame, event_key: str, order: str, action: list[str]) -> DataFrame:
    """The first row of each event key, with the count of replays and whether any of them asked for something else."""
    asked = F.struct(*action)
    w = Window.partitionBy(event_key)
    rows = log.withColumns({"replays": (F.count("*").over(w) - 1).cast("long"), "turn": F.row_number().over(w.orderBy(order)), "first_action": F.first(asked).over(w.orderBy(order))})
    conflict = F.max(F.col("first_action") != asked).over(w)
    return rows.withColumn("conflict", conflict).where("turn = 1").drop("turn", "first_action")


def stale(log: DataFrame, key: str, order: str, expected: str) -> DataFrame:
    """Writes whose expected event is not the one before them."""
    before = F.lag(order).over(Window.partitionBy(key).orderBy(order))
    return log.withColumn("latest", before).where(~F.col(expected).eqNullSafe(F.col("latest")))


def with_class(features: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """features with their class, the default where there is none."""
    return features.join(current.select(key, "classification"), key, "left").withColumn("classification", F.coalesce("classification", F.lit(DEFAULT)))


def snapshot_counts(current: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """Counts by class of the current rows that are rendered, and of those that are not."""
    marked = current.join(rendered.select(key).distinct().withColumn("shown", F.lit(True)), key, "left")
    return marked.groupBy("classification").agg(F.count(F.when(F.col("shown"), True)).alias("rendered"), F.count(F.when(F.col("shown").isNull(), True)).alias("not_rendered"))


def class_distribution(features: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return with_class(features, current, key).groupBy("classification").agg(F.count("*").alias("n"))


def visible(features: DataFrame, current: DataFrame, key: str, hidden: list[str]) -> DataFrame:
    """Features whose class is not hidden; unknown classes count as the default."""
    return with_class(features, current, key).where(~F.col("classification").isin(hidden)) if hidden else with_class(features, current, key)


def append_only_faults(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the earlier log that the later one lacks or has changed."""
    return before.select(*columns).join(after.select(*columns), columns, "left_anti")
