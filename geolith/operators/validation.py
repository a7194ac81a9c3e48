"""Validators that build on each other, over shared scans: the children of one that fails are skipped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.tables import save


@dataclass(frozen=True)
class Validator:
    """Rules (SQL, true where they are broken) over one table, which only count where all parents pass."""

    name: str
    table: str
    rules: dict[str, str]
    parents: tuple[str, ...] = field(default=())


def ancestors(validators: list[Validator]) -> dict[str, set[str]]:
    """All validators that each builds on; ValueError for unknown parents, repeated names and circles."""
    by_name = {v.name: v for v in validators}
    if len(by_name) < len(validators):
        raise ValueError("two validators have one name")
    out: dict[str, set[str]] = {}

    def above(name: str, below: tuple[str, ...]) -> set[str]:
        if name not in by_name:
            raise ValueError(f"{name} is no validator")
        if name in below:
            raise ValueError(f"{name} builds on itself")
        if name not in out:
            parents = by_name[name].parents
            out[name] = set(parents).union(*[above(p, (*below, name)) for p in parents]) if parents else set()
        return out[name]

    for v in validators:
        above(v.name, ())
    return out


def validate(tables: dict[str, tuple[DataFrame, str]], validators: list[Validator]) -> tuple[DataFrame, DataFrame]:
    """The status (validator, status, n, cause) of every validator, and the faults (validator, rule, key) of those that failed.

    tables: a table and its key (SQL, as text) by name.  Each table is read once, for the rules of all its validators together.  status is 'passed', 'failed'
    (n: its faults) or 'skipped' (cause: the first, by name, of the validators that it builds on and that failed while nothing below them did).
    """
    above = ancestors(validators)
    found = None
    for name, (df, key) in tables.items():
        own = [(v.name, rule, sql) for v in validators if v.table == name for rule, sql in v.rules.items()]
        if not own:
            continue
        broken = [F.when(F.coalesce(F.expr(sql), F.lit(False)), F.struct(F.lit(v).alias("validator"), F.lit(rule).alias("rule"))) for v, rule, sql in own]
        rows = df.select(F.expr(key).cast("string").alias("key"), F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("f")).select("f.validator", "f.rule", "key")
        found = rows if found is None else found.unionByName(rows)
    spark = next(iter(tables.values()))[0].sparkSession
    faults, _ = save(found if found is not None else spark.createDataFrame([], "validator string, rule string, key string"), "faults")
    counts = faults.groupBy("validator").agg(F.count("*").alias("n"))  # a row for each validator at most
    names = spark.createDataFrame([(v.name, sorted(above[v.name])) for v in validators], "validator string, above array<string>")
    broken = counts.select(F.col("validator").alias("cause"))
    # A cause has itself no cause, so that it is not skipped.
    causes = names.select("validator", F.explode("above").alias("cause")).join(broken, "cause")
    first = causes.join(causes.select(F.col("validator").alias("cause")).distinct(), "cause", "left_anti").groupBy("validator").agg(F.min("cause").alias("cause"))
    status = F.when(F.col("cause").isNotNull(), "skipped").when(F.col("n").isNotNull(), "failed").otherwise("passed")
    j = names.join(counts, "validator", "left").join(first, "validator", "left").withColumn("status", status)
    states = j.select("validator", "status", F.when(F.col("status") == "failed", F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"), "cause")
    failed = F.broadcast(states.where("status = 'failed'").select("validator"))  # a row for each validator at most; faults have few other keys
    return states, faults.join(failed, "validator", "left_semi")
