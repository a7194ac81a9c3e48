"""Releases: lineage, completeness, transitions, compatibility, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trace(releases: DataFrame, *dimensions: tuple[DataFrame, str | list[str]]) -> DataFrame:
    """releases with the columns of each dimension: inner joins, which the planner broadcasts where sizes allow."""
    out = releases
    for dimension, key in dimensions:
        out = out.join(dimension, key)
    return out


def left_confirmed(left: DataFrame, mappings: DataFrame, key: str, status: str = "mapping_status", confirmed: str = "confirmed") -> DataFrame:
    """All left rows, with their confirmed mappings only."""
    return left.join(mappings.where(F.col(status) == confirmed), key, "left")


def without(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of left with no row in right."""
    return left.join(right, key, "left_anti")


def matching(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of left with a row in right."""
    return left.join(right, key, "left_semi")


def log_links(log: DataFrame, key: str, predecessor: str, reverses: str, name: str) -> DataFrame:
    """log with the names of the event before and the event undone, '' where there is none."""
    before = log.select(F.col(key).alias(predecessor), F.col(name).alias("predecessor_name"))
    undone = log.select(F.col(key).alias(reverses), F.col(name).alias("reverses_name"))
    out = log.join(before, predecessor, "left").join(undone, reverses, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("predecessor_name", "reverses_name")})


def completeness(rows: DataFrame, group: list[str], ordinal: str, file: str) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_distinct(ordinal).alias("n_ordinals"), F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"), F.count_distinct(file).alias("n_files")
    )


def anomalies(rows: DataFrame, key: str, status: str, active: str) -> DataFrame:
    """Keys that don't have exactly one row, or whose greatest status is not the active one."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max(status).alias("status")).where((F.col("n") != 1) | (F.col("status") != active))


def transition(releases: DataFrame, group: str, version: str) -> DataFrame:
    """Plan of a promotion: in each group the accepted release is superseded by the newest candidate, which is accepted.

    releases: group, version, lifecycle.  Groups without a candidate keep what they have.
    """
    candidate = releases.where("lifecycle = 'candidate'").groupBy(group).agg(F.max(version).alias("promoted"))
    j = releases.join(candidate, group, "left")
    after = (
        F.when((F.col("lifecycle") == "accepted") & F.col("promoted").isNotNull(), "superseded")
        .when((F.col("lifecycle") == "candidate") & (F.col(version) == F.col("promoted")), "accepted")
        .otherwise(F.col("lifecycle"))
    )
    superseded_by = F.when((F.col("lifecycle") == "accepted") & F.col("promoted").isNotNull(), F.col("promoted"))
    return j.select(group, version, F.col("lifecycle").alias("before"), after.alias("after"), superseded_by.alias("superseded_by"))


def rolled_back(plan: DataFrame, group: str, version: str) -> DataFrame:
    """The lifecycles before a transition."""
    return plan.select(group, version, F.col("before").alias("lifecycle"))


def incompatible(components: DataFrame, accepted: DataFrame, columns: list[str]) -> DataFrame:
    """Component releases that are not the accepted ones in every column."""
    return components.select(*columns).join(accepted.select(*columns), columns, "left_anti")


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """key and rule of every violated rule; one pass over rows for all rules."""
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def schema_faults(df: DataFrame, expected) -> list[str]:
    """Columns that are missing, extra, in another place or of another type than in the expected schema."""
    have, want = df.schema.fields, expected.fields
    names = [f.name for f in have]
    out = [f"missing {f.name}" for f in want if f.name not in names] + [f"extra {f.name}" for f in have if f.name not in [w.name for w in want]]
    out += [f"{w.name} is {h.dataType.simpleString()}, not {w.dataType.simpleString()}" for w in want for h in have if h.name == w.name and h.dataType != w.dataType]
    return out if out or names == [w.name for w in want] else ["order of columns"]


def schema_rows(tables: dict[str, DataFrame], expected: dict) -> DataFrame:
    """table and fault of every departure of the tables' columns from the expected schemas; a table without an expected one, or the other way round, is a fault too."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, "unexpected table") for t in tables if t not in expected] + [(t, "missing table") for t in expected if t not in tables]
    rows += [(t, fault) for t, df in tables.items() if t in expected for fault in schema_faults(df, expected[t])]
    return spark.createDataFrame(rows, "table string, fault string")


def _digest_of_values(columns: list[str]) -> Column:
    """The sha256 of a row; a value goes in with its length, so that no other values have the same text."""
    values = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def state_digest(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Count and digest of all rows, whatever their order: one row, or with ``by`` one for each group.

    A value goes in with its length, so that rows of other values have other digests wherever their values are divided.
    The sorted digests of rows are digested by their first four hexadecimal digits, those by their first two, and
    those together: no task holds more than 1/65536 of a group's rows.
    """
    by = by or []
    level = rows.select(*by, _digest_of_values(columns).alias("h")).select(*by, "h", F.substring("h", 1, 4).alias("prefix"), F.lit(1).cast("long").alias("n"))
    for digits in (2, 0):
        level = level.groupBy(*by, "prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"), F.sum("n").alias("n"))
        level = level.select(*by, F.concat("prefix", F.lit(":"), "h").alias("h"), F.substring("prefix", 1, digits).alias("prefix"), "n")
    return level.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("sha256"))
