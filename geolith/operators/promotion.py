"""Promotion of candidates: plans with comparison hashes, the state after, the guard of a rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.operators import release


def with_comparisons(plan: DataFrame, comparisons: DataFrame, group: str) -> DataFrame:
    """A transition with the sha256 of the comparison of each pair; pairs without one have the fault 'no_comparison'."""
    j = plan.join(comparisons.select(group, "comparison_sha256"), group, "left")
    moved = ~F.col("before").eqNullSafe(F.col("after"))
    return j.withColumns({"comparison_sha256": F.when(moved, F.col("comparison_sha256")), "fault": F.when(moved & F.col("comparison_sha256").isNull(), "no_comparison")})


def state_faults(releases: DataFrame, plan: DataFrame, group: str, version: str) -> DataFrame:
    """group, version and rule where the stored releases are not what the plan leaves.

    releases: group, version, lifecycle, superseded_by; plan: of release.transition.  What supersedes a release is compared
    where the plan moves it; releases that were superseded before keep what they have.
    """
    moved = ~F.col("before").eqNullSafe(F.col("after"))
    want = plan.select(group, version, F.col("after").alias("__want"), F.col("superseded_by").alias("__by"), moved.alias("__moved"))
    j = releases.select(group, version, "lifecycle", "superseded_by", F.lit(True).alias("__stored")).join(want, [group, version], "full_outer")
    rules = {
        "missing": F.col("__stored").isNull(), "unplanned": F.col("__moved").isNull(),
        "lifecycle": ~F.col("lifecycle").eqNullSafe(F.col("__want")) & F.col("__stored") & F.col("__moved").isNotNull(),
        "superseded_by": F.col("__stored") & F.col("__moved") & ~F.col("superseded_by").eqNullSafe(F.col("__by")),
    }
    return release.violations(j, [group, version], rules)


def activated(releases: DataFrame, plan: DataFrame, group: str, version: str) -> DataFrame:
    """The releases after a plan: lifecycle and superseded_by of the rows that it moves are its own."""
    moved = plan.where("NOT (before <=> after)").select(group, version, F.col("after").alias("__after"), F.col("superseded_by").alias("__by"))
    j = releases.join(moved, [group, version], "left")
    by = F.when(F.col("__after").isNull(), F.col("superseded_by")).otherwise(F.col("__by"))
    return j.withColumns({"superseded_by": by, "lifecycle": F.coalesce("__after", "lifecycle")}).drop("__after", "__by")


def restored(releases: DataFrame, plan: DataFrame, group: str, version: str) -> DataFrame:
    """The stored releases after a rollback: rows that the plan moved go back, all others stay as they are stored."""
    moved = plan.where("NOT (before <=> after)").select(group, version, F.col("before").alias("__before"))
    j = releases.join(moved, [group, version], "left")
    return j.withColumns({"lifecycle": F.coalesce("__before", "lifecycle"), "superseded_by": F.when(F.col("__before").isNull(), F.col("superseded_by"))}).drop("__before")


def guard(at_promotion: dict[str, DataFrame], now: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """name, count and digest of each table at the promotion and now, and whether a rollback is refused.

    A rollback is refused where classifications or identities have changed since.
    """
    out = None
    for name, before in at_promotion.items():
        a = release.state_digest(before, columns[name]).toDF("n_before", "sha256_before")
        b = release.state_digest(now[name], columns[name]).toDF("n_now", "sha256_now")
        row = a.withColumn("name", F.lit(name)).join(b.withColumn("name", F.lit(name)), "name")  # a row each
        out = row if out is None else out.unionByName(row)
    return out.withColumn("refused", F.col("sha256_before") != F.col("sha256_now"))
