"""Comparison of two releases by identity, inventories and their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.checks import object_id
from geolith.operators.release import state_digest


def feature_diff(accepted: DataFrame, candidate: DataFrame, key: str = "source_feature_id") -> DataFrame:
    """key and category of every feature of either release.

    Both have key, geometry_sha256 and attributes_sha256.  One shuffle of keys and digests by key: geometries are not moved.
    """
    a = accepted.select(key, F.col("geometry_sha256").alias("ga"), F.col("attributes_sha256").alias("aa"))
    b = candidate.select(key, F.col("geometry_sha256").alias("gb"), F.col("attributes_sha256").alias("ab"))
    same_g, same_a = F.col("ga") == F.col("gb"), F.col("aa") == F.col("ab")
    category = (
        F.when(F.col("ga").isNull(), "added").when(F.col("gb").isNull(), "removed").when(same_g & same_a, "unchanged")
        .when(same_a, "geometry_changed").when(same_g, "attributes_changed").otherwise("both_changed")
    )
    return a.join(b, key, "full_outer").select(key, category.alias("category"))


def bucketed_digest(df: DataFrame, group: list[str | Column], value: str, buckets: int = 1) -> DataFrame:
    """Count and sha256 of the comma-joined sorted values of each group.

    With buckets > 1 each group gets a digest for each bucket of values and then a digest over those, so
    that no task holds a whole large group; the digest then depends on the number of buckets.
    """
    names = [g if isinstance(g, str) else "group" for g in group]
    joined = F.sha2(F.array_join(F.sort_array(F.collect_list(F.col(value))), ","), 256)
    rows = df.select(*group, F.col(value).cast("string").alias(value) if buckets > 1 else F.col(value))
    if buckets == 1:
        return rows.groupBy(*names).agg(F.count("*").alias("n"), joined.alias("ids_sha256"))
    parts = rows.withColumn("bucket", F.pmod(F.xxhash64(value), F.lit(buckets))).groupBy(*names, "bucket").agg(F.count("*").alias("n"), joined.alias("sha"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "sha"))), lambda x: x["sha"]), ",")
    return parts.groupBy(*names).agg(F.sum("n").alias("n"), F.sha2(ordered, 256).alias("ids_sha256"))


def inventory_compare(accepted: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """key and side: added (live only) or removed (accepted only)."""
    a, b = accepted.select(key), live.select(key)
    added = b.join(a, key, "left_anti").withColumn("side", F.lit("added"))
    return added.unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("removed")))


def object_ids(pages: DataFrame, group: str, value: str, field: str, named: str) -> tuple[DataFrame, DataFrame]:
    """The inventory (group, object_id) of a source's pages of ids, each id once, and what is wrong (group, value, rule).

    ``named``: the column with the name of the field that a page's ids are of, which must be ``field`` ('field' else); 'number': not a whole number of at
    least 0 in canonical form; 'repeated': an id that comes more than once.
    """
    read = pages.select(group, F.col(value).cast("string").alias("value"), F.col(named).eqNullSafe(F.lit(field)).alias("__named"), object_id(F.col(value).cast("string")).alias("object_id"))
    counts = read.groupBy(group, "object_id").agg(F.count("*").alias("n")).where("object_id IS NOT NULL")
    rule = F.when(~F.col("__named"), "field").when(F.col("object_id").isNull(), "number")
    wrong = read.select(group, "value", rule.alias("rule")).where("rule IS NOT NULL")
    again = counts.where("n > 1").select(group, F.col("object_id").cast("string").alias("value"), F.lit("repeated").alias("rule"))
    return counts.select(group, "object_id"), wrong.unionByName(again)


def inventory_report(accepted: DataFrame, live: DataFrame, recorded: DataFrame, group: str, key: str) -> DataFrame:
    """group, count and digest of the accepted and of the live keys, lists_known, n_added and n_removed.

    recorded: group, object_count and inventory_sha256 of the accepted inventory as it was noted.  Where the accepted keys don't give
    that again, they can't be told one by one: lists_known is false, and n_added and n_removed are null.
    """
    a = state_digest(accepted, [key], [group]).toDF(group, "accepted_count", "accepted_sha256")
    b = state_digest(live, [key], [group]).toDF(group, "live_count", "live_sha256")
    added = live.select(group, key).join(accepted.select(group, key), [group, key], "left_anti").groupBy(group).agg(F.count("*").alias("n_added"))
    removed = accepted.select(group, key).join(live.select(group, key), [group, key], "left_anti").groupBy(group).agg(F.count("*").alias("n_removed"))
    j = recorded.join(a, group, "left").join(b, group, "left").join(added, group, "left").join(removed, group, "left")
    known = F.col("accepted_count").eqNullSafe(F.col("object_count")) & F.col("accepted_sha256").eqNullSafe(F.col("inventory_sha256"))
    n = lambda c: F.when(F.col("lists_known"), F.coalesce(F.col(c), F.lit(0))).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.withColumn("lists_known", known).select(group, F.col("object_count").alias("accepted_count"), F.col("inventory_sha256").alias("accepted_sha256"), zero("live_count"), "live_sha256", "lists_known", n("n_added"), n("n_removed"))


def layer_report(accepted: DataFrame, candidate: DataFrame, excluded: DataFrame, layer: str, dataset: str, key: str) -> DataFrame:
    """layer, dataset, category, n and digest of the keys in each category of a comparison, and of those that the candidate excludes ('excluded').

    accepted and candidate: layer, dataset, key and digests; a layer may have several datasets, which are compared each.
    excluded: layer, dataset and key of what the candidate's source leaves out, with a reason; an accepted feature that is excluded is not 'removed'.
    """
    keys = [layer, dataset, key]
    paired = lambda df: df.select(*keys, F.struct(*keys).alias("__key"), "geometry_sha256", "attributes_sha256")
    found = feature_diff(paired(accepted), paired(candidate), "__key").select(*[F.col(f"__key.{k}").alias(k) for k in keys], "category")
    left_out = excluded.select(*keys).distinct().withColumn("__excluded", F.lit(True))
    j = found.join(left_out, keys, "full_outer").withColumn("category", F.when(F.col("__excluded") & F.coalesce(F.col("category") == "removed", F.lit(True)), "excluded").otherwise(F.col("category")))
    return state_digest(j, [key], [layer, dataset, "category"])


def missing_and_extra(requested: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """keys and kind of the rows that one side lacks: missing were not returned, extra not requested."""
    a, b = requested.select(*keys).distinct(), returned.select(*keys).distinct()
    missing = a.join(b, keys, "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(b.join(a, keys, "left_anti").withColumn("kind", F.lit("extra")))


def source_change(accepted: DataFrame, live: DataFrame, key: str = "dataset_key") -> DataFrame:
    """Status of each dataset: object_count, inventory_sha256 and edited_at (epoch ms) on both sides."""
    j = accepted.alias("a").join(live.alias("l"), key, "left")
    status = (
        F.when(F.col("l.object_count").isNull(), "unavailable")
        .when(F.col("l.edited_at") < F.col("a.edited_at"), "unexpected")
        .when((F.col("l.object_count") != F.col("a.object_count")) | (F.col("l.inventory_sha256") != F.col("a.inventory_sha256")) | (F.col("l.edited_at") > F.col("a.edited_at")), "new")
        .otherwise("up_to_date")
    )
    return j.select(key, status.alias("status"))


#: Statuses, from the least to the most pressing.
PRECEDENCE = ("up_to_date", "new", "unavailable", "unexpected")


def status_rollup(statuses: DataFrame, group: list[str]) -> DataFrame:
    """The most pressing status of each group."""
    place = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("status"))
    return statuses.groupBy(*group).agg(F.max_by("status", place).alias("status"), F.count("*").alias("n"))
