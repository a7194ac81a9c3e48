"""Identity across releases: continuations, replacements by equal geometry, ambiguous overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.operators.release import state_digest
from geolith.operators.spatial_join import component_kinds, overlap_components, overlap_pairs
from geolith.tables import remove, save


def continuations(old: DataFrame, new: DataFrame, key: str = "source_feature_id") -> DataFrame:
    """key and action of the features in both: reappearance where the identity was inactive, else continuation.

    old may have identity_status; a retired identity is the action 'error'.
    """
    status = F.coalesce(F.col("identity_status"), F.lit("active")) if "identity_status" in old.columns else F.lit("active")
    action = F.when(F.col("s") == "retired", "error").when(F.col("s") == "inactive", "reappearance").otherwise("continuation")
    return old.select(key, status.alias("s")).hint("merge").join(new.select(key), key).select(key, action.alias("action"))


def replacements(old: DataFrame, new: DataFrame, key: str = "source_feature_id") -> DataFrame:
    """(old_id, new_id) of features without common key whose equal geometry is alone on both sides."""
    common_old = old.join(new.select(key).hint("merge"), key, "left_anti")
    common_new = new.join(old.select(key).hint("merge"), key, "left_anti")

    def alone(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("geometry_sha256").agg(F.count("*").alias("n"), F.min(key).alias(name)).where("n = 1").drop("n")

    return alone(common_old, "old_id").hint("merge").join(alone(common_new, "new_id"), "geometry_sha256").select("old_id", "new_id")


def plan(old: DataFrame, new: DataFrame, key: str = "source_feature_id") -> dict[str, DataFrame]:
    """The parts of a reconciliation: continuations, replacements, ambiguous components, additions, disappearances.

    Both sides have key, geometry_sha256 and bounds.  Overlapping features that are left after the first
    two steps are ambiguous; the plan is ready only if there are none.
    """
    kept = continuations(old, new, key)
    replaced = replacements(old, new, key)
    old_left = old.join(kept.select(key).hint("merge"), key, "left_anti").join(replaced.select(F.col("old_id").alias(key)).hint("merge"), key, "left_anti")
    new_left = new.join(kept.select(key).hint("merge"), key, "left_anti").join(replaced.select(F.col("new_id").alias(key)).hint("merge"), key, "left_anti")
    old_left, new_left = (save(x, "leftovers")[0] for x in (old_left, new_left))
    pairs = overlap_pairs(old_left, new_left, key, key)  # not saved: they may be many more than the features
    members, _ = save(overlap_components(old_left, new_left, key, key), "members")
    in_old = members.where("node LIKE 'a:%'").select(F.expr("substring(node, 3)").cast(old.schema[key].dataType).alias(key))
    in_new = members.where("node LIKE 'b:%'").select(F.expr("substring(node, 3)").cast(new.schema[key].dataType).alias(key))
    return {
        "continuations": kept, "replacements": replaced, "pairs": pairs, "components": members, "kinds": component_kinds(members),
        "additions": new_left.select(key).join(in_new.hint("merge"), key, "left_anti"), "disappearances": old_left.select(key).join(in_old.hint("merge"), key, "left_anti"),
    }


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """kind and n of every outcome of a plan."""
    out = parts["continuations"].groupBy(F.col("action").alias("kind")).agg(F.count("*").alias("n"))
    for kind, name in (("exact_geometry_replacement", "replacements"), ("addition", "additions"), ("disappearance", "disappearances")):
        out = out.unionByName(parts[name].agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n"))
    return out.unionByName(parts["kinds"].groupBy("kind").agg(F.count("*").alias("n")))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """kind and n of every outcome of a plan, and the digest of the whole report on each row."""
    rows, _ = save(summary(parts), "report")
    lines = F.array_join(F.sort_array(F.collect_list(F.concat("kind", F.lit("="), F.col("n").cast("string")))), ",")  # a line for each kind
    return rows.withColumn("report_sha256", rows.agg(F.sha2(lines, 256)).scalar())


def applied(mappings: DataFrame, parts: dict[str, DataFrame], release: str, key: str = "source_feature_id") -> DataFrame:
    """The mappings (project_key, source_feature_id, relationship, release) after a plan without ambiguity.

    Old mappings stay; continued and replaced features carry every project of the old one forward, and additions
    become projects of their own.
    """
    kept = parts["continuations"].where("action <> 'error'").select(F.col(key).alias("old_id"), F.col(key).alias("new_id"), F.lit("continuation").alias("relationship"))
    moved = kept.unionByName(parts["replacements"].select("old_id", "new_id", F.lit("exact_geometry_replacement").alias("relationship")))
    last = mappings.select("project_key", F.col(key).alias("old_id")).distinct()
    carried = last.join(moved, "old_id").select("project_key", F.col("new_id").alias(key), "relationship", F.lit(release).alias("release"))
    made = parts["additions"].select(F.concat(F.lit("kcb-"), F.sha2(F.concat(F.lit(release + "|"), F.col(key).cast("string")), 256)).alias("project_key"), key, F.lit("initial").alias("relationship"), F.lit(release).alias("release"))
    return mappings.select("project_key", key, "relationship", "release").unionByName(carried).unionByName(made)


def identity_changes(mappings: DataFrame, identities: DataFrame, parts: dict[str, DataFrame], key: str = "source_feature_id") -> DataFrame:
    """project_key, before and after of every identity that a plan touches.

    Projects of continued or replaced features become active again; those of features that disappeared, unless another
    of their features goes on, become inactive; retired ones stay retired.  mappings: project_key and key of the release
    before; identities: project_key, identity_status.
    """
    kept = parts["continuations"].where("action <> 'error'").select(key).unionByName(parts["replacements"].select(F.col("old_id").alias(key)))
    fate = kept.withColumn("goes_on", F.lit(True)).unionByName(parts["disappearances"].select(key).withColumn("goes_on", F.lit(False)))
    # A project may have several features, and several projects may share one.
    touched = mappings.select("project_key", key).distinct().join(fate, key).groupBy("project_key").agg(F.max("goes_on").alias("goes_on"))
    after = F.when(F.col("identity_status") == "retired", "retired").when(F.col("goes_on"), "active").otherwise("inactive")
    return touched.join(identities, "project_key").select("project_key", F.col("identity_status").alias("before"), after.alias("after"))


def classifications_preserved(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row: digests of the classifications before and after a plan was applied, and whether they are the same."""
    a = state_digest(before, columns).select(F.lit(1).alias("row"), F.col("n").alias("n_before"), F.col("sha256").alias("sha256_before"))
    b = state_digest(after, columns).select(F.lit(1).alias("row"), F.col("n").alias("n_after"), F.col("sha256").alias("sha256_after"))
    return a.join(b, "row").drop("row").withColumn("preserved", F.col("sha256_before") == F.col("sha256_after"))


def lineage(mappings: DataFrame, release: str = "release", previous: str = "previous_id", key: str = "source_feature_id") -> DataFrame:
    """The columns of mappings and origin_release, origin_id and steps: where each feature's identity began, and how many releases lie between.

    mappings: a row for each feature of a release (whole numbers) with the key that it had in the release before, null for a new one.
    Every feature points to the one before; in each round it points to where that one points, so that a chain of n
    releases takes log2(n) rounds, which are tables on disk.  A previous key without a row is where the identity begins.
    Rounds are merged: their files are so small, when compressed, that the planner would broadcast tables of a row for each feature.
    """
    node, before = F.struct(F.col(release).cast("long").alias("r"), F.col(key).alias("k")), F.struct((F.col(release) - 1).cast("long").alias("r"), F.col(previous).alias("k"))
    links = mappings.select(node.alias("node"), F.when(F.col(previous).isNotNull(), before).alias("before")).distinct()
    known = links.select(F.col("node").alias("before"), F.lit(True).alias("__known"))
    at = F.when(F.col("__known"), F.col("before")).otherwise(F.col("node"))
    jumps, path = save(links.hint("merge").join(known, "before", "left").select("node", at.alias("at"), F.col("__known").isNotNull().cast("long").alias("steps")), "jumps")
    while True:
        ahead = jumps.select(F.col("node").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"))
        further, later = save(jumps.hint("merge").join(ahead, "at").select("node", F.col("__at").alias("at"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("__steps") > 0).alias("__moved")), "jumps")
        done = further.where("__moved").isEmpty()
        remove(mappings.sparkSession, path)
        jumps, path = further.drop("__moved"), later
        if done:
            break
    ends = jumps.select(F.col("node.r").alias("__r"), F.col("node.k").alias("__k"), F.col("at.r").alias("origin_release"), F.col("at.k").alias("origin_id"), "steps")
    return mappings.hint("merge").join(ends, (F.col(release).cast("long") == F.col("__r")) & (F.col(key) == F.col("__k"))).drop("__r", "__k")
