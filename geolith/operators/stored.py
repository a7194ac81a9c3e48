"""Stored releases: which one is accepted, its validated features, pages of a source, integrity of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.functions import checks, geometry, strict

# The geometry types that each layer may hold.
LAYER_TYPES = {
    "roads": ("LineString", "MultiLineString"),
    "water": ("LineString", "MultiLineString", "Polygon", "MultiPolygon"),
    "buildings": ("Polygon", "MultiPolygon"),
    "boundary": ("Polygon", "MultiPolygon"),
}


def accepted_release(releases: DataFrame, dataset: str, key: str, lifecycle: str = "lifecycle") -> DataFrame:
    """dataset, release and fault: the accepted release of each dataset, or 'none' or 'several'."""
    accepted = F.col(lifecycle) == "accepted"
    found = releases.groupBy(dataset).agg(F.count(F.when(accepted, 1)).alias("n"), F.min(F.when(accepted, F.col(key))).alias("release"))
    fault = F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "several")
    return found.select(dataset, F.when(F.col("n") == 1, F.col("release")).alias("release"), fault.alias("fault"))


def candidate_release(asked: DataFrame, releases: DataFrame, key: str, lifecycle: str = "lifecycle") -> DataFrame:
    """key and fault of each asked release: it must be there and be a candidate."""
    j = asked.select(key).join(releases.select(key, F.col(lifecycle).alias("__lifecycle")), key, "left")
    return j.select(key, F.when(F.col("__lifecycle").isNull(), "missing").when(F.col("__lifecycle") != "candidate", "not_candidate").alias("fault"))


def accepted_features(features: DataFrame, releases: DataFrame, dataset: str, release: str, lifecycle: str = "lifecycle") -> DataFrame:
    """The features of the one accepted release of each dataset; datasets with none or several have no rows."""
    chosen = accepted_release(releases, dataset, release, lifecycle).where("fault IS NULL").select(dataset, F.col("release").alias(release))
    return features.join(chosen, release)


#: What stands behind a stored feature; each is true where it is broken.
LINEAGE_RULES = {
    "release": "NOT has_release", "data_kind": "has_release AND NOT (data_kind <=> wanted_kind)", "harvest": "has_release AND NOT (harvest_status <=> 'succeeded')",
    "file_harvest": "NOT (file_harvest <=> harvest_run)", "file_role": "NOT (file_role <=> 'source')",
}


def lineage_faults(features: DataFrame, releases: DataFrame, datasets: DataFrame, harvests: DataFrame, files: DataFrame, key: list[str], kind: str) -> DataFrame:
    """key and rule of every stored feature whose release, dataset, harvest or file is missing or not the one that it must be.

    features: key, release and file; releases: release, dataset and harvest_run; datasets: dataset and data_kind; harvests: harvest_run and harvest_status;
    files: file, file_harvest and file_role.  Dimensions are joined by equality, which the planner broadcasts where their sizes allow.
    """
    whole = releases.withColumn("has_release", F.lit(True)).join(datasets, "dataset", "left").join(harvests, "harvest_run", "left")
    j = features.select(*key, *[c for c in ("release", "file") if c not in key]).join(whole, "release", "left").join(files, "file", "left")
    return broken(j.withColumns({"has_release": F.coalesce("has_release", F.lit(False)), "wanted_kind": F.lit(kind)}), key, LINEAGE_RULES)


def mapped(features: DataFrame, mappings: DataFrame, identities: DataFrame, key: str, identity: str) -> DataFrame:
    """features with n_mappings, identity and identity_status from their confirmed mappings; one row for each feature.

    mappings: key, identity, mapping_status; identities: identity, identity_status.
    """
    known = mappings.where("mapping_status = 'confirmed'").select(key, identity).join(identities.select(identity, "identity_status"), identity, "left")
    one = known.groupBy(key).agg(F.count("*").alias("n_mappings"), F.min(identity).alias(identity), F.max("identity_status").alias("identity_status"))
    return features.join(one, key, "left").withColumn("n_mappings", F.coalesce("n_mappings", F.lit(0).cast("long")))


def broken(rows: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """key and rule of every rule (SQL, true where it is broken) that a row breaks."""
    names = F.filter(F.array(*[F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(names).alias("rule"))


def scan_faults(scanned: DataFrame, key: list[str], group: str, ordinal: str, rules: dict[str, str]) -> DataFrame:
    """key and rule of each row that breaks a rule, and a row for each group whose ordinals are not 1 to n, each once."""
    rows = broken(scanned, key, rules)
    stats = scanned.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(ordinal).alias("d"), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"))
    gaps = stats.where("n <> d OR first <> 1 OR last <> n").select(*[F.col(group).alias(c) if c == group else F.lit(None).cast(scanned.schema[c].dataType).alias(c) for c in key], F.lit("ordinals").alias("rule"))
    return rows.unionByName(gaps)


#: Reads of a stored feature that its own columns must bear out; each is true where it is broken.  ``g`` is what the blob holds.
INTEGRITY_RULES = {
    "geometry": "g.fault IS NOT NULL",
    "geometry_type": "g.fault IS NULL AND NOT (g.geometry_type <=> geometry_type)",
    "geometry_sha256": "g.fault IS NULL AND NOT (geometry_sha256 <=> sha2(substring(geometry, 41), 256))",
    "bounds": "g.fault IS NULL AND NOT (min_x <=> g.min_x AND min_y <=> g.min_y AND max_x <=> g.max_x AND max_y <=> g.max_y)",
    "attributes": "attributes_json IS NULL OR size(json_faults) > 0",
    "attributes_sha256": "NOT (attributes_sha256 <=> sha2(attributes_json, 256))",
    "identity": "NOT (identity_in_attributes <=> source_feature_id)",
    "content_sha256": "NOT (content_sha256 <=> sha2(concat('{\"attributes_sha256\":\"', attributes_sha256, '\",\"geometry_sha256\":\"', geometry_sha256, '\",\"source_feature_id\":\"', source_feature_id, '\"}'), 256))",
    "source_ordinal": "coalesce(source_ordinal < 1, true)",
}


def integrity(rows: DataFrame, layer: str, id_property: str, rules: dict[str, str] | None = None) -> DataFrame:
    """source_feature_id, source_ordinal and rule of everything in stored features that their own columns don't bear out, in one pass.

    rows have the columns of geojson.normalise (without fault).  A blob is decoded with its batch, its type and bounds are compared, the three digests computed
    again, and the attributes read strictly; 'layer_type' is a type that the layer may not hold, 'blank' an identity without text.  ``rules``: more of them (SQL),
    over other columns of the rows.
    """
    identity = checks.stripped(F.get_json_object("attributes_json", f"$['{id_property}']"))
    types = ", ".join(f"'{t}'" for t in LAYER_TYPES[layer])
    every = INTEGRITY_RULES | {"layer_type": f"g.fault IS NULL AND g.geometry_type NOT IN ({types})", "blank": "NOT sound_identity"} | (rules or {})
    read = rows.withColumns({"g": geometry.inspected("geometry"), "json_faults": strict.faults("attributes_json"), "identity_in_attributes": identity, "sound_identity": checks.is_identity("source_feature_id")})
    return broken(read, ["source_feature_id", "source_ordinal"], every)


def identity_faults(identities: DataFrame, mappings: DataFrame, algorithm: str) -> DataFrame:
    """project_key and rule: keys that are not derived from their origin, and origins without exactly one initial mapping.

    identities: project_key, release_key, source_feature_id; mappings: project_key, release_key, relationship.
    """
    derived = identities.where(F.col("project_key") != checks.project_key(algorithm, "release_key", "source_feature_id")).select("project_key", F.lit("not_derived").alias("rule"))
    initial = mappings.where("relationship = 'initial'").groupBy("project_key").agg(F.count("*").alias("n"), F.min("release_key").alias("first"), F.max("release_key").alias("last"))
    j = identities.select("project_key", "release_key").join(initial, "project_key", "left")
    wrong = F.when(F.col("n").isNull(), "no_initial").when(F.col("n") > 1, "several_initial").when((F.col("first") != F.col("release_key")) | (F.col("last") != F.col("release_key")), "other_origin")
    return derived.unionByName(j.select("project_key", wrong.alias("rule")).where("rule IS NOT NULL"))


def pages(rows: DataFrame, group: str, geometry: str, kind: str, layer: str, keep_null: str = "exclude") -> tuple[DataFrame, DataFrame]:
    """The rows of a source's pages that count, and those left out with the reason.

    Rows without geometry are excluded one by one (keep_null='exclude') or reject their whole group ('reject'); a type
    that the layer may not hold rejects its group.
    """
    reason = F.when(F.col(geometry).isNull(), "no_geometry").when(~F.coalesce(F.col(kind).isin(*LAYER_TYPES[layer]), F.lit(False)), "type")
    marked = rows.withColumn("reason", reason)
    rejects = F.col("reason").isNotNull() if keep_null == "reject" else F.col("reason") == "type"
    bad = marked.where(rejects).groupBy(group).agg(F.min("reason").alias("__group_reason"))
    marked = marked.join(bad, group, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__group_reason").isNotNull(), "group"))).drop("__group_reason")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def projected(rows: DataFrame, out_fields: list[str], identity: str) -> DataFrame:
    """Exactly the fields that a profile names; the identity as trimmed text."""
    return rows.select(*[F.trim(F.col(c).cast("string")).alias(c) if c == identity else F.col(c) for c in out_fields])


def recorded(existing: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key and outcome of each incoming row: 'insert', 'equal' to the row that is there, 'conflict' with it, or 'duplicate' in the input."""
    many = incoming.groupBy(*key).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in columns])
    there = existing.select(*key, F.struct(*columns).alias("__old"))
    j = many.hint("merge").join(there, key, "left")  # incoming rows may be many, and files of few bytes
    same = F.struct(*columns).eqNullSafe(F.col("__old"))
    return j.select(*key, F.when(F.col("n") > 1, "duplicate").when(F.col("__old").isNull(), "insert").when(same, "equal").otherwise("conflict").alias("outcome"))


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: n_missing (of right in left), n_extra, and whether the sets are equal, and left a subset of right."""
    sides = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    counts = sides.agg(F.count(F.when(F.col("l").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("r").isNull(), 1)).alias("n_extra"))
    return counts.withColumns({"equal": (F.col("n_missing") == 0) & (F.col("n_extra") == 0), "subset": F.col("n_extra") == 0})


# Rules on stored rows; each is true where it is broken.  Fixed values: the names of states.

HARVEST_RULES = {
    "status": "NOT coalesce(status IN ('planned', 'running', 'succeeded', 'failed'), false)",
    "unfinished_with_end": "status IN ('planned', 'running') AND (completed_at IS NOT NULL OR error_message IS NOT NULL)",
    "succeeded_without_end": "status = 'succeeded' AND (completed_at IS NULL OR error_message IS NOT NULL)",
    "failed_without_reason": "status = 'failed' AND (completed_at IS NULL OR coalesce(trim(error_message), '') = '')",
}
RELEASE_RULES = {
    "acceptance": "CASE WHEN lifecycle IN ('accepted', 'superseded') THEN accepted_at IS NULL WHEN lifecycle IN ('candidate', 'rejected') THEN accepted_at IS NOT NULL ELSE true END",
    "supersession": "(lifecycle = 'superseded') <> (superseded_by IS NOT NULL)",
}
MAPPING_RULES = {
    "review": "(decision_method = 'reviewed') <> (reviewed_at IS NOT NULL)",
    "decision_method": "NOT coalesce(decision_method IN ('deterministic-seed', 'automatic', 'reviewed'), false)",
    "mapping_status": "NOT coalesce(mapping_status IN ('proposed', 'confirmed', 'rejected'), false)",
}
RETIREMENT_RULES = {"retirement": "(identity_status = 'retired') <> (retired_at IS NOT NULL)"}
PROMOTION_RULES = {"relation": "NOT coalesce((event_kind = 'promotion' AND related_event IS NULL) OR (event_kind = 'rollback' AND related_event IS NOT NULL), false)"}
BOUNDS_RULES = {
    "longitude": "NOT coalesce(min_x BETWEEN -180 AND 180 AND max_x BETWEEN -180 AND 180, false)",
    "latitude": "NOT coalesce(min_y BETWEEN -90 AND 90 AND max_y BETWEEN -90 AND 90, false)",
    "order": "min_x > max_x OR min_y > max_y",
}


def initial_duplicates(mappings: DataFrame, key: str) -> DataFrame:
    """Keys with more than one confirmed initial mapping."""
    return mappings.where("relationship = 'initial' AND mapping_status = 'confirmed'").groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
