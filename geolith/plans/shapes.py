"""Queries on shapes of every type: codecs, simplification, collections in files, integrity of stored rows.

A feature's shape follows from its box and number: a polygon with a hole, two boxes, a bent line, or two lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geometry, strict
from geolith.operators import stored
from geolith.plans.frames import duck, features
from geolith.plans.registry import query
from geolith.sources import candidate, geojson
from geolith.tables import save

KINDS = "CASE id % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' WHEN 2 THEN 'LineString' ELSE 'MultiLineString' END"
#: Corners of the box, and of a quarter of it from its lower left on; the second box of two lies to the right.
FAR = "max_x + 1e-2"


def _point(x: str, y: str) -> Column:
    return F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))


def _ring(x0: str, y0: str, x1: str, y1: str) -> Column:
    return F.array(*[_point(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """id, bounds, geometry_type and parts."""
    box, hole = _ring("min_x", "min_y", "max_x", "max_y"), _ring("min_x", "min_y", "(min_x + max_x) / 2D", "(min_y + max_y) / 2D")
    bent = F.array(_point("min_x", "min_y"), _point("max_x", "min_y"), _point("max_x", "max_y"))
    straight = F.array(_point("min_x", "max_y"), _point("max_x", "max_y"))
    parts = (
        F.when(F.expr("id % 4 = 0"), F.array(F.array(box, hole))).when(F.expr("id % 4 = 1"), F.array(F.array(box), F.array(_ring("max_x", "min_y", FAR, "max_y"))))
        .when(F.expr("id % 4 = 2"), F.array(F.array(bent))).otherwise(F.array(F.array(bent), F.array(straight)))
    )
    return features(spark, d).select("id", "size", "min_x", "min_y", F.expr(f"CASE WHEN id % 4 = 1 THEN {FAR} ELSE max_x END").alias("max_x"), "max_y", F.expr(KINDS).alias("geometry_type"), parts.alias("parts"))


N_VERTICES = "CAST(CASE id % 4 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 3 ELSE 5 END AS BIGINT)"
N_BYTES = "CAST(40 + CASE id % 4 WHEN 0 THEN 9 + 2 * 84 WHEN 1 THEN 9 + 2 * 93 WHEN 2 THEN 9 + 48 ELSE 9 + 57 + 41 END AS BIGINT)"


@query("shape_roundtrip", duck("features", f"SELECT id, {KINDS} AS kind, {N_VERTICES} AS n_vertices, CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS holes, min_x, min_y, CASE WHEN id % 4 = 1 THEN {FAR} ELSE max_x END AS max_x, max_y, {N_BYTES} AS n_bytes FROM features"))
def shape_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """What the blobs of all types decode to, and their lengths."""
    rows = shapes(spark, d).select("id", geometry.gpkg("geometry_type", "parts").alias("blob"))
    rows = rows.select("id", F.octet_length("blob").cast("long").alias("n_bytes"), geometry.decoded("blob").alias("g"))
    box = geometry.bounds("g.parts")
    holes = F.when(F.col("g.geometry_type").endswith("Polygon"), geometry.n_holes("g.parts")).otherwise(F.lit(0))
    return rows.select("id", F.col("g.geometry_type").alias("kind"), geometry.n_vertices("g.parts").alias("n_vertices"), holes.cast("long").alias("holes"), *[box[c].alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], "n_bytes")


@query("shape_simplified", duck("features", f"SELECT id, {N_VERTICES} + CASE id % 4 WHEN 0 THEN CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END WHEN 1 THEN CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END WHEN 2 THEN CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END END AS n_vertices FROM features"))
def shape_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Every ring and line with a point more, half way along its first segment, which goes unless (every third) it lies off it."""

    def more(ring: Column) -> Column:
        a, b = ring[0], ring[1]
        y = (a["y"] + b["y"]) / 2 - F.when(F.expr("id % 3 = 0"), 1e-4).otherwise(0.0)
        return F.concat(F.slice(ring, 1, 1), F.array(F.struct(((a["x"] + b["x"]) / 2).alias("x"), y.alias("y"))), F.slice(ring, F.lit(2), F.size(ring)))

    rows = shapes(spark, d).withColumn("parts", F.transform("parts", lambda rings: F.transform(rings, more)))
    return rows.select("id", geometry.n_vertices(geometry.simplify(1e-9)("geometry_type", "parts")).alias("n_vertices"))


# Collections in files.  Faults are planted by number: positions of one and of three ordinates, blank and repeated identities.

IDENTITY = "CASE WHEN id % 31 = 0 THEN chr(9) WHEN id % 37 = 0 THEN 'twin' ELSE concat(' ', CAST(id AS VARCHAR(20)), chr(10)) END"
FAULT = "CASE WHEN id % 31 = 0 THEN 'identity' WHEN id % 37 = 0 AND twins > 1 THEN 'duplicate' WHEN (id % 41 = 0) <> (id % 43 = 0) THEN 'geometry' END"


def _collected(spark: SparkSession, d: str) -> DataFrame:
    """The features that were written as collections and are read back; positions of those that both faults of ordinates would fall on stay as they are."""
    short, long = F.expr("id % 41 = 0 AND id % 43 <> 0"), F.expr("id % 43 = 0 AND id % 41 <> 0")
    point = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.when(short, "").otherwise(F.concat(F.lit(","), p["y"].cast("string"))), F.when(long, ",0").otherwise(""), F.lit("]"))
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    ring = lambda r: listed(F.transform(r, point))
    part = lambda rings: listed(F.transform(rings, ring))
    first = F.col("parts")[0]
    kind = F.col("geometry_type")
    coordinates = F.when(kind == "LineString", ring(first[0])).when(kind == "Polygon", part(first)).when(kind == "MultiLineString", listed(F.transform("parts", lambda rings: ring(rings[0])))).otherwise(listed(F.transform("parts", part)))
    properties = F.to_json(F.struct(F.expr("id").alias("number"), F.expr(IDENTITY.replace("VARCHAR(20)", "STRING")).alias("FPId"), F.lit('a "}{" \\ b').alias("note")))
    rows = shapes(spark, d).select("geometry_type", coordinates.alias("coordinates"), properties.alias("properties"))
    path = save(rows.limit(0), "geojson")[1] + ".collections"
    geojson.write(rows, path)
    return geojson.read(spark, path)


@query("collection_features", duck("features", f"SELECT id, {KINDS} AS geometry_type, CASE WHEN id % 31 <> 0 THEN trim(translate({IDENTITY}, chr(9) || chr(10), '')) END AS source_feature_id, {FAULT} AS fault FROM (SELECT *, count(*) FILTER (id % 31 <> 0 AND id % 37 = 0) OVER () AS twins FROM features)"))
def collection_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of collections in files, as they would be stored."""
    rows = geojson.normalise(_collected(spark, d), "FPId")
    return rows.select(F.get_json_object("attributes_json", "$.number").cast("long").alias("id"), "geometry_type", "source_feature_id", "fault")


# Candidates.

CANDIDATE_FAULTS = {
    "feature": "SELECT count(*) FROM f WHERE fault IS NOT NULL", "not_normalised": "SELECT count(*) FROM f WHERE (id % 50 = 9 AND id % 31 <> 0 AND id % 37 <> 0) OR id % 60 = 12",
    "inventory_missing": "SELECT count(*) FROM f WHERE id % 60 = 12", "inventory_extra": "SELECT count(*) FROM f WHERE id % 60 = 11", "inventory_repeated": "SELECT count(*) FROM f WHERE id % 70 = 13 AND id % 60 <> 11",
    "manifest page_count": "SELECT 1", "manifest content_sha256": "SELECT 1", "manifest release_key": "SELECT 1", "manifest object_count": "SELECT 1", "manifest object_ids_sha256": "SELECT 1", "manifest identity_map_sha256": "SELECT 1", "times": "SELECT 1",
}


@query("candidate_faults", duck("features", f"WITH f AS (SELECT *, {FAULT} AS fault FROM (SELECT *, count(*) FILTER (id % 31 <> 0 AND id % 37 = 0) OVER () AS twins FROM features)) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{rule}' AS rule, ({sql}) AS n" for rule, sql in CANDIDATE_FAULTS.items()) + ") WHERE n > 0"))
def candidate_faults(spark: SparkSession, d: str) -> DataFrame:
    """A candidate of collections in files, whose features, inventory and manifest were altered after it was staged."""
    collection, _ = save(_collected(spark, d), "collection")
    found, _ = save(candidate.normalised(collection, "FPId", "number"), "candidate")
    ids = found.select("object_id").where("object_id IS NOT NULL")
    harvest = {"page_size": F.lit(1000).cast("long"), "started_at": F.lit("2024-03-01T10:00:00.000Z"), "completed_at": F.lit("2024-03-01T11:00:00.000Z"), "published_day": F.lit("2024-02-29")}
    manifest, _ = save(candidate.manifest(found, ids, harvest, "buildings"), "manifest")
    changed = F.expr("object_id % 50 = 9 AND source_feature_id IS NOT NULL AND source_feature_id <> 'twin'")
    features_ = found.withColumn("attributes_sha256", F.when(changed, F.sha2(F.lit("x"), 256)).otherwise(F.col("attributes_sha256")))
    features_ = features_.where("NOT object_id % 60 = 12").unionByName(features_.where("object_id % 60 = 12").withColumn("object_id", F.lit(None).cast("long")))
    inventory = ids.where("object_id % 60 <> 11").unionByName(ids.where("object_id % 70 = 13 AND object_id % 60 <> 11"))
    wrong = manifest.withColumns({"page_count": F.col("page_count") + 1, "completed_at": F.lit("2024-03-01T09:00:00.000Z")})
    return candidate.faults({"features": features_, "inventory": inventory, "manifest": wrong}, collection, "buildings", "FPId", "number")


# Integrity of stored rows: each kind of damage has a number.

def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored features with planted damage."""
    rows = shapes(spark, d).withColumns({"geometry": geometry.gpkg("geometry_type", "parts"), "source_feature_id": F.concat(F.lit("f"), F.col("id").cast("string")), "source_ordinal": F.col("id").cast("long") + 1})
    rows = rows.withColumn("attributes_json", F.expr("concat('{\"FPId\":\"', source_feature_id, '\",\"size\":', size, '}')"))
    rows = rows.withColumns({"geometry_sha256": F.expr("sha2(substring(geometry, 41), 256)"), "attributes_sha256": F.sha2("attributes_json", 256)})
    body = "concat('{\"attributes_sha256\":\"', attributes_sha256, '\",\"geometry_sha256\":\"', geometry_sha256, '\",\"source_feature_id\":\"', source_feature_id, '\"}')"
    rows = rows.withColumn("content_sha256", F.expr(f"sha2({body}, 256)")).withColumn("file_role", F.lit("source"))
    damaged = {
        "geometry": "CASE WHEN id % 17 = 0 THEN substring(geometry, 1, length(geometry) - 1 - CAST(id % 5 AS INT)) ELSE geometry END",
        "geometry_type": "CASE WHEN id % 19 = 0 THEN 'Point' ELSE geometry_type END", "geometry_sha256": "CASE WHEN id % 23 = 0 THEN sha2('x', 256) ELSE geometry_sha256 END",
        "max_x": "CASE WHEN id % 29 = 0 THEN max_x + 1e-9 ELSE max_x END", "attributes_json": "CASE WHEN id % 31 = 0 THEN replace(attributes_json, '}', ',\"size\":0}') ELSE attributes_json END",
        "attributes_sha256": "CASE WHEN id % 37 = 0 THEN sha2('x', 256) WHEN id % 31 = 0 THEN sha2(replace(attributes_json, '}', ',\"size\":0}'), 256) ELSE attributes_sha256 END",
        "source_feature_id": "CASE WHEN id % 41 = 0 THEN concat('g', id) ELSE source_feature_id END", "content_sha256": "CASE WHEN id % 43 = 0 THEN sha2('x', 256) ELSE content_sha256 END",
        "source_ordinal": "CASE WHEN id % 47 = 0 THEN 0 ELSE source_ordinal END", "file_role": "CASE WHEN id % 53 = 0 THEN 'copy' ELSE file_role END",
    }
    return rows.withColumns({c: F.expr(e) for c, e in damaged.items()})


READ = "id % 17 <> 0 AND "
RULE_SQL = {
    "geometry": "id % 17 = 0", "geometry_type": READ + "id % 19 = 0", "geometry_sha256": READ + "id % 23 = 0", "bounds": READ + "id % 29 = 0", "attributes": "id % 31 = 0", "attributes_sha256": "id % 37 = 0",
    "identity": "id % 41 = 0", "content_sha256": "id % 23 = 0 OR id % 31 = 0 OR id % 37 = 0 OR id % 41 = 0 OR id % 43 = 0", "source_ordinal": "id % 47 = 0", "layer_type": READ + "id % 4 >= 2", "lineage": "id % 53 = 0",
}


@query("stored_integrity", duck("features", "SELECT source_feature_id, source_ordinal, rule FROM (SELECT CASE WHEN id % 41 = 0 THEN 'g' ELSE 'f' END || id AS source_feature_id, CAST(CASE WHEN id % 47 = 0 THEN 0 ELSE id + 1 END AS BIGINT) AS source_ordinal, unnest(list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULE_SQL.items()) + "], lambda x: x IS NOT NULL)) AS rule FROM features)"))
def stored_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Damage of every kind to stored features, found by decoding them."""
    return stored.integrity(_stored(spark, d), "buildings", "FPId", {"lineage": "NOT (file_role <=> 'source')"})


# Strict reading.

WRITTEN = """CASE id % 9 WHEN 0 THEN '{"a":1,"b":[true,null]}' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN '{"a":1,"a":2}' WHEN 3 THEN '{"b":1,"a":2}' WHEN 4 THEN '{"a":NaN}'
  WHEN 5 THEN '{"a":1.50}' WHEN 6 THEN chr(65279) || '{"a":1}' WHEN 7 THEN '{"a":[1,2}' ELSE '{"a":"' || chr(92) || 'u0041"}' END"""


@query("strict_documents", duck("features", "SELECT id, CASE id % 9 WHEN 0 THEN '' WHEN 1 THEN 'space' WHEN 2 THEN 'repeated_key' WHEN 3 THEN 'order_of_keys' WHEN 4 THEN 'number' WHEN 5 THEN 'number' WHEN 6 THEN 'mark' WHEN 7 THEN 'unclosed' ELSE 'escape' END AS faults FROM features"))
def strict_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a lenient reader takes, with what departs from the canonical form."""
    text = F.expr(WRITTEN.replace("chr(65279)", "decode(unhex('EFBBBF'), 'UTF-8')"))
    return features(spark, d).select("id", F.array_join(strict.faults(text), ",").alias("faults"))
