"""Queries on contracts of sources and stored rows: inventories, layers, lineage, documents, reports, stored containers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import checks, geometry
from geolith.operators import diff, levels, reconcile, stored
from geolith.plans.frames import accepted, candidate, duck, features, table
from geolith.plans.maps import BOX, MORTON, RECONCILE, _morton
from geolith.plans.registry import query
from geolith.plans.shapes import N_VERTICES, shapes
from geolith.plans.stored import CLASSES, SHOWN, _snapshot, digest_sql
from geolith.sources import container, pointer, staging
from geolith.tables import shared_dir


def grouped_digest_sql(relation: str, columns: list[str], by: list[str]) -> str:
    """n and sha256 of each group, as release.state_digest computes them."""
    text = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    g = ", ".join(by)
    return f"""SELECT {g}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS sha256 FROM (
  SELECT {g}, substr(p, 1, 2) || ':' || sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM (
    SELECT {g}, substr(h, 1, 4) AS p, substr(h, 1, 4) || ':' || sha256(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS n FROM (
      SELECT {g}, sha256(concat_ws('|', {text})) AS h FROM {relation}) GROUP BY {g}, substr(h, 1, 4)) GROUP BY {g}, substr(p, 1, 2)) GROUP BY {g}"""


# Inventories of object ids.

PAGE_ROWS = "SELECT l_suppkey % 10 AS page, CASE WHEN l_partkey % 97 = 0 THEN '0' || l_partkey WHEN l_partkey % 89 = 0 THEN '-1' ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END AS value, CASE WHEN l_partkey % 83 = 0 THEN 'FID' ELSE 'OBJECTID' END AS field FROM lineitem"
PAGE_ROWS = f"SELECT * FROM ({PAGE_ROWS}) UNION ALL SELECT page, value, field FROM ({PAGE_ROWS}) WHERE value LIKE '%77'"


def _id_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(
        "l_suppkey % 10 AS page", "CASE WHEN l_partkey % 97 = 0 THEN concat('0', l_partkey) WHEN l_partkey % 89 = 0 THEN '-1' ELSE CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS value", "CASE WHEN l_partkey % 83 = 0 THEN 'FID' ELSE 'OBJECTID' END AS field"
    )
    return rows.unionByName(rows.where("value LIKE '%77'"))


READ_IDS = f"p AS ({PAGE_ROWS}), r AS (SELECT *, CASE WHEN regexp_full_match(value, '0|[1-9][0-9]*') THEN CAST(value AS BIGINT) END AS object_id FROM p)"


@query("object_inventory", f"WITH {READ_IDS}, i AS (SELECT DISTINCT page, object_id FROM r WHERE object_id IS NOT NULL) " + grouped_digest_sql("i", ["object_id"], ["page"]))
def object_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Count and digest of the ids of each page of a source."""
    return diff.state_digest(diff.object_ids(_id_pages(spark, d), "page", "value", "OBJECTID", "field")[0], ["object_id"], ["page"])


@query("object_inventory_faults", f"""WITH {READ_IDS} SELECT page, value, CASE WHEN field <> 'OBJECTID' THEN 'field' ELSE 'number' END AS rule FROM r WHERE field <> 'OBJECTID' OR object_id IS NULL
UNION ALL SELECT page, CAST(object_id AS VARCHAR), 'repeated' FROM r WHERE object_id IS NOT NULL GROUP BY page, object_id HAVING count(*) > 1""")  # fmt: skip
def object_inventory_faults(spark: SparkSession, d: str) -> DataFrame:
    return diff.object_ids(_id_pages(spark, d), "page", "value", "OBJECTID", "field")[1]


DATASET = "id % 9 AS dataset"
RECORDED = "recorded AS (SELECT dataset, CASE WHEN dataset = 4 THEN n + 1 ELSE n END AS object_count, CASE WHEN dataset = 7 THEN sha256('x') ELSE sha256 END AS inventory_sha256 FROM a)"


@query("inventory_report", duck("accepted candidate", f"""WITH x AS (SELECT id, {DATASET} FROM accepted), y AS (SELECT id, {DATASET} FROM candidate), a AS ({grouped_digest_sql("x", ["id"], ["dataset"])}), b AS ({grouped_digest_sql("y", ["id"], ["dataset"])}), {RECORDED},
p AS (SELECT dataset, count(*) AS n FROM y WHERE id NOT IN (SELECT id FROM x) GROUP BY 1), q AS (SELECT dataset, count(*) AS n FROM x WHERE id NOT IN (SELECT id FROM y) GROUP BY 1)
SELECT dataset, object_count AS accepted_count, inventory_sha256 AS accepted_sha256, coalesce(b.n, 0) AS live_count, b.sha256 AS live_sha256, dataset NOT IN (4, 7) AS lists_known,
  CASE WHEN dataset NOT IN (4, 7) THEN coalesce(p.n, 0) END AS n_added, CASE WHEN dataset NOT IN (4, 7) THEN coalesce(q.n, 0) END AS n_removed FROM recorded LEFT JOIN b USING (dataset) LEFT JOIN p USING (dataset) LEFT JOIN q USING (dataset)"""))  # fmt: skip
def inventory_report(spark: SparkSession, d: str) -> DataFrame:
    """Nine datasets, two of which were recorded otherwise than their accepted keys are."""
    dataset = F.expr(DATASET)
    a, b = accepted(spark, d).select("id", dataset), candidate(spark, d).select("id", dataset)
    noted = diff.state_digest(a, ["id"], ["dataset"])
    noted = noted.select("dataset", F.expr("CASE WHEN dataset = 4 THEN n + 1 ELSE n END AS object_count"), F.expr("CASE WHEN dataset = 7 THEN sha2('x', 256) ELSE sha256 END AS inventory_sha256"))
    return diff.inventory_report(a, b, noted, "dataset", "id")


LAYER_OF = "CASE id % 4 WHEN 0 THEN 'roads' WHEN 1 THEN 'water' WHEN 2 THEN 'water' ELSE 'buildings' END AS layer"
DATASET_OF = "CASE id % 4 WHEN 0 THEN 'roads' WHEN 1 THEN 'creeks' WHEN 2 THEN 'river' ELSE 'buildings' END AS dataset"
LAYERED = f"{LAYER_OF}, {DATASET_OF}"
EXCLUDED = "id % 4 = 0 AND (id % 13 = 0 OR id % 47 = 0)"


@query("layer_report", duck("accepted candidate", f"""WITH a AS (SELECT *, {LAYERED} FROM accepted), b AS (SELECT *, {LAYERED} FROM candidate), e AS (SELECT id, layer, dataset FROM a WHERE {EXCLUDED}),
j AS (SELECT coalesce(a.layer, b.layer) AS layer, coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN CASE WHEN a.id IN (SELECT id FROM e) THEN 'excluded' ELSE 'removed' END
  WHEN a.geometry_sha256 = b.geometry_sha256 AND a.attributes_sha256 = b.attributes_sha256 THEN 'unchanged' WHEN a.attributes_sha256 = b.attributes_sha256 THEN 'geometry_changed' WHEN a.geometry_sha256 = b.geometry_sha256 THEN 'attributes_changed' ELSE 'both_changed' END AS category FROM a FULL JOIN b USING (id))
{grouped_digest_sql("j", ["id"], ["layer", "dataset", "category"])}"""))  # fmt: skip
def layer_report(spark: SparkSession, d: str) -> DataFrame:
    """Water has two datasets; roads that the source excludes are not removed."""
    columns = [F.expr(LAYER_OF), F.expr(DATASET_OF)]
    a, b = accepted(spark, d).select("*", *columns), candidate(spark, d).select("*", *columns)
    return diff.layer_report(a, b, a.where(EXCLUDED), "layer", "dataset", "id")


# Descriptions of layers.

LAYER_DOC = """CASE s_suppkey % 6 WHEN 0 THEN '{"geometryType":"polygon","objectIdField":"OBJECTID","fields":[{"name":"OBJECTID"},{"name":"FPId"}],"maxRecordCount":1000}' WHEN 1 THEN '{"geometryType":"polyline","objectIdField":"OBJECTID","fields":[{"name":"OBJECTID"},{"name":"FPId"}],"maxRecordCount":1000}'
  WHEN 2 THEN '{"geometryType":"polygon","objectIdField":"FID","fields":[{"name":"FPId"}],"maxRecordCount":1000}' WHEN 3 THEN '{"geometryType":"polygon","objectIdField":"OBJECTID","fields":[{"name":"OBJECTID"},{"name":"FPId"}],"maxRecordCount":0}' WHEN 4 THEN '{"geometryType":"polygon","objectIdField":"OBJECTID","maxRecordCount":"many"}' END"""


@query("layer_contracts", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'geometry_type' WHEN 2 THEN 'object_id_field,fields OBJECTID' WHEN 3 THEN 'max_count' WHEN 4 THEN 'fields FPId OBJECTID,max_count' ELSE 'geometry_type,object_id_field,fields FPId OBJECTID,max_count' END AS faults FROM supplier""")
def layer_contracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(checks.layer_faults(F.expr(LAYER_DOC), "polygon", "OBJECTID", ["OBJECTID", "FPId"]), ",").alias("faults"))


# Lineage of stored features.

LINEAGE = {"data_kind": "CASE WHEN c_custkey % 50 = 1 THEN 'roads' ELSE 'buildings' END", "harvest_status": "CASE WHEN s_suppkey % 17 = 2 THEN 'failed' ELSE 'succeeded' END", "file_role": "CASE WHEN p_partkey % 61 = 3 THEN 'copy' ELSE 'source' END"}


@query("lineage_faults", f"""WITH r AS (SELECT o_orderkey AS release, o_custkey AS dataset, o_orderkey % (SELECT count(*) FROM supplier) + 1 AS harvest_run FROM orders WHERE o_orderkey % 40 <> 7), j AS (SELECT l_orderkey AS release, l_linenumber AS ordinal, r.release IS NOT NULL AS has_release, {LINEAGE["data_kind"]} AS data_kind, {LINEAGE["harvest_status"]} AS harvest_status,
  CASE WHEN p_partkey % 71 = 5 THEN -1 ELSE l_orderkey % (SELECT count(*) FROM supplier) + 1 END AS file_harvest, {LINEAGE["file_role"]} AS file_role, harvest_run, c_custkey IS NULL AS no_dataset, s_suppkey IS NULL AS no_harvest FROM (SELECT *, l_partkey AS p_partkey FROM lineitem) LEFT JOIN r ON r.release = l_orderkey LEFT JOIN customer ON c_custkey = dataset LEFT JOIN supplier ON s_suppkey = harvest_run)
SELECT release, ordinal, rule FROM (SELECT release, ordinal, unnest(list_filter([CASE WHEN NOT has_release THEN 'release' END, CASE WHEN has_release AND (no_dataset OR data_kind <> 'buildings') THEN 'data_kind' END, CASE WHEN has_release AND (no_harvest OR harvest_status <> 'succeeded') THEN 'harvest' END,
  CASE WHEN file_harvest IS DISTINCT FROM harvest_run THEN 'file_harvest' END, CASE WHEN file_role <> 'source' THEN 'file_role' END], lambda x: x IS NOT NULL)) AS rule FROM j)""")  # fmt: skip
def lineage_faults(spark: SparkSession, d: str) -> DataFrame:
    """Lines as features of orders: releases that are missing, of another kind, with a failed harvest or with other files."""
    n = table(spark, d, "supplier").agg(F.count("*")).scalar()
    run = lambda c: (F.col(c) % n + 1).cast("long")
    releases = table(spark, d, "orders").where("o_orderkey % 40 <> 7").select(F.col("o_orderkey").alias("release"), F.col("o_custkey").alias("dataset"), run("o_orderkey").alias("harvest_run"))
    datasets = table(spark, d, "customer").select(F.col("c_custkey").alias("dataset"), F.expr(LINEAGE["data_kind"]).alias("data_kind"))
    harvests = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("harvest_run"), F.expr(LINEAGE["harvest_status"]).alias("harvest_status"))
    # A file for each part of each release.
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release"), F.col("l_linenumber").alias("ordinal"), "l_partkey", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("file"))
    files = lines.select("file", "release", F.col("l_partkey").alias("p_partkey")).distinct().select("file", F.when(F.expr("p_partkey % 71 = 5"), F.lit(-1)).otherwise(run("release")).alias("file_harvest"), F.expr(LINEAGE["file_role"]).alias("file_role"))
    return stored.lineage_faults(lines, releases, datasets, harvests, files, ["release", "ordinal"], "buildings")


# Documents, paths, reports.


@query("canonical_documents", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN '{\"FPId\":\"' || s_suppkey || '\",\"a\":[1,2.5,null],\"z\":\"é\"}' END AS document FROM supplier")
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Keys in order, no spaces, no escapes, and the identity without white space; null for what is no object."""
    document = F.when(F.expr("s_suppkey % 5 = 0"), "[1]").otherwise(F.concat(F.lit('{"z": "\\u00e9", "a": [1, 2.50, null], "FPId": " '), F.col("s_suppkey").cast("string"), F.lit('\\t"}')))
    identity = checks.stripped(F.get_json_object(document, "$.FPId"))
    return table(spark, d, "supplier").select("s_suppkey", geometry.canonical(document, F.lit("FPId"), identity).alias("document"))


@query("svg_paths", duck("features", "SELECT id, 'M ' || CAST(size AS DOUBLE) || ' ' || CAST(-1.0e0 AS DOUBLE) || ' L ' || CAST(size + 2 AS DOUBLE) || ' ' || CAST(-1.0e0 AS DOUBLE) || ' L ' || CAST(size + 2 AS DOUBLE) || ' ' || CAST(-2.5e0 AS DOUBLE) || ' Z' AS path FROM features"))
def svg_paths(spark: SparkSession, d: str) -> DataFrame:
    point = lambda x, y: F.struct(F.expr(f"CAST({x} AS DOUBLE)").alias("x"), F.lit(y).alias("y"))
    return features(spark, d).select("id", geometry.svg_path(F.array(F.array(F.array(point("size", 1.0), point("size + 2", 1.0), point("size + 2", 2.5)))), closed=True).alias("path"))


@query("vertex_growth", duck("features", f"SELECT id, {N_VERTICES} + 3 AS n_coarse, {N_VERTICES} AS n_fine FROM features WHERE id % 21 = 4"))
def vertex_growth(spark: SparkSession, d: str) -> DataFrame:
    """Some features of the coarser level have three vertices more than they should."""
    fine = shapes(spark, d).select("id", geometry.n_vertices("parts").alias("n"))
    return levels.growth_faults(fine.withColumn("n", F.expr("CASE WHEN id % 21 = 4 THEN n + 3 ELSE n END")), fine, "id", "n")


@query("reconcile_report", duck("accepted candidate", f"SELECT kind, n, (SELECT sha256(string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n)) FROM ({RECONCILE})) AS report_sha256 FROM ({RECONCILE})"))
def reconcile_report(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.report(reconcile.plan(accepted(spark, d), candidate(spark, d), "id"))


# What is stored and read back.


@query("container_stored", duck("features", "SELECT id, size, morton FROM (" + MORTON + ") WHERE size >= 3"))
def container_stored(spark: SparkSession, d: str) -> DataFrame:
    """A container that took the place of another one, read back and verified."""
    path = f"{shared_dir(spark)}/geolith-container-{uuid.uuid4().hex}"
    rows = levels.chunks(_morton(spark, d), ["morton", "id"], 256).withColumn("level", F.lit(2)).select("level", "chunk", "id", "size", "morton", *BOX)
    for kept in (rows, rows.where("size >= 3")):
        staging.swap(container.encode(kept, "id"), path)
    return container.decode(container.read(spark, path), "id long, size int, morton long").select("id", "size", "morton")


@query("snapshot_stored", f"""SELECT r.n AS count, (SELECT count(*) FROM customer WHERE NOT ({SHOWN})) AS not_rendered, r.sha256 AS records_sha256, CAST(0 AS BIGINT) AS n_faults
FROM ({digest_sql(f"(SELECT * FROM customer WHERE {SHOWN})", ["c_custkey", "c_mktsegment"])}) r""")  # fmt: skip
def snapshot_stored(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot that was published as a whole, read back and checked."""
    path = f"{shared_dir(spark)}/geolith-snapshot-{uuid.uuid4().hex}"
    records, header = _snapshot(spark, d)
    staging.publish_all({"records": records, "header": header}, path)
    records, header = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/header")
    faults = staging.snapshot_faults(records, header, "c_custkey", CLASSES, table(spark, d, "customer").where(SHOWN))
    return header.select("count", "not_rendered", "records_sha256").withColumn("n_faults", faults.agg(F.count("*")).scalar())


#: Damage by the number of a chunk: another payload, count, bounds, or order; a chunk that is lost, one that comes again under another number.
@query("container_faults", duck("features", """WITH c AS (SELECT DISTINCT size % 2 AS level, id // 100 AS chunk FROM features) SELECT level, chunk, 'payload_sha256' AS rule FROM c WHERE chunk % 7 = 1 UNION ALL SELECT level, chunk, 'count' FROM c WHERE chunk % 7 = 2 UNION ALL SELECT level, chunk, 'bounds' FROM c WHERE chunk % 7 = 3
UNION ALL SELECT level, chunk, 'records_sha256' FROM c WHERE chunk % 7 = 4 UNION ALL SELECT level, NULL, 'chunks' FROM (SELECT DISTINCT level FROM c WHERE chunk % 7 = 5) UNION ALL SELECT level, chunk + 1000, 'repeated' FROM c WHERE chunk % 7 = 5"""))  # fmt: skip
def container_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).select((F.col("size") % 2).alias("level"), F.expr("id div 100").alias("chunk"), "id", *BOX)
    chunks = container.encode(rows, "id")
    n = F.col("chunk") % 7
    damaged = chunks.withColumns({
        "payload": F.when(n == 1, F.concat("payload", F.lit(b"x"))).otherwise(F.col("payload")), "n": F.when(n == 2, F.col("n") + 1).otherwise(F.col("n")), "max_x": F.when(n == 3, F.col("max_x") + 1).otherwise(F.col("max_x")),
        "records_sha256": F.when(n == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("records_sha256")),
    })
    return container.faults(damaged.unionByName(damaged.where(n == 5).withColumn("chunk", F.col("chunk") + 1000)), "id")


@query("recorded_tables", """SELECT 'releases' AS dataset, CAST(2 AS BIGINT) AS generation, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT 'harvests', 2, count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier UNION ALL SELECT 'buildings', 2, count(*), CAST(sum(p_partkey) AS BIGINT) FROM part""")
def recorded_tables(spark: SparkSession, d: str) -> DataFrame:
    """Harvests and releases that are recorded twice, the second time with more releases; a third time with another status, which is refused.  Buildings stay as they are."""
    root = f"{shared_dir(spark)}/geolith-recorded-{uuid.uuid4().hex}"
    releases = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    harvests, buildings = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_name"), table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name")
    pointer.record(root, {"releases": (releases.where("status = 'F'"), ["key"]), "harvests": (harvests, ["key"]), "buildings": (buildings, ["key"])})
    both = {"releases": (releases.where("status IN ('F', 'O')"), ["key"]), "harvests": (harvests, ["key"])}
    made = pointer.record(root, both)
    assert pointer.record(root, both) == made
    try:
        pointer.record(root, {"releases": (releases.withColumn("status", F.lit("P")), ["key"])})
    except pointer.Refused:
        pass
    else:
        raise AssertionError("a conflict was not seen")
    out = None
    for name, df in pointer.read(spark, root).items():
        row = df.agg(F.count("*").alias("n"), F.sum("key").cast("long").alias("keys")).select(F.lit(name).alias("dataset"), F.lit(made.number).cast("long").alias("generation"), "n", "keys")
        out = row if out is None else out.unionByName(row)
    return out
