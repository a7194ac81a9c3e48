"""Feature frames derived from the synthetic tables, the same in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bounds of a part's box; doubles are computed in the same order in either engine.
MIN_X = "(-886e-1 + (p_partkey % 40) * 7e-3 + p_size * 1e-4)"
MIN_Y = "(4172e-2 + (p_partkey % 23) * 18e-3)"
BOX = f"""{MIN_X} AS min_x, {MIN_Y} AS min_y,
  {MIN_X} + (p_size + 1) * 25e-5 AS max_x, {MIN_Y} + (p_size + 1) * 18e-5 AS max_y"""

FEATURES = f"SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size AS size, {BOX} FROM part"
#: Digests from whole numbers only; parts of equal number modulo 900 share a geometry.
ACCEPTED = f"""SELECT p_partkey AS id, {{sha}}(concat('g', CAST(p_partkey % 900 AS VARCHAR))) AS geometry_sha256,
  {{sha}}(concat('a', CAST(p_size AS VARCHAR))) AS attributes_sha256, {BOX} FROM part WHERE p_partkey % 17 <> 0"""
CANDIDATE = f"""SELECT CASE WHEN p_partkey % 19 = 0 THEN p_partkey + 1000000000 ELSE p_partkey END AS id,
  {{sha}}(concat('g', CAST(CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 5000 ELSE p_partkey % 900 END AS VARCHAR))) AS geometry_sha256,
  {{sha}}(concat('a', CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 ELSE p_size END AS VARCHAR))) AS attributes_sha256,
  {BOX} FROM part WHERE p_partkey % 13 <> 0"""
#: Actions on users from the events: five kinds, one of which undoes.
ACTIONS = """SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'residential' WHEN 'view' THEN 'commercial'
  WHEN 'purchase' THEN 'undo' ELSE event_type END AS action FROM events"""

DUCK = {
    "features": FEATURES, "accepted": ACCEPTED.format(sha="sha256"), "candidate": CANDIDATE.format(sha="sha256"), "actions": ACTIONS,
}


def duck(names: str, body: str) -> str:
    """body with the named frames as common table expressions."""
    parts = [f"{n} AS ({DUCK[n]})" for n in names.split()]
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body.lstrip()[len("WITH RECURSIVE") :]
    if body.lstrip().upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + body.lstrip()[len("WITH") :]
    return "WITH " + ", ".join(parts) + " " + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    high = f"{MIN_X} + (p_size + 1) * 25e-5 AS max_x", f"{MIN_Y} + (p_size + 1) * 18e-5 AS max_y"
    return rows.selectExpr("p_partkey AS id", "p_brand AS brand", "p_type AS kind", "p_size AS size", f"{MIN_X} AS min_x", f"{MIN_Y} AS min_y", *high)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_partkey % 17 <> 0")
    return rows.select(
        F.col("p_partkey").alias("id"), F.sha2(F.concat(F.lit("g"), (F.col("p_partkey") % 900).cast("string")), 256).alias("geometry_sha256"),
        F.sha2(F.concat(F.lit("a"), F.col("p_size").cast("string")), 256).alias("attributes_sha256"), *boxes(),
    )


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0")
    return rows.select(
        F.expr("CASE WHEN p_partkey % 19 = 0 THEN p_partkey + 1000000000 ELSE p_partkey END").alias("id"),
        F.sha2(F.concat(F.lit("g"), F.expr("CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 5000 ELSE p_partkey % 900 END").cast("string")), 256).alias("geometry_sha256"),
        F.sha2(F.concat(F.lit("a"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 ELSE p_size END").cast("string")), 256).alias("attributes_sha256"), *boxes(),
    )


def boxes() -> list:
    return [F.expr(e).alias(n) for n, e in (("min_x", MIN_X), ("min_y", MIN_Y), ("max_x", f"{MIN_X} + (p_size + 1) * 25e-5"), ("max_y", f"{MIN_Y} + (p_size + 1) * 18e-5"))]


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "residential").when(F.col("event_type") == "view", "commercial").when(F.col("event_type") == "purchase", "undo").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("action"))
