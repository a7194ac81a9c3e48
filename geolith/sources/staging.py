"""Published tables: staged, read again, compared and moved to their place; snapshots and package manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators.release import state_digest
from geolith.tables import move, remove


def publish(df: DataFrame, path: str, columns: list[str] | None = None, partition_by: list[str] | None = None) -> str:
    """Writes df to path, where nothing or the same rows may be; returns 'written' or 'reused'.

    The table is staged beside its place, read back, compared with df by count and digest of the columns (all, if not
    given), and moved.  ValueError if it reads back otherwise, or if other rows are at path already.
    """
    spark, columns = df.sparkSession, columns or df.columns
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    want = state_digest(df, columns).first()
    back = state_digest(spark.read.schema(df.schema).parquet(staged), columns).first()
    if want != back:
        remove(spark, staged)
        raise ValueError(f"staged table has {back['n']} rows, not the {want['n']} that were written")
    if move(spark, staged, path):
        return "written"
    there = state_digest(spark.read.schema(df.schema).parquet(path), columns).first()
    remove(spark, staged)
    if there != want:
        raise ValueError(f"other rows are at {path}")
    return "reused"


def publish_all(tables: dict[str, DataFrame], path: str) -> str:
    """Publishes several tables together, or none: they are staged in one folder, which is moved to path."""
    spark = next(iter(tables.values())).sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            publish(df, f"{staged}/{name}")
        if not move(spark, staged, path):
            raise ValueError(f"{path} is there already")
    finally:
        remove(spark, staged)
    return "written"


def snapshot(current: DataFrame, rendered: DataFrame, key: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records (key, classification) of the rendered features with an explicit class, and the document's one header row.

    The header holds count, counts by class as text in the order of classes, how many explicit ones are not rendered, and
    the digests of the records and of the rendered keys.
    """
    records = current.join(rendered.select(key).distinct(), key, "left_semi").select(key, "classification")
    hidden = current.join(rendered.select(key), key, "left_anti")
    counts = [F.count(F.when(F.col("classification") == c, 1)).alias(f"n_{i}") for i, c in enumerate(classes)]
    text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(f"n_{i}").cast("string")) for i, c in enumerate(classes)])
    one = F.lit(1).alias("row")
    parts = [
        records.agg(F.count("*").alias("count"), *counts).select(one, "count", text.alias("counts")),
        hidden.agg(F.count("*").alias("not_rendered")).select(one, "not_rendered"),
        state_digest(records, [key, "classification"]).select(one, F.col("sha256").alias("records_sha256")),
        state_digest(rendered.select(key).distinct(), [key]).select(one, F.col("n").alias("render_count"), F.col("sha256").alias("render_sha256")),
    ]
    header = parts[0]
    for part in parts[1:]:
        header = header.join(part, "row")
    return records, header.drop("row")


def snapshot_faults(records: DataFrame, header: DataFrame, key: str, classes: list[str], rendered: DataFrame | None = None) -> DataFrame:
    """rule and n of what is wrong with a snapshot that was read: repeated or null keys, unknown classes, count (or, if that holds, counts by class), digest, other columns than key and class.

    With rendered also its keys' count and digest, and how many records have no rendered feature.
    """
    rows = records.agg(
        F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.count(F.when(F.col(key).isNull(), 1)).alias("null_key"),
        F.count(F.when(~F.coalesce(F.col("classification").isin(*classes), F.lit(False)), 1)).alias("unknown_class"),
    )
    digest = state_digest(records, [key, "classification"]).select(F.col("sha256").alias("__sha256"))
    one = F.lit(1).alias("row")
    by_class = [F.count(F.when(F.col("classification") == c, 1)).alias(f"n_{i}") for i, c in enumerate(classes)]
    counted = records.agg(*by_class).select(F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(f"n_{i}").cast("string")) for i, c in enumerate(classes)]).alias("__counts"))
    j = rows.select(one, "*").join(header.select(one, "count", "counts", "records_sha256", "render_count", "render_sha256"), "row").join(digest.select(one, "__sha256"), "row").join(counted.select(one, "__counts"), "row")
    found = {
        "null_key": F.col("null_key"), "repeated_key": F.col("n") - F.col("keys") - F.col("null_key"), "unknown_class": F.col("unknown_class"),
        "count": F.abs(F.col("n") - F.col("count")), "records_sha256": (F.col("records_sha256") != F.col("__sha256")).cast("long"),
        "counts": ((F.col("counts") != F.col("__counts")) & (F.col("n") == F.col("count"))).cast("long"), "columns": F.lit(len({key, "classification"} ^ set(records.columns))),
    }
    if rendered is not None:
        keys = rendered.select(key).distinct()
        hidden = records.join(keys, key, "left_anti").agg(F.count("*").alias("__hidden"))
        j = j.join(state_digest(keys, [key]).select(one, F.col("n").alias("__keys"), F.col("sha256").alias("__keys_sha256")), "row").join(hidden.select(one, "__hidden"), "row")
        found |= {"render_count": F.abs(F.col("render_count") - F.col("__keys")), "render_sha256": (F.col("render_sha256") != F.col("__keys_sha256")).cast("long"), "not_rendered": F.col("__hidden")}
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("long").alias("n")) for k, v in found.items()])
    return j.select(F.explode(pairs).alias("p")).select("p.rule", "p.n").where("n <> 0")


def manifest(components: dict[str, DataFrame], level: str = "level") -> DataFrame:
    """role, n_records, levels (as text) and sha256 of each component of a package, from all columns of its tables."""
    out = None
    for role, df in components.items():
        levels = F.array_join(F.sort_array(F.collect_set(F.col(level).cast("string"))), ",") if level in df.columns else F.lit("")
        row = df.agg(levels.alias("levels")).select(F.lit(role).alias("role"), "levels")
        digest = state_digest(df, sorted(df.columns)).select(F.lit(role).alias("role"), F.col("n").alias("n_records"), "sha256")
        row = row.join(digest, "role").select("role", "n_records", "levels", "sha256")
        out = row if out is None else out.unionByName(row)
    return out


def package_identity(entries: DataFrame) -> DataFrame:
    """One row: the digest of a manifest's components, by role."""
    body = F.concat_ws("|", "role", F.col("n_records").cast("string"), "levels", "sha256")
    return entries.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(body)), ","), 256).alias("package_sha256"))


def manifest_faults(stored: DataFrame, found: DataFrame) -> DataFrame:
    """role and fault where the components found are not those of a stored manifest."""
    a = stored.select("role", F.struct("n_records", "levels", "sha256").alias("a"))
    b = found.select("role", F.struct("n_records", "levels", "sha256").alias("b"))
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "role", "full_outer").select("role", fault.alias("fault")).where("fault IS NOT NULL")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def recover(spark: SparkSession, path: str) -> str:
    """Where a swap was cut off: brings <path>.previous back if nothing is at path; else removes it."""
    previous = f"{path}.previous"
    if not exists(spark, previous):
        return "nothing"
    if exists(spark, path):
        remove(spark, previous)
        return "removed"
    move(spark, previous, path)
    return "restored"


def swap(df: DataFrame, path: str) -> None:
    """Replaces the table at path by df: staged and compared first, with the old one beside it until the new one is there."""
    spark, fresh = df.sparkSession, f"{path}.fresh-{uuid.uuid4().hex}"
    recover(spark, path)
    publish(df, fresh)
    if exists(spark, path):
        move(spark, path, f"{path}.previous")
    move(spark, fresh, path)
    remove(spark, f"{path}.previous")
