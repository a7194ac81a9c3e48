"""Chunks of records as compressed, checksummed payloads with a zone map, written and read as Parquet.

A row is a chunk: level, chunk, n, bounds, payload (deflated lines of JSON in the order of the record's
identity), records_sha256 of the lines and payload_sha256.  Readers filter by level and bounds before any
payload is inflated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions.geometry import deflated, inflated
from geolith.functions.spatial import intersects
from geolith.tables import save

BOX = ("min_x", "min_y", "max_x", "max_y")


def encode(rows: DataFrame, key: str) -> DataFrame:
    """rows: level, chunk, key, the bounds and any other columns.  Chunks are small by construction (see levels.chunks)."""
    record = F.struct(*[c for c in rows.columns if c not in ("level", "chunk")])
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(record).alias("line")))), lambda r: r["line"]), "\n")
    bounds = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX]
    chunks = rows.groupBy("level", "chunk").agg(F.count("*").alias("n"), *bounds, lines.alias("lines"))
    chunks = chunks.withColumn("payload", deflated(F.col("lines").cast("binary")))
    return chunks.select("level", "chunk", "n", *BOX, "payload", F.sha2("lines", 256).alias("records_sha256"), F.sha2("payload", 256).alias("payload_sha256"))


def _checked(value: Column, sha256: str, what: str) -> Column:
    return F.when(F.sha2(value, 256) == F.col(sha256), value).otherwise(F.raise_error(F.lit(f"{what} checksum does not hold")).cast("binary"))


def decode(chunks: DataFrame, schema: str, level: int | None = None, view: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The records, with level and chunk; fails where a checksum does not hold."""
    if level is not None:
        chunks = chunks.where(F.col("level") == level)
    if view is not None:
        chunks = chunks.where(intersects(BOX, tuple(F.lit(float(v)) for v in view)))
    opened = chunks.withColumn("__lines", inflated(_checked(F.col("payload"), "payload_sha256", "a payload's")))
    text = _checked(F.col("__lines"), "records_sha256", "the records'").cast("string")
    rows = opened.select("level", "chunk", F.explode(F.split(text, "\n")).alias("line"))
    return rows.select("level", "chunk", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("level", "chunk", "r.*")


def faults(chunks: DataFrame, key: str) -> DataFrame:
    """level, chunk and rule of what is wrong with a container, without failing.

    'payload_sha256'; 'records_sha256' and 'count' of what a sound payload holds; 'bounds' that aren't those of its records; 'order': its records are not
    in the order of their key; 'chunks': the chunks of a level (chunk null) are not numbered from 0 on, each once; 'repeated': a chunk has a key that an earlier chunk of its level has.
    """
    sound = F.sha2("payload", 256) == F.col("payload_sha256")
    opened, _ = save(chunks.withColumn("__lines", inflated(F.when(sound, F.col("payload")))), "opened")
    lines = F.split(F.col("__lines").cast("string"), "\n")
    field = lambda name: F.transform(lines, lambda x: F.get_json_object(x, f"$.{name}"))
    number = lambda name: F.transform(field(name), lambda v: v.cast("double"))
    box = {c: (F.array_min if c.startswith("min") else F.array_max)(number(c)) for c in BOX}
    keys = F.transform(field(key), lambda v: F.struct(v.cast("decimal(38,0)").alias("n"), v.alias("v")))
    read = F.col("__lines").isNotNull()
    rules = {
        "payload_sha256": ~F.coalesce(sound, F.lit(False)), "records_sha256": read & (F.sha2("__lines", 256) != F.col("records_sha256")), "count": read & (F.size(lines) != F.col("n")),
        "bounds": read & ~F.forall(F.array(*[box[c].eqNullSafe(F.col(c)) for c in BOX]), lambda x: x), "order": read & (keys != F.array_sort(keys)),
    }
    named = opened.select("level", "chunk", F.explode(F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    stats = opened.groupBy("level").agg(F.count("*").alias("c"), F.count_distinct("chunk").alias("d"), F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    gaps = stats.where("c <> d OR first <> 0 OR last <> c - 1").select("level", F.lit(None).cast(chunks.schema["chunk"].dataType).alias("chunk"), F.lit("chunks").alias("rule"))
    ids = opened.where(read).select("level", "chunk", F.explode(field(key)).alias("id"))
    first = ids.groupBy("level", "id").agg(F.min("chunk").alias("first"), F.count("*").alias("c")).where("c > 1").select("level", "id", "first")
    again = ids.join(first, ["level", "id"]).where("chunk > first").select("level", "chunk").distinct().withColumn("rule", F.lit("repeated"))
    return named.unionByName(gaps).unionByName(again)


def write(chunks: DataFrame, path: str) -> None:
    """Sorted by level and chunk, so that Parquet's statistics prune by level and bounds."""
    chunks.repartitionByRange("level", "chunk").sortWithinPartitions("level", "chunk").write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
