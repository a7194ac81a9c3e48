"""Levels of detail: selection by cumulative score, chunks in spatial order, samples by rank.

Ranks and running sums over a whole table are computed in two steps: sums for ranges of the sort key, which
few rows describe, and windows within each range.  No task gets all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.tables import save


def _range_sorted(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """df in ranges of the order, numbered by __part, written once so that numbers hold when tasks are repeated."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")[0]


def running(df: DataFrame, order: list[Column], value: Column | None = None, parts: int | None = None) -> DataFrame:
    """Adds place (from 1) and, with value, before: the exact sum of value over all rows that come earlier."""
    ranged = _range_sorted(df if value is None else df.withColumn("__value", value), order, parts)
    sums = [F.count("*").alias("__n")] + ([] if value is None else [F.sum("__value").alias("__s")])
    totals = ranged.groupBy("__part").agg(*sums)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = totals.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"), *([] if value is None else [F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0")]))
    own = Window.partitionBy("__part").orderBy(*order)
    out = ranged.join(F.broadcast(base), "__part").withColumn("place", (F.col("__n0") + F.row_number().over(own)).cast("long"))
    if value is not None:
        inside = F.coalesce(F.sum("__value").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("before", F.col("__s0") + inside)
    return out.drop("__part", "__n0", "__s0", "__value")


def top_fraction(df: DataFrame, score: str, key: str, numerator: int, denominator: int, exact: bool = True) -> DataFrame:
    """The rows of highest score (ties by key) that together reach the fraction of the total, with the row that crosses it.

    score is a whole number.  With exact, sums are compared as integers; otherwise with the double
    total * (numerator / denominator).
    """
    order = [F.desc(score), F.asc(key)]
    placed = running(df, order, F.col(score).cast("decimal(38,0)"))
    total = df.agg(F.sum(F.col(score).cast("decimal(38,0)"))).scalar()
    if exact:
        keep = F.col("before") * F.lit(denominator) < total * F.lit(numerator)
    else:
        keep = F.col("before").cast("double") < total.cast("double") * F.lit(numerator / denominator)
    return placed.where(keep).drop("place", "before")


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds chunk: groups of ``size`` rows in the order."""
    placed = running(df, [F.asc(c) for c in order])
    return placed.withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("long")).drop("place")


def chunk_index(chunked: DataFrame) -> DataFrame:
    """Count and bounds of each chunk: the zone map that viewports prune with."""
    return chunked.groupBy("chunk").agg(F.count("*").alias("n"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def rank_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows at evenly spaced ranks: offset rint(i * (total - 1) / (n - 1)), halves to even, each once."""
    total = df.agg(F.count("*")).scalar()
    offset = F.rint(F.col("id") * (total - 1) / F.lit(max(n - 1, 1)))
    wanted = df.sparkSession.range(max(n, 0)).select(offset.cast("long").alias("place0")).distinct()
    placed = running(df, [F.asc(c) for c in order])
    return placed.join(F.broadcast(wanted), F.col("place") == F.col("place0") + 1).drop("place", "place0")


def not_monotone(coarse: DataFrame, fine: DataFrame, key: str) -> DataFrame:
    """Keys of the coarser level that the finer one lacks."""
    return coarse.select(key).join(fine.select(key), key, "left_anti")


def growth_faults(coarse: DataFrame, fine: DataFrame, key: str, vertices: str) -> DataFrame:
    """key, and its vertices on either level, of the features that have more of them on the coarser one."""
    j = coarse.select(key, F.col(vertices).alias("n_coarse")).join(fine.select(key, F.col(vertices).alias("n_fine")), key)
    return j.where("n_coarse > n_fine")


def ordinal_faults(df: DataFrame, group: list[str], ordinal: str) -> DataFrame:
    """Groups whose ordinals are not 1 to n, each once."""
    stats = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(ordinal).alias("n_distinct"), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"))
    return stats.where("n <> n_distinct OR first <> 1 OR last <> n")
