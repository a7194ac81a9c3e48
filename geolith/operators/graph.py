"""Connected components of an edge table, by contraction; nothing but tables leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.tables import remove, save


def contracted(edges: DataFrame) -> tuple[DataFrame, str]:
    """edges (a, b) of any type with an order to the saved table (v, label) of all vertices that have an edge, and its path.

    Each round every vertex joins its smallest neighbour (or itself), and the edges between the joined
    vertices go on to the next round.  With identifiers that are hashes, or begin with one, a round removes a
    constant share of the vertices on average.  Vertices with many edges are pre-aggregated before each
    shuffle.  Rounds are tables on disk, so that no plan grows with their number, and merged, since compressed files say little about the size of a broadcast.
    """
    used: list[str] = []
    mappings: list[DataFrame] = []
    current, path = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    used.append(path)
    while not current.isEmpty():
        both = current.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(current.select(F.col("b").alias("v"), F.col("a").alias("p")))
        parent, path = save(both.groupBy("v").agg(F.least(F.min("p"), F.col("v")).alias("p")), "parents")
        used.append(path)
        mappings.append(parent)
        step = current.hint("merge").join(parent.toDF("a", "pa"), "a").select("pa", "b")
        step = step.hint("merge").join(parent.toDF("b", "pb"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        current, path = save(step, "edges")
        used.append(path)
    if not mappings:
        labels = current.select(F.col("a").alias("v"), F.col("b").alias("label"))
    else:
        labels = mappings[-1].select("v", F.col("p").alias("label"))
        for mapping in reversed(mappings[:-1]):  # a vertex has the label of the one that it joined
            later = labels.select(F.col("v").alias("p"), "label")
            labels = mapping.hint("merge").join(later, "p", "left").select("v", F.coalesce("label", "p").alias("label"))
    out, path = save(labels, "labels")
    remove(edges.sparkSession, *used)
    return out, path


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), where a component is named by its smallest node."""
    hashed = edges.select(*[F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("key")).alias(c) for c in ("a", "b")])
    labels, _ = contracted(hashed)
    least = labels.groupBy("label").agg(F.min("v.key").alias("component"))
    return labels.hint("merge").join(least, "label").select(F.col("v.key").alias("node"), "component")
