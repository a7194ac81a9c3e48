"""Exact deduplication with a log-structured merge index of digests (DataFrame operations only).

Documents are equal when their texts are identical after deleting white space.  A batch of documents
(a memtable, spread over the cluster) is reduced to one entry for each digest and flushed as a sorted
run of Parquet files, with a Bloom filter of Parquet's for each row group.  When ``fanout`` runs lie on
a level, compaction merges them into one run of the next level and keeps, for each digest, the entry
that wins: most code points, then the smallest identifier.  Rows whose digest has company are hits;
their normalised bytes are compared with those of the winner before they count as copies.

Digests of which there are very many rows, HEAVY at most by their definition, are broadcast or salted where the rows
meet them, so that the copies of one text spread over tasks.

Null texts count as empty.  A null doc_id is a document of its own that only stays if no other copy
is as long; repeated rows with one doc_id are copies of each other like any others, of which one row stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.common import WHITE, bit_filter, may_contain, remove, save, table


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Digests that hold more than one in HEAVY of all rows, and LEAST rows at least, are heavy: there are HEAVY of them at most.
HEAVY, LEAST = 10_000, 200


def best(doc_id: str, row: str) -> Column:
    """By which of equal texts one stays: most code points, a doc_id, the smallest one, the first row."""
    return F.struct(F.col("n_points"), F.col(doc_id).isNotNull(), F.bitwise_not(F.col(doc_id)), F.bitwise_not(F.col(row)))


class DigestIndex:
    """Levels of sorted runs (digest, n_points, keep_id, keep_row, group_size) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[DataFrame, str]]] = [[]]

    @staticmethod
    def _merged(entries: DataFrame) -> DataFrame:
        """One entry for each digest; partial aggregation keeps hot digests small before the shuffle."""
        first = best("keep_id", "keep_row")
        return entries.groupBy("digest").agg(
            F.max("n_points").alias("n_points"), F.max_by("keep_id", first).alias("keep_id"), F.max_by("keep_row", first).alias("keep_row"), F.sum("group_size").alias("group_size")
        )

    def _flush(self, entries: DataFrame, level: int) -> None:
        run = self._merged(entries).sortWithinPartitions("digest")
        self.levels[level].append(save(run, f"run{level}", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}))

    def add(self, memtable: DataFrame) -> None:
        """Flushes a memtable (digest, n_points, doc_id, row) and compacts the levels that are full."""
        self._flush(memtable.select("digest", "n_points", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        if len(self.levels) == level + 1:
            self.levels.append([])
        full, self.levels[level] = self.levels[level], []
        entries = full[0][0]
        for run, _ in full[1:]:
            entries = entries.unionByName(run)
        self._flush(entries, level + 1)
        remove(self.spark, *(path for _, path in full))

    def entries(self) -> DataFrame:
        """One entry for each digest, over all runs."""
        runs = [run for level in self.levels for run, _ in level]
        if len(runs) == 1:
            return runs[0]
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return self._merged(out)

    def find(self, digests: list[str]) -> DataFrame:
        """The entries of a few digests; Parquet's zone maps and Bloom filters skip the other row groups."""
        return self.entries().where(F.col("digest").isin(digests))


def exact_dedup(docs: DataFrame, memtables: int = 4, fanout: int = 4, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    memtables: batches in which the index takes the rows in; fanout: runs on a level before it is
    compacted; digest: of the normalised text (a weak one is for tests; byte verification holds).
    """
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), digest(norm).alias("digest"),
        sha256(norm).alias("text_sha256"), F.monotonically_increasing_id().alias("row"),
    )
    staged, _ = save(rows.withColumn("memtable", F.pmod(F.xxhash64("doc_id", "row"), F.lit(memtables)).cast("int")), "digests")
    index = DigestIndex(spark, fanout)
    for i in range(memtables):
        index.add(staged.where(F.col("memtable") == i))
    groups = index.entries().where("group_size > 1").select("digest", "keep_id", "keep_row", "group_size", F.col("n_points").alias("keep_points"))
    groups, _ = save(groups, "groups")
    most = max(LEAST, -(-staged.count() // HEAVY))
    heavy = F.broadcast(groups.where(F.col("group_size") > most).select("*", F.ceil(F.col("group_size") / most).cast("int").alias("salts")))
    light = groups.where(F.col("group_size") <= most)

    # Byte verification: hits against the texts of the winners of their digests.
    bits = bit_filter(groups, F.xxhash64("digest"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    hits, hits_path = save(may_contain(texts, F.xxhash64("digest"), bits).withColumn("row", F.monotonically_increasing_id()), "hits")
    tagged = hits.join(heavy.select("digest", "keep_id", "keep_points", "salts"), "digest", "left")
    won = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    of_heavy = tagged.where(F.col("salts").isNotNull() & won).groupBy("digest", "salts").agg(F.min("norm").alias("keep_norm"))
    of_heavy = of_heavy.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "keep_norm")
    few = tagged.where("salts IS NULL").select("digest", "doc_id", "n_points", "norm", F.lit(0).alias("salt"))
    of_light = few.join(light.select("digest", "keep_id", "keep_points"), "digest").where(won).groupBy("digest", "salt").agg(F.min("norm").alias("keep_norm"))
    winner, winner_path = save(of_heavy.unionByName(of_light), "winners")
    salted = tagged.select("digest", "norm", F.coalesce(F.pmod(F.col("row"), F.col("salts")).cast("int"), F.lit(0)).alias("salt"))
    differ = salted.join(winner, ["digest", "salt"]).where(F.col("norm") != F.col("keep_norm")).select("digest").distinct()
    differ, differ_path = save(differ, "collisions")
    collided = not differ.isEmpty()

    def named(rows: DataFrame) -> DataFrame:
        single = F.col("group_size").isNull()
        return rows.select(
            "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (single | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", "digest",
        )

    out = named(staged.join(heavy, "digest")).unionByName(named(staged.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest", "left")))
    if collided:  # different texts under one digest: these groups are made again from their bytes
        out = out.join(differ, "digest", "left_anti").drop("digest").unionByName(_by_bytes(hits.join(differ, "digest", "left_semi")))
    else:
        out = out.drop("digest")
        remove(spark, differ_path, hits_path)
    remove(spark, winner_path)
    return out.select(*COLUMNS)


def _by_bytes(rows: DataFrame) -> DataFrame:
    """Groups of rows by their normalised bytes, for digests that collided."""
    first = best("doc_id", "row")
    groups = rows.groupBy("norm").agg(F.max_by("doc_id", first).alias("keep_id"), F.max_by("row", first).alias("keep_row"), F.count("*").alias("group_size"))
    return rows.join(groups, "norm").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size,
         arg_min(doc_id, {'a': -n_points, 'b': doc_id}) AS keep_id
  FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
