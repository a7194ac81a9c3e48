"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line stripped of white space, A-Z in lower case.  Keys of at least ``min_points``
code points stay only in the smallest doc_id that holds them.  Batches of documents are taken in
ascending ranges of doc_id: each anti-joins its line hashes with the runs that are there and adds
those that are new, with the smallest doc_id of the batch, as a sorted run; when ``fanout`` runs lie
on a level they are compacted into one of the next level.  Keys are held as 128-bit hashes.

Null or empty texts are one empty line.  Rows without doc_id keep all their lines and own none;
rows that repeat a doc_id are one document: a line in two of them is no repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.common import WHITE, map_batches, remove, save, sliced, small_batches, table


#: Lines in more than one in HEAVY of all (document, line), and in LEAST at least, are common: there are HEAVY of them at most.
HEAVY, LEAST = 10_000, 200


def _keys(text: str, min_points: int) -> list[bytes]:
    """For each line the hash of its key, or b'' if the key is too short."""
    out = []
    for line in text.split("\n"):
        key = line.strip(WHITE)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_points else b"")
    return out


def _line_hashes(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, hashes = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = dict.fromkeys(_keys(text or "", min_points))
                own.pop(b"", None)
                hashes.extend(own)
                ids.append(np.full(len(own), doc_id, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], ["h", "doc_id"])

    return run


class LineRuns:
    """Levels of sorted runs (h, owner); a hash lies in one run only."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[DataFrame, str]]] = [[]]

    def entries(self) -> DataFrame | None:
        out = None
        for run in (run for level in self.levels for run, _ in level):
            out = run if out is None else out.unionByName(run)
        return out

    def _write(self, entries: DataFrame, level: int) -> None:
        self.levels[level].append(save(entries.sortWithinPartitions("h"), f"lines{level}"))

    def add(self, batch: DataFrame) -> None:
        """batch: (h, doc_id) of documents that come after all earlier ones."""
        new = batch.groupBy("h").agg(F.min("doc_id").alias("owner"))
        known = self.entries()
        self._write(new if known is None else new.join(known, "h", "left_anti"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            merged = full[0][0]
            for run, _ in full[1:]:
                merged = merged.unionByName(run)
            self._write(merged.repartition("h"), level + 1)
            remove(self.spark, *(path for _, path in full))
            level += 1


def _rebuild(min_points: int, names: list[str]):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                if gone:
                    gone = set(gone)
                    kept = [line for line, key in zip(text.split("\n"), _keys(text, min_points), strict=True) if key not in gone]
                    text = "\n".join(kept)
                    dropped.append(n - len(kept))
                else:
                    dropped.append(0)
                texts.append(text)
                lines.append(n)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "__n_lines", "__n_dropped"])

    return run


def line_dedup(docs: DataFrame, min_points: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of docs, text without its repeated lines, and __n_lines and __n_dropped.

    batches: ranges of doc_id that are taken in one after the other.  Columns of docs whose names begin with
    two underscores and clash with those are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("__n_lines", "__n_dropped", "__id", "__gone")
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    cuts = [int(x) for x in docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001)]
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("doc_id") > cut).cast("int")
    hashes = small_batches(rows).mapInArrow(_line_hashes(min_points), "h binary, doc_id long").withColumn("batch", number)
    staged, staged_path = save(hashes, "linehashes")
    runs = LineRuns(spark, fanout)
    for i in range(len(cuts) + 1):
        runs.add(staged.where(F.col("batch") == i).drop("batch"))
    # Lines of other documents than their owners go.  Owners of lines that very many documents hold are broadcast, HEAVY of
    # them at most, so that these documents spread over tasks.
    owners = runs.entries()
    most = max(LEAST, -(-staged.count() // HEAVY))
    common, _ = save(staged.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("h").join(owners, "h").select("h", "owner"), "commonlines")
    often = staged.join(F.broadcast(common), "h")
    seldom = staged.join(F.broadcast(common.select("h")), "h", "left_anti").join(owners, "h")
    gone = often.select("doc_id", "h", "owner").unionByName(seldom.select("doc_id", "h", "owner")).where("doc_id > owner")
    gone = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("h").alias("__gone"))
    gone, _ = save(gone, "gonelines")
    remove(spark, staged_path)
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left").select(*[F.col(f"`{n}`") for n in names], "__gone")
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType, True) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    return map_batches(joined, _rebuild(min_points, names), schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, t.line, t.pos,
         translate(regexp_replace(t.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) t),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.*, coalesce(l.doc_id > o.owner, false) AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
