"""Exact top-k search by integer inner product with a KD-tree per shard.

Components become floor(256 * x).  Candidates are dealt over shards of about ``shard_rows`` rows of one length
(fewer, if they are wide); each shard becomes a KD-tree, built by median splits of the widest side, whose nodes have
tight bounding boxes.  A query goes through a tree best first: the node with the highest bound next, where the bound of
a box is the largest inner product that any of its points could have, until no bound beats the query's k-th score.
That k-th score is propagated: a first pass over one shard gives each query a score to beat in all others.

Queries are the rows whose vec_id is divisible by ``every``, in blocks of ``block_rows``.  A shard comes once to a
task, which builds its tree, and the blocks of queries stream past it.  Vectors that are null or hold null or
non-finite components and rows without vec_id take no part; vectors of different lengths are no candidates of each
other.  Products that doubles can't hold exactly are computed in integers; a score that no long can hold is given as
the nearest long, but ranked as it is.  Ties go to the smaller vec_id; rows that repeat a vec_id are candidates each,
and a query's own vec_id never is one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.llm.common import save, table

LEAF = 128
#: Sums of larger products are not exact in doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Bytes of the vectors of a shard or block at most, unless a single vector is larger.
MOST_BYTES = 16 << 20


def floored(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, which hold it exactly; infinite if it is too large for one."""
    with np.errstate(over="ignore"):
        return np.floor(256.0 * x)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of any finite x as Python's integers."""
    whole = [int(np.floor(256.0 * e)) if abs(e) < 1e300 else 256 * int(e) for e in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def sortable(n: int) -> str:
    """A text for each integer, in their order."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):09d}{digits}"
    return f"0{999_999_999 - len(digits):09d}" + "".join(str(9 - int(d)) for d in digits)


class Tree:
    """Rows in leaf order, with the boxes and children of all nodes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        """ids and vectors (unfloored) of the rows."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.first: list[int] = []  # left child (the right one is next), or -1 for a leaf
        self.span: list[tuple[int, int]] = []
        order = np.arange(len(ids))
        todo = [(0, len(ids), self._node(self.x, 0, len(ids)))]
        while todo:
            start, end, node = todo.pop()
            if end - start <= LEAF or not x.shape[1]:
                continue
            with np.errstate(over="ignore"):
                side = int((self.high[node] - self.low[node]).argmax())
            if self.low[node][side] == self.high[node][side]:
                continue
            own = order[start:end]
            middle = (end - start) // 2
            own = own[np.argpartition(self.x[own, side], middle, kind="introselect")]
            order[start:end] = own
            cut = start + middle
            left = self._node(self.x[order[start:cut]], start, cut)
            right = self._node(self.x[order[cut:end]], cut, end)
            self.first[node] = left
            assert right == left + 1
            todo += [(start, cut, left), (cut, end, right)]
        self.ids, self.x = self.ids[order], self.x[order]
        self.lows, self.highs = np.array(self.low), np.array(self.high)
        self.rows, self.floor_lows, self.floor_highs = floored(self.x), floored(self.lows), floored(self.highs)
        self.largest = float(np.abs(self.rows).max(initial=0.0))
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def _node(self, rows: np.ndarray, start: int, end: int) -> int:
        self.low.append(rows.min(0))
        self.high.append(rows.max(0))
        self.first.append(-1)
        self.span.append((start, end))
        return len(self.first) - 1

    def search(self, query_id: int, x: np.ndarray, k: int, beat: float) -> list[tuple[int, int]]:
        """At most k (score, vec_id), best first; scores below ``beat`` need not be found."""
        query = floored(x)
        exact = self.largest * float(np.abs(query).max(initial=0.0)) * max(1, len(query)) < EXACT
        if exact:
            lows, highs = self.floor_lows, self.floor_highs
        else:
            query = integers(x)
            if self.whole is None:
                self.whole = integers(self.lows), integers(self.highs)
            lows, highs = self.whole
        bounds = np.where(query > 0, query * highs, query * lows).sum(1)
        found: list[tuple] = []  # (score, -vec_id), a heap with the worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < beat or (len(found) == k and -bound < found[0][0]):
                break
            left = self.first[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[left + 1], left + 1))
                continue
            start, end = self.span[node]
            scores = self.rows[start:end] @ query if exact else integers(self.x[start:end]) @ query
            least = max(beat, found[0][0]) if len(found) == k else beat
            at = np.flatnonzero((scores >= least).astype(bool) & (self.ids[start:end] != query_id))
            if len(at) > k:  # of many with one score the smallest identifiers count
                at = at[np.argsort(self.ids[start:end][at], kind="stable")]
                at = at[np.argsort(-scores[at], kind="stable")[:k]]
            for i in at.tolist():
                entry = (int(scores[i]), -int(self.ids[start + i]))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def _packed(rows: pa.Table) -> pa.Table:
    """One row: the identifiers and vectors of a shard or block as bytes, in ascending order of vec_id."""
    rows = rows.sort_by("vec_id")
    values = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
    ids = rows.column("vec_id").to_numpy().astype("<i8")
    return pa.table({"dims": rows.column("dims")[:1], "number": rows.column("number")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([values.tobytes()], pa.binary())})


def _search(k: int):
    """Rows: dims, ids, vectors and beat; null beat: a shard; else a block of queries for the last shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in range(batch.num_rows):
                dims, ids, vectors, beat = (batch.column(i)[row].as_py() for i in range(4))
                ids = np.frombuffer(ids, "<i8")
                vectors = np.frombuffer(vectors, "<f8").reshape(len(ids), dims)
                if beat is None:
                    tree = Tree(ids, vectors)
                    continue
                least = {b["query_id"]: int(b["beat"]) for b in beat}
                out: tuple[list, list, list, list] = ([], [], [], [])
                for query_id, query in zip(ids.tolist(), vectors, strict=True):
                    for score, vec_id in tree.search(query_id, query, k, least.get(query_id, -np.inf)):
                        near = max(-LONG - 1, min(LONG, score))
                        for column, value in zip(out, (query_id, vec_id, near, sortable(score - near)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; vectors: vec_id, embedding."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("v"), F.size(x).alias("dims"))

    def dealt(of: DataFrame, most: int) -> DataFrame:
        """of in numbered groups of one length of about ``most`` rows, fewer for wide vectors, by a hash of vec_id."""
        n = max(1, of.count())
        groups = F.greatest(F.lit(-(-n // most)), F.ceil(F.lit(n) * F.col("dims") * 8 / F.lit(MOST_BYTES)))
        return of.withColumn("number", F.pmod(F.xxhash64("vec_id"), groups).cast("long"))

    def packed(of: DataFrame, tag: str) -> DataFrame:
        return save(of.groupBy("dims", "number").applyInArrow(_packed, "dims int, number long, ids binary, vectors binary"), tag)[0]

    shards = packed(dealt(rows, shard_rows), "shards")
    asked = dealt(rows.where(F.col("vec_id") % every == 0), block_rows)
    blocks = packed(asked, "queries").withColumnRenamed("number", "block")

    def searched(of: DataFrame, by: DataFrame) -> DataFrame:
        """Every block meets the shards of its length once: a shard, and after it the blocks that stream past it."""
        numbers = of.select("dims", "number")
        left = of.select("dims", "number", F.lit(-1).cast("long").alias("block"), "ids", "vectors", F.lit(None).cast(BEAT).alias("beat"))
        right = by.join(numbers, "dims").select("dims", "number", "block", "ids", "vectors", F.coalesce("beat", F.array().cast(BEAT)).alias("beat"))
        # By a hash, which nothing below is dealt by, so that no planner takes the two sides of the union for dealt already.
        met = left.unionByName(right).withColumn("to", F.xxhash64("dims", "number")).repartition("to").sortWithinPartitions("dims", "number", "block")
        return met.select("dims", "ids", "vectors", "beat").mapInArrow(_search(k), "query_id long, vec_id long, score long, beyond string")

    pilot = shards.join(shards.groupBy("dims").agg(F.min("number").alias("number")), ["dims", "number"], "left_semi")
    first = searched(pilot, blocks.withColumn("beat", F.lit(None).cast(BEAT)))
    # The k-th score of a query on the pilot shard, if it has k there: others need not look below it.
    best = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("beat")).where(F.col("n") == k)
    beats = asked.select("dims", F.col("number").alias("block"), F.col("vec_id").alias("query_id")).join(best, "query_id").groupBy("dims", "block").agg(F.collect_list(F.struct("query_id", "beat")).alias("beat"))  # a block's rows at most
    beats, _ = save(beats, "beats")
    found = searched(shards, blocks.join(beats, ["dims", "block"], "left"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


BEAT = "array<struct<query_id: long, beat: long>>"


def op4_kdtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
