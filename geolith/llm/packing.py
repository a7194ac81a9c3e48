"""Best-fit packing of token sequences by a configuration linear program.

The pieces of the documents are counted by length on the cluster; that histogram has at most
``capacity`` bars whatever the corpus holds.  On it the covering program
``min sum x_p  with  sum_p a_pl x_p >= n_l`` over patterns p (multisets of lengths that fit) is solved
by multiplicative weights: the weight of a length falls as it is covered, and each round's patterns, one
for each length that is behind, are priced by a dynamic program for the knapsack.  Rounds go on until every
length is covered to a thousandth.  The fractional solution is rounded, and what is left, the fractional
rest, is packed best-fit, largest lengths first.  The plan is a short list of runs for each length (so many
places from this sequence on), so that every piece finds its place from its rank among the pieces of its
length.  Ranks come from counts by (length, salt), so that one common length does not meet in one task.

Null texts are empty documents: one piece with the end id alone.  Rows without doc_id are packed like
others; rows that repeat a doc_id are packed each.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.llm import wordtokens
from geolith.llm.bpe import read_vocabulary
from geolith.llm.common import save, sliced, small_batches, table

#: Salts that the pieces of one length are dealt over.
SALTS = 256


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room 0..capacity, by dynamic programming: a length in the most valuable filling (0: none), and the room that it fills.

    value[l]: of one piece of length l; lengths without value are not used.
    """
    lengths = np.flatnonzero(value > 0)
    gains = value[lengths]
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = gains[:k] + best[c - lengths[:k]]
            if got[i := int(got.argmax())] > best[c]:
                best[c], choice[c] = got[i], lengths[i]
    return choice, np.maximum.accumulate(np.where(choice > 0, np.arange(capacity + 1), 0))


def solve(counts: np.ndarray, capacity: int, rounds: int = 3000, rate: float = 0.3, slices: int = 3, tolerance: float = 1e-3) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """Patterns, as (length, copies), and fractional multiplicities that cover all but ``tolerance`` of each bar of ``counts``.

    In each round every length, largest first, that is behind the round's share of its pieces gets the best pattern
    that holds it, at most as often as no length of the pattern is covered beyond its pieces.  Prices of
    lengths fall by exp(-rate x share covered); covered ones have none.
    """
    need = counts.astype(float)
    left = need.copy()
    size = np.arange(capacity + 1) * (1 + 0.1 * np.arange(capacity + 1) / capacity)  # long pieces first, as short ones fill gaps
    used: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    for turn in range(rounds):
        short = left > tolerance * need
        if not short.any():
            break
        share = 1 - left / np.maximum(need, 1)
        choice, filled = (x.tolist() for x in knapsack(np.where(short, size * np.exp(-rate * share), 0.0), capacity))
        later = need * max(0.0, 1 - (turn + 1) / slices)
        for length in np.flatnonzero(short)[::-1].tolist():
            behind = left[length] - later[length]
            if behind <= 0:
                continue
            pattern = {length: 1}
            room = filled[capacity - length]
            while room:
                piece = choice[room]
                pattern[piece] = pattern.get(piece, 0) + 1
                room = filled[room - piece]
            step = min(behind / pattern[length], *(left[k] / n for k, n in pattern.items()))
            if step > 0:
                for k, n in pattern.items():
                    left[k] = max(0.0, left[k] - n * step)
                used[tuple(sorted(pattern.items()))] += step
    return sorted(used.items(), key=lambda u: (-u[1], u[0]))


def plan(counts: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Whole patterns (copies of each length) and multiplicities that hold exactly the pieces of ``counts``."""
    return [x[:2] for x in _plan(counts, capacity, rounds)]


def _plan(counts: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, int, bool]]:
    """Patterns, multiplicities, and whether they come from the linear program (or a piece that fills a sequence)."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int, bool]] = []

    def use(pattern: np.ndarray, most: int, solved: bool = True) -> None:
        held = pattern > 0
        m = min(most, int((left[held] // pattern[held]).min()))
        if m > 0:
            out.append((pattern, m, solved))
            left[held] -= pattern[held] * m

    full = np.zeros(capacity + 1, np.int64)
    full[capacity] = 1
    if left[capacity]:
        use(full, int(left[capacity]))
    # Rounded down; the fractions, added up in order, give one more sequence each time that they reach one.
    rest = 0.0
    for pieces, x in solve(left, capacity, rounds) if left.any() else []:
        rest += x - int(x)
        most, rest = (int(x) + 1, rest - 1) if rest >= 1 else (int(x), rest)
        if most:
            pattern = np.zeros(capacity + 1, np.int64)
            for length, n in pieces:
                pattern[length] = n
            use(pattern, most)
    while left.any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        lengths = np.flatnonzero(left)
        while room:
            i = int(np.searchsorted(lengths, room, "right")) - 1
            while i >= 0 and pattern[lengths[i]] >= left[lengths[i]]:
                i -= 1
            if i < 0:
                break
            length = int(lengths[i])
            copies = min(room // length, int(left[length] - pattern[length]))
            pattern[length] += copies
            room -= copies * length
        use(pattern, 1 << 60, False)
    return out


def runs_of(patterns: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, copies in a sequence, first sequence and first offset of each run."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    placed: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, m in patterns:
        offset = 0
        for length in np.flatnonzero(pattern)[::-1].tolist():
            copies = int(pattern[length])
            runs[length].append((placed[length], copies, sequence, offset))
            placed[length] += copies * m
            offset += copies * length
        sequence += m
    return {length: tuple(np.array(column, np.int64) for column in zip(*own, strict=True)) for length, own in runs.items()}


def cut(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordtokens.model(shipped.value)
        for batch in sliced(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 0, capacity: int = 2048, rounds: int = 3000) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    path = vocabulary_path or public_tokenizers.path("word_bpe_49k.json")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    pieces, _ = save(cut(docs, path, end_id, capacity).withColumn("salt", salt), "pieces")
    bars = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    bars, _ = save(bars, "bars")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in bars.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length up to capacity
        counts[length] = n
    runs = spark.sparkContext.broadcast(runs_of(plan(counts, capacity, rounds)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = bars.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = runs.value
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                first, copies, start, base = where[length]
                run = np.searchsorted(first, ranks[at], "right") - 1
                turn = ranks[at] - first[run]
                sequence[at] = start[run] + turn // copies[run]
                offset[at] = base[run] + turn % copies[run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
