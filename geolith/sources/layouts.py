"""Layouts of chunk payloads: a directory of one file a chunk, and a flat sequence of bytes with an index of ranges.

The flat sequence is a table of segments, each the bytes of the chunks that begin in it; offsets count over all segments.
They are sums over ranges of the chunks' order, so that no task sees all chunks.  Both layouts are tables: a row is
what one file would hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.operators.levels import running
from geolith.tables import save

#: Bytes of a segment after which the next chunk begins another one.
SEGMENT_BYTES = 64 << 20


def directory(chunks: DataFrame, path: Column) -> DataFrame:
    """path, payload and payload_sha256: a file for each chunk (level, chunk, payload)."""
    return chunks.select(path.alias("path"), "level", "chunk", "payload", F.sha2("payload", 256).alias("payload_sha256"))


def flat(chunks: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Segments (segment, base, bytes) and the index (level, chunk, segment, offset, length, payload_sha256) of chunks in the order of level and chunk."""
    sized = chunks.select("level", "chunk", "payload", F.octet_length("payload").cast("long").alias("length"))
    placed = running(sized, [F.asc("level"), F.asc("chunk")], F.col("length")).withColumn("offset", F.col("before").cast("long")).drop("before", "place")
    placed, _ = save(placed.withColumn("segment", F.floor(F.col("offset") / segment_bytes).cast("long")), "placed")
    joined = placed.groupBy("segment").agg(F.min("offset").alias("base"), F.expr("listagg(payload) WITHIN GROUP (ORDER BY offset, level, chunk)").alias("bytes"))
    index = placed.select("level", "chunk", "segment", "offset", "length", F.sha2("payload", 256).alias("payload_sha256"))
    return save(joined, "segments")[0], index


def read_flat(segments: DataFrame, index: DataFrame) -> DataFrame:
    """level, chunk, payload and fault of the chunks of an index: their ranges of the segments, 'range' if a segment lacks it and 'sha256' if it has another digest.

    Only the segments that the index names are read; a segment's bytes go to one row, and its chunks are cut there.
    """
    ranges = index.groupBy("segment").agg(F.collect_list(F.struct("level", "chunk", "offset", "length", "payload_sha256")).alias("chunks"))
    j = ranges.join(segments, "segment", "left")

    def cut(c: Column) -> Column:
        at = c["offset"] - F.col("base")
        there = (at >= 0) & (at + c["length"] <= F.octet_length("bytes"))
        payload = F.when(there, F.substring(F.col("bytes"), (at + 1).cast("int"), c["length"].cast("int")))
        return F.struct(c["level"].alias("level"), c["chunk"].alias("chunk"), payload.alias("payload"), c["payload_sha256"].alias("want"))

    rows = j.select(F.explode(F.transform("chunks", cut)).alias("c")).select("c.*")
    fault = F.when(F.col("payload").isNull(), "range").when(F.sha2("payload", 256) != F.col("want"), "sha256")
    return rows.select("level", "chunk", "payload", fault.alias("fault"))


def index_faults(index: DataFrame, n_bytes: int | Column) -> DataFrame:
    """level, chunk and rule where the ranges of an index don't follow each other: 'gap' or 'overlap' before a chunk, 'start' of the first, 'tail' of the last.

    n_bytes: how many bytes all segments have.  Each chunk meets the one before by its place in the order.
    """
    placed, _ = save(running(index.select("level", "chunk", "offset", "length"), [F.asc("offset"), F.asc("level"), F.asc("chunk")]), "ordered")
    before = placed.select((F.col("place") + 1).alias("place"), (F.col("offset") + F.col("length")).alias("end"))
    n_bytes = F.lit(n_bytes) if isinstance(n_bytes, int) else n_bytes
    j = placed.join(before, "place", "left").withColumns({"__last": placed.agg(F.max("place")).scalar(), "__bytes": n_bytes})
    first = F.when(F.col("end").isNull() & (F.col("offset") != 0), "start").when(F.col("offset") > F.col("end"), "gap").when(F.col("offset") < F.col("end"), "overlap")
    last = F.when((F.col("place") == F.col("__last")) & (F.col("offset") + F.col("length") != F.col("__bytes")), "tail")
    return j.select("level", "chunk", F.explode(F.filter(F.array(first, last), lambda x: x.isNotNull())).alias("rule"))
