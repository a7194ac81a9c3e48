"""Helpers shared by the training-data operators: shared tables, bounded filters, tables on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.tables import remove, save, shared_dir  # noqa: F401  for the operators

#: The white space that the contracts name: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()

#: log2 of the 64-bit words of a bit filter: 2^16 words are at most 1 MB when broadcast.
FILTER_WORDS_LOG2 = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



#: Rows and bytes of the slices in which whole texts are turned into Python objects.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20


#: Bytes of an Arrow batch at most where whole texts go through Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH_BYTES (or a single longer row).

    A task holds batches on their way to Python and back in the JVM and in the worker; with Spark's 64 MB
    executors of 3 GB came near their limit.  The setting is read when a plan runs, so it stays lowered in the
    session; results don't depend on it.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = conf.get(key)
    if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow over small batches, for columns of any names: they go by their places, since a name with a dot is no reference."""
    places = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(places.names)

    named = small_batches(df).toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.mapInArrow(placed, places).toDF(*schema.names)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes; Spark itself bounds the bytes of a batch.

    A slice holds one row at least, however long its texts are.
    """
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bit(h: Column, shift: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, shift).bitwiseAND(F.lit(63)).cast("int"))


def _mask(h: Column) -> Column:
    return _bit(h, 0).bitwiseOR(_bit(h, 6)).bitwiseOR(_bit(h, 12))


def _word(h: Column, log2: int) -> Column:
    return F.shiftrightunsigned(h, 64 - log2).cast("int")


def bit_filter(keys: DataFrame, h: Column, log2: int = FILTER_WORDS_LOG2) -> DataFrame:
    """A blocked Bloom filter over the 64-bit hashes h, as at most 2^log2 rows (word, bits).

    Its size does not grow with the keys, so that it may be broadcast; with many keys it only
    lets more rows pass.
    """
    return keys.groupBy(_word(h, log2).alias("word")).agg(F.bit_or(_mask(h)).alias("bits"))


def may_contain(df: DataFrame, h: Column, bits: DataFrame, log2: int = FILTER_WORDS_LOG2) -> DataFrame:
    """The rows of df whose hash h may be in the filter: all that are in it, and a few others."""
    word, mask = "__word", "__mask"
    probe = df.withColumns({word: _word(h, log2), mask: _mask(h)})
    fits = (F.col(word) == F.col("word")) & (F.col("bits").bitwiseAND(F.col(mask)) == F.col(mask))
    return probe.join(F.broadcast(bits), fits, "left_semi").drop(word, mask)
