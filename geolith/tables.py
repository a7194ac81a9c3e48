"""Tables in the folder that a cluster shares: written once, read back with a short lineage, removed after use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster without it is an
    error, since a machine-local folder would lose files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="geolith-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths of the tables that were written in each open scratch().
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that operators saved inside.

    Operators return plans over tables of theirs, so results are to be written or collected inside.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        remove(spark, *_OPEN.pop())


def save(df: DataFrame, tag: str, scratch: bool = True, **options: object) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and returns the table read back, and its path.

    This cuts the lineage: an executor that is lost later costs no recomputation of what lies before.
    With scratch=False the table outlives an open scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geolith-{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    if _OPEN and scratch:
        _OPEN[-1].append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables in the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a table; False if the target is there already."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not files.exists(b) and files.rename(a, b)
