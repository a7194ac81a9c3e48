"""Trees of digests over the files of an artifact, compared from the root down.

A node is a file or a folder: path, parent, depth, length and sha256; a folder's digest is that of its children's names, kinds
and digests, put together by their first hexadecimal digits, so that a folder of any size is no one task's.  Two artifacts with one root digest are equal; where folders differ, only their children are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.tables import save


def files(spark: SparkSession, path: str) -> DataFrame:
    """path (below the artifact's folder), length and sha256 of every file; files are read and digested in the executors.

    A file is one row while it is read, so that it must be smaller than 2 GB.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    below = F.expr("substring(path, locate('" + base.replace("'", "\\'") + f"', path) + {len(base)})")
    return rows.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def of_contents(rows: DataFrame, *others: str) -> DataFrame:
    """The other columns, path, length and sha256 of files given as rows (path, content); a null content is an empty file."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return rows.select(*others, "path", F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("sha256"))


def tree(leaves: DataFrame, depth: int | None = None) -> DataFrame:
    """The nodes (path, parent, depth, kind, length, sha256) over files with path, length and sha256; the root's path is ''.

    Folders are digested from the deepest level up, each level in one grouping; ``depth`` is the files' greatest, counted if not given.
    """
    parts = F.split("path", "/")
    up = lambda path: F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    level = leaves.select("path", up(F.col("path")).alias("parent"), F.size(parts).alias("depth"), F.lit("file").alias("kind"), "length", "sha256")
    level, _ = save(level, "leaves")
    deepest = depth or level.agg(F.max("depth")).first()[0] or 0
    out, folders = level, None
    for d in range(deepest, 0, -1):
        own = level.where(F.col("depth") == d)
        own = own if folders is None else own.unionByName(folders)
        name = F.element_at(F.split("path", "/"), -1)
        child = F.concat_ws(":", F.char_length(name).cast("string"), name, F.substring("kind", 1, 2), "sha256")
        listed = F.sha2(F.array_join(F.sort_array(F.collect_list("child")), ","), 256)
        shares = own.select("parent", "length", child.alias("child")).groupBy("parent", F.substring(F.sha2("child", 256), 1, 4).alias("share"))
        shares = shares.agg(F.sum("length").alias("length"), listed.alias("child"))
        made = shares.groupBy("parent").agg(F.sum("length").alias("length"), listed.alias("sha256"))
        made = made.select(F.col("parent").alias("path"), F.when(F.col("parent") == "", F.lit(None)).otherwise(up(F.col("parent"))).alias("parent"), F.lit(d - 1).alias("depth"), F.lit("folder").alias("kind"), "length", "sha256")
        folders, _ = save(made, "folders")
        out = out.unionByName(folders)
    return out


def differences(stored: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """path and fault of each file or folder at which two trees differ: added, missing, altered, or swapped with another one.

    Level by level, children are joined only below folders that both trees have and that differ; below one that is added or missing
    nothing is named.  Of the files that differ, two that have each other's digest are swapped.
    """
    columns = ["path", "parent", "kind", "sha256"]
    a, b = (t.select("depth", *columns) for t in (stored, found))
    open_ = stored.sparkSession.createDataFrame([(None,)], "parent string")
    out = None
    for d in range(depth + 1):
        x, y = (t.where(F.col("depth") == d).drop("depth").join(open_.withColumnRenamed("parent", "__p"), F.col("parent").eqNullSafe(F.col("__p")), "left_semi") for t in (a, b))
        j = x.select("path", F.struct("kind", "sha256").alias("x")).join(y.select("path", F.struct("kind", "sha256").alias("y")), "path", "full_outer").where("NOT (x <=> y)")
        j, _ = save(j, "differing")
        both = (F.col("x.kind") == "folder") & (F.col("y.kind") == "folder")
        fault = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "missing").otherwise("altered")
        named = j.where(~F.coalesce(both, F.lit(False))).select("path", fault.alias("fault"), F.col("x.sha256").alias("before"), F.col("y.sha256").alias("after"))
        out = named if out is None else out.unionByName(named)
        open_ = j.where(both).select(F.col("path").alias("parent"))
    changed = out.where("fault = 'altered'")
    other = changed.select(F.col("before").alias("__b"), F.col("after").alias("__a")).distinct()
    swapped = changed.join(other, (F.col("before") == F.col("__a")) & (F.col("after") == F.col("__b")), "left_semi").select("path", F.lit(True).alias("__swapped"))
    return out.join(swapped, "path", "left").select("path", F.when(F.col("__swapped"), "swapped").otherwise(F.col("fault")).alias("fault"))
