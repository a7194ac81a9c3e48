"""Datasets that are promoted together: tables in folders of their own, and a pointer that names the current ones.

A root holds ``data/<dataset>/<folder>``, which never changes once written, and ``pointer/<generation>``, small files of
JSON of which the highest whole one counts.  A promotion writes the tables, checks them, and then creates the next
generation's file, which fails if another promotion has created it meanwhile: datasets switch together or not at
all, and readers that resolve the pointer once see one generation.  Creating a file exclusively is atomic on HDFS and the object stores
with conditional writes; on a local disk two processes may race.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from geolith.operators.release import state_digest
from geolith.operators.stored import recorded
from geolith.sources.staging import publish
from geolith.tables import remove


class Conflict(ValueError):
    """Another promotion came first, or the generation is not the expected one."""


class Refused(ValueError):
    """A check found faults; the pointer is as it was."""


class Generation(NamedTuple):
    """A state of all datasets: the folder, count and digest of each."""

    number: int
    datasets: dict[str, dict]


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def _body(generation: Generation) -> str:
    text = json.dumps(generation.datasets, sort_keys=True, separators=(",", ":"))
    return json.dumps({"datasets": generation.datasets, "sha256": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True)


def _read(spark: SparkSession, root: str, number: int) -> Generation | None:
    """A generation, or null if its file is not whole."""
    files, at = _files(spark, f"{root}/pointer/{number:012d}")
    stream = files.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        body = json.loads(text)
        generation = Generation(number, body["datasets"])
    except (ValueError, KeyError, TypeError):
        return None
    return generation if _body(generation) == text else None


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(x) for x in _names(spark, f"{root}/pointer") if x.isdigit()]


def resolve(spark: SparkSession, root: str) -> Generation:
    """The current generation; number 0 without datasets where nothing was promoted yet."""
    for number in reversed(_numbers(spark, root)):
        if found := _read(spark, root, number):
            return found
    return Generation(0, {})


def read(spark: SparkSession, root: str, generation: Generation | None = None) -> dict[str, DataFrame]:
    """The tables of one generation, the current one if none is given."""
    return {name: spark.read.parquet(f"{root}/data/{name}/{x['folder']}") for name, x in (generation or resolve(spark, root)).datasets.items()}


def _switch(spark: SparkSession, root: str, datasets: dict[str, dict], expected: int) -> Generation:
    """Compare and swap: the next generation, if the current one is still the expected one."""
    if (now := resolve(spark, root).number) != expected:
        raise Conflict(f"generation {now} is current, not {expected}")
    # A file of an interrupted run that isn't whole has a number too, which is not used again.
    generation = Generation(max([expected, *_numbers(spark, root)]) + 1, datasets)
    files, at = _files(spark, f"{root}/pointer/{generation.number:012d}")
    try:
        stream = files.create(at, False)
    except Py4JJavaError as error:
        raise Conflict(f"generation {generation.number} is there already") from error
    try:
        stream.write(bytearray(_body(generation).encode()))
    finally:
        stream.close()
    return generation


def promote(
    root: str, tables: dict[str, DataFrame], before: Callable[[dict[str, DataFrame]], DataFrame] | None = None, after: Callable[[dict[str, DataFrame]], DataFrame] | None = None, expected: int | None = None
) -> Generation:
    """Makes the tables current, with the other datasets as they are.

    before: faults of the tables that are about to be promoted (by dataset, all others included); after: faults of the
    tables as readers get them, which bring the generation before back.  Both give rows for faults.
    ``expected``: the generation that the tables were made from, the current one if not given.
    """
    spark = next(iter(tables.values())).sparkSession
    now = resolve(spark, root)
    if expected is not None and now.number != expected:
        raise Conflict(f"generation {now.number} is current, not {expected}")
    staged, datasets = [], dict(now.datasets)
    try:
        for name, df in tables.items():
            folder = uuid.uuid4().hex
            staged.append(f"{root}/data/{name}/{folder}")
            publish(df, staged[-1])
            digest = state_digest(spark.read.parquet(staged[-1]), sorted(df.columns)).first()
            datasets[name] = {"folder": folder, "n": digest["n"], "sha256": digest["sha256"]}
        fresh = Generation(now.number + 1, datasets)
        if before and (fault := before(read(spark, root, fresh)).first()):
            raise Refused(f"not promoted: {fault.asDict()}")
        made = _switch(spark, root, datasets, now.number)
    except Exception:
        remove(spark, *staged)
        raise
    if after and (fault := after(read(spark, root)).first()):
        _switch(spark, root, now.datasets, made.number)
        raise Refused(f"brought back: {fault.asDict()}")
    return made


def record(root: str, incoming: dict[str, tuple[DataFrame, list[str]]]) -> Generation:
    """Adds rows to datasets (table and key by name), all or none.

    A row whose key is there already must be the same in all columns, and a key must come once; else nothing is written.  The current
    generation stays where every row is there, so that recording again changes nothing, and all other datasets keep their tables and digests.
    """
    spark = next(iter(incoming.values()))[0].sparkSession
    now = resolve(spark, root)
    held, tables = read(spark, root, now), {}
    for name, (rows, key) in incoming.items():
        columns = [c for c in rows.columns if c not in key]
        there = held[name].select(*rows.columns) if name in held else rows.limit(0)
        outcomes = recorded(there, rows, key, columns)
        if fault := outcomes.where("outcome IN ('conflict', 'duplicate')").first():
            raise Refused(f"not recorded in {name}: {fault.asDict()}")
        fresh = rows.join(outcomes.where("outcome = 'insert'").select(*key).hint("merge"), key, "left_semi").select(*rows.columns)
        if name not in held or not fresh.isEmpty():
            tables[name] = there.unionByName(fresh)
    if not tables:
        return now
    made = promote(root, tables, expected=now.number)
    if changed := [n for n, x in now.datasets.items() if n not in tables and made.datasets.get(n) != x]:
        raise AssertionError(f"others changed: {changed}")
    return made


def rollback(spark: SparkSession, root: str, to: int, expected: int | None = None) -> Generation:
    """The datasets of an earlier generation as a new one; its tables must still have their digests."""
    found = _read(spark, root, to) if to in _numbers(spark, root) else None
    if found is None:
        raise ValueError(f"there is no generation {to}")
    if faults := stored_faults(spark, root, found):
        raise Refused(f"not rolled back: {faults}")
    return _switch(spark, root, found.datasets, resolve(spark, root).number if expected is None else expected)


def stored_faults(spark: SparkSession, root: str, generation: Generation | None = None) -> dict[str, str]:
    """Datasets of a generation whose tables are missing or have other rows than when they were promoted."""
    out = {}
    for name, x in (generation or resolve(spark, root)).datasets.items():
        path = f"{root}/data/{name}/{x['folder']}"
        files, at = _files(spark, path)
        if not files.exists(at):
            out[name] = "missing"
            continue
        df = spark.read.parquet(path)
        digest = state_digest(df, sorted(df.columns)).first()
        if (digest["n"], digest["sha256"]) != (x["n"], x["sha256"]):
            out[name] = "changed"
    return out


def recover(spark: SparkSession, root: str) -> list[str]:
    """After an interrupted promotion: removes tables that no generation names, and returns their paths.

    Not to be run while a promotion is under way.
    """
    used = {(name, x["folder"]) for number in _numbers(spark, root) if (g := _read(spark, root, number)) for name, x in g.datasets.items()}
    gone = [f"{root}/data/{name}/{folder}" for name in _names(spark, f"{root}/data") for folder in _names(spark, f"{root}/data/{name}") if (name, folder) not in used]
    remove(spark, *gone)
    return gone
