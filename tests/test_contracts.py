"""Contracts of sources and stored rows on odd rows."""

from pyspark.sql import functions as F

from geolith.functions import checks
from geolith.operators import diff, promotion, release, stored
from geolith.plans import shapes
from geolith.sources import staging


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_whole_matches_and_white_space(spark):
    df = spark.createDataFrame([("a-b",), ("a-b\n",), ("\na-b",), ("a--b",), ("",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(checks.matches("t", checks.SLUG)).collect()] == [True, False, False, False, False, False]
    df = spark.createDataFrame([("\t",), (" 　",), (" x\n",), ("\x1fx",), ("",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(checks.is_identity("t")).collect()] == [False, False, True, True, False, False]
    assert [r[0] for r in df.select(checks.text_fault("t")).collect()] == ["blank", "blank", "untrimmed", "untrimmed", "blank", "null"]
    assert [r[0] for r in spark.createDataFrame([("7\n",), (" 7",), ("7 7",)], "t string").coalesce(1).select(checks.object_id("t")).collect()] == [7, 7, None]


def test_digests_tell_values_apart(spark):
    one = lambda a, b: release.state_digest(spark.createDataFrame([(a, b)], "a string, b string"), ["a", "b"]).first().sha256
    assert len({one("a|=b", "c"), one("a", "b|=c"), one("a|1:b", "c"), one(None, "-"), one("-", None), one("", None), one(None, "")}) == 7
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x")], "g int, v string")
    by = {r.g: (r.n, r.sha256) for r in release.state_digest(df, ["v"], ["g"]).collect()}
    assert by[2] == by[None] and by[1][0] == 2
    assert tuple(release.state_digest(df.where("g = 1"), ["v"]).first()) == by[1]


def test_an_earlier_supersession_stays(spark):
    held = spark.createDataFrame([("d", 1, "superseded", 2), ("d", 2, "accepted", None), ("d", 3, "candidate", None), ("e", 1, "accepted", None)], "dataset string, version long, lifecycle string, superseded_by long")
    plan = release.transition(held, "dataset", "version")
    after = promotion.activated(held, plan, "dataset", "version")
    assert rows(after, "dataset", "version", "lifecycle", "superseded_by") == [("d", 1, "superseded", 2), ("d", 2, "superseded", 3), ("d", 3, "accepted", None), ("e", 1, "accepted", None)]
    assert promotion.state_faults(after, plan, "dataset", "version").count() == 0
    dated = after.withColumn("accepted_at", F.when(F.col("lifecycle").isin("accepted", "superseded"), "then"))
    assert stored.broken(dated, ["dataset", "version"], stored.RELEASE_RULES).count() == 0
    assert rows(promotion.restored(after, plan, "dataset", "version"), *held.columns) == rows(held)
    wrong = after.withColumn("superseded_by", F.when(F.col("version") == 2, 9).otherwise(F.col("superseded_by")))
    assert rows(promotion.state_faults(wrong, plan, "dataset", "version"), "version", "rule") == [(2, "superseded_by")]


def test_manifests_see_contents(spark):
    df = spark.createDataFrame([(1, "k", "g")], "level int, id string, geometry_sha256 string")
    one, two = (staging.manifest({"r": x}) for x in (df, df.withColumn("geometry_sha256", F.lit("h"))))
    assert rows(staging.manifest_faults(one, two)) == [("r", "changed")]


def test_schemas(spark):
    a, b = spark.createDataFrame([], "x int, y string"), spark.createDataFrame([], "x long, z string")
    found = rows(release.schema_rows({"a": a, "b": b, "more": a}, {"a": a.schema, "b": a.schema, "gone": a.schema}))
    assert found == sorted([("b", "missing y"), ("b", "extra z"), ("b", "x is bigint, not int"), ("more", "unexpected table"), ("gone", "missing table")], key=repr)
    assert release.schema_rows({"a": a.select("y", "x")}, {"a": a.schema}).first().fault == "order of columns"


def test_inventories_with_nulls(spark):
    pages = spark.createDataFrame([(1, "3", "OID"), (1, "3", "OID"), (1, " 4", "OID"), (1, None, "OID"), (1, "x", "OID"), (1, "05", "OID"), (2, "9", None)], "page int, value string, field string")
    ids, wrong = diff.object_ids(pages, "page", "value", "OID", "field")
    assert rows(ids) == [(1, 3), (1, 4), (2, 9)]
    assert rows(wrong) == sorted([(1, "3", "repeated"), (1, None, "number"), (1, "x", "number"), (1, "05", "number"), (2, "9", "field")], key=repr)


def test_integrity_of_sound_and_empty_rows(spark):
    sound = shapes._stored(spark, "/root/testdata/sf0.001").where(" AND ".join(f"id % {n} <> 0" for n in (17, 19, 23, 29, 31, 37, 41, 43, 47, 53)))
    assert sound.count() > 50 and stored.integrity(sound, "water", "FPId").count() == 0
    assert {r.rule for r in stored.integrity(sound, "buildings", "FPId").collect()} == {"layer_type"}
    nulls = sound.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in sound.schema.fields])
    assert {r.rule for r in stored.integrity(nulls, "water", "FPId").collect()} == {"geometry", "attributes", "source_ordinal", "blank"}
    assert stored.integrity(sound.limit(0), "water", "FPId").count() == 0
