"""Published tables, snapshots, manifests and scans of stored releases."""

import pytest
from pyspark.sql import functions as F

from geolith.operators import stored
from geolith.sources import staging
from geolith.tables import save, scratch


def test_publish_reuses_equal_and_refuses_other_rows(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    path = f"file://{tmp_path}/table"
    assert staging.publish(df, path) == "written"
    assert staging.publish(df.orderBy(F.desc("id")), path) == "reused"
    with pytest.raises(ValueError):
        staging.publish(df.where("id < 99"), path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]
    assert spark.read.parquet(path).count() == 100


def test_publish_all_is_all_or_nothing(spark, tmp_path):
    tables = {"lakes": spark.range(3), "rivers": spark.range(5)}
    path = f"file://{tmp_path}/water"
    assert staging.publish_all(tables, path) == "written"
    with pytest.raises(ValueError):
        staging.publish_all({"lakes": spark.range(4)}, path)
    assert [p.name for p in tmp_path.iterdir()] == ["water"] and spark.read.parquet(f"{path}/rivers").count() == 5


def test_swap_and_recover(spark, tmp_path):
    path = f"file://{tmp_path}/package"
    staging.swap(spark.range(3), path)
    staging.swap(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir()] == ["package"]
    (tmp_path / "package").rename(tmp_path / "package.previous")  # a swap that was cut off
    assert staging.recover(spark, path) == "restored" and spark.read.parquet(path).count() == 7
    assert staging.recover(spark, path) == "nothing"


def test_manifest_faults(spark):
    rows = {"a": spark.range(3).withColumn("level", F.lit(1)), "b": spark.range(4).withColumn("level", F.lit(0))}
    stored_rows = staging.manifest(rows)
    assert staging.manifest_faults(stored_rows, staging.manifest(rows)).count() == 0
    other = {"a": rows["a"].where("id < 2"), "c": rows["b"]}
    found = {r.role: r.fault for r in staging.manifest_faults(stored_rows, staging.manifest(other)).collect()}
    assert found == {"a": "changed", "b": "missing", "c": "unknown"}
    one, two = (staging.package_identity(staging.manifest(x)).first()[0] for x in (rows, other))
    assert one != two and len(one) == 64


def test_snapshot_reads_back_without_faults(spark):
    current = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k3", "x")], "key string, classification string")
    records, header = staging.snapshot(current, spark.createDataFrame([("k1",), ("k2",), ("k9",)], "key string"), "key", ["x", "y"])
    row = header.first()
    assert (row["count"], row["counts"], row["not_rendered"], row["render_count"]) == (2, "x=1,y=1", 1, 3)
    assert staging.snapshot_faults(records, header, "key", ["x", "y"]).count() == 0
    wrong = records.unionByName(records.limit(1).withColumn("key", F.lit(None).cast("string")))
    assert {r.rule for r in staging.snapshot_faults(wrong, header, "key", ["x", "y"]).collect()} == {"null_key", "count", "records_sha256"}


def test_accepted_release_of_empty_and_several(spark):
    df = spark.createDataFrame([("d", 1, "accepted"), ("d", 2, "accepted"), ("e", 3, "accepted"), ("f", 4, "candidate")], "dataset string, release long, lifecycle string")
    got = {r.dataset: (r.release, r.fault) for r in stored.accepted_release(df, "dataset", "release").collect()}
    assert got == {"d": (None, "several"), "e": (3, None), "f": (None, "none")}
    assert stored.accepted_release(df.limit(0), "dataset", "release").count() == 0


def test_scratch_removes_what_was_saved(spark):
    with scratch(spark):
        kept, kept_path = save(spark.range(3), "kept", scratch=False)
        _, path = save(kept, "gone")
        assert staging.exists(spark, path)
    assert not staging.exists(spark, path) and kept.count() == 3
