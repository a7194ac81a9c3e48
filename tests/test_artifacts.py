"""Promotions by a pointer, trees of digests, layouts, validators, lineage."""

import pytest
from pyspark.sql import functions as F

from geolith.operators import reconcile, validation
from geolith.operators.validation import Validator
from geolith.sources import layouts, pointer, tree


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_promotions_switch_together_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    a, b = spark.range(3).toDF("k"), spark.range(5).toDF("k")
    assert pointer.resolve(spark, root) == pointer.Generation(0, {})
    first = pointer.promote(root, {"a": a, "b": b})
    held = pointer.resolve(spark, root)
    assert held == first and {n: df.count() for n, df in pointer.read(spark, root).items()} == {"a": 3, "b": 5}
    second = pointer.promote(root, {"a": a.where("k > 0")}, expected=1)
    assert second.number == 2 and {n: df.count() for n, df in pointer.read(spark, root).items()} == {"a": 2, "b": 5}
    assert pointer.read(spark, root, held)["a"].count() == 3  # who resolved before goes on with what it resolved
    with pytest.raises(pointer.Conflict):
        pointer.promote(root, {"a": a}, expected=1)
    with pytest.raises(pointer.Refused):
        pointer.promote(root, {"a": a, "b": b.where("k = 9")}, before=lambda t: t["b"].agg(F.count("*").alias("n")).where("n = 0"))
    assert pointer.resolve(spark, root) == second
    with pytest.raises(pointer.Refused):
        pointer.promote(root, {"b": b.where("k = 9")}, after=lambda t: t["b"].agg(F.count("*").alias("n")).where("n = 0"))
    back = pointer.resolve(spark, root)
    assert back.number == 4 and back.datasets == second.datasets
    assert pointer.rollback(spark, root, 1).datasets == first.datasets
    with pytest.raises(ValueError, match="no generation"):
        pointer.rollback(spark, root, 77)


def test_two_promotions_at_once(spark, tmp_path):
    """The other one switches while this one checks."""
    root = f"file://{tmp_path}/root"
    df = spark.range(3).toDF("k")
    pointer.promote(root, {"a": df})

    def meanwhile(tables):
        pointer.promote(root, {"b": df})
        return df.limit(0)

    with pytest.raises(pointer.Conflict):
        pointer.promote(root, {"a": df.where("k = 0")}, before=meanwhile)
    assert {n: t.count() for n, t in pointer.read(spark, root).items()} == {"a": 3, "b": 3}


def test_interrupted_promotions(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    df = spark.range(3).toDF("k")
    first = pointer.promote(root, {"a": df})
    df.write.parquet(f"{root}/data/a/left-behind")
    (tmp_path / "root/pointer/000000000002").write_text('{"datasets":{"a":{"fol')  # cut off while it was written
    assert pointer.resolve(spark, root) == first
    assert [x.rsplit("/", 1)[1] for x in pointer.recover(spark, root)] == ["left-behind"]
    assert pointer.promote(root, {"b": df}, expected=1).number == 3
    assert pointer.stored_faults(spark, root) == {}
    spark.range(4).toDF("k").write.mode("overwrite").parquet(f"{root}/data/a/{first.datasets['a']['folder']}")
    assert pointer.stored_faults(spark, root) == {"a": "changed"}
    with pytest.raises(pointer.Refused):
        pointer.rollback(spark, root, 1)


def test_trees(spark, tmp_path):
    old = {"a/1": "one", "a/2": "two", "b/c/3": "three", "b/c/4": "four", "d": "five", "e/5": "same"}
    new = {"a/1": "two", "a/2": "one", "b/c/3": "THREE", "d": "five", "e/5": "same", "f/6": "more", "f/7": "more"}
    for name, files in (("old", old), ("new", new)):
        for path, text in files.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / path).write_text(text)
    a, b = (tree.tree(tree.files(spark, str(tmp_path / name))) for name in ("old", "new"))
    assert rows(tree.differences(a, b, 3)) == sorted([("a/1", "swapped"), ("a/2", "swapped"), ("b/c/3", "altered"), ("b/c/4", "missing"), ("f", "added")], key=repr)
    assert tree.differences(a, a, 3).count() == 0
    given = tree.tree(tree.of_contents(spark.createDataFrame(list(old.items()), "path string, content string")))
    assert rows(a, "path", "kind", "length", "sha256") == rows(given, "path", "kind", "length", "sha256")
    assert rows(a.where("kind = 'folder'"), "path", "length") == sorted([("", 23), ("a", 6), ("b", 9), ("b/c", 9), ("e", 4)], key=repr)
    assert rows(tree.differences(tree.tree(tree.of_contents(spark.createDataFrame([("x", "1")], "path string, content string"))), tree.tree(tree.of_contents(spark.createDataFrame([("x/y", "1")], "path string, content string"))), 2)) == [("x", "altered")]


def test_layouts(spark):
    chunks = spark.createDataFrame([(i % 3, i, bytes([i]) * (i % 7)) for i in range(60)], "level int, chunk long, payload binary")
    segments, index = layouts.flat(chunks, 20)
    assert segments.count() > 5 and layouts.index_faults(index, sum(i % 7 for i in range(60))).count() == 0
    whole = b"".join(bytes(r.bytes) for r in segments.orderBy("segment").collect())
    ordered = sorted((r.level, r.chunk, bytes(r.payload)) for r in chunks.collect())
    assert whole == b"".join(x[2] for x in ordered)
    assert sorted((r.level, r.chunk, bytes(r.payload), r.fault) for r in layouts.read_flat(segments, index).collect()) == [(*x, None) for x in ordered]
    bad = index.withColumn("offset", F.when(F.col("chunk") == 5, F.col("offset") + 1000).when(F.col("chunk") == 6, F.col("offset") + 1).otherwise(F.col("offset")))
    assert {r.chunk: r.fault for r in layouts.read_flat(segments, bad).where("fault IS NOT NULL").collect()} == {5: "range", 6: "sha256"}


def test_validators(spark):
    df = spark.range(10)
    chain = [Validator("a", "t", {"x": "id = 3"}), Validator("b", "t", {"x": "id > 7"}, ("a",)), Validator("c", "t", {"x": "id > 100"}, ("b",)), Validator("d", "u", {"x": "id = 0"}), Validator("e", "u", {"x": "id < 0"}, ("d",))]
    states, faults = validation.validate({"t": (df, "id"), "u": (df.where("id > 0"), "id")}, chain)
    assert rows(states) == sorted([("a", "failed", 1, None), ("b", "skipped", 0, "a"), ("c", "skipped", 0, "a"), ("d", "passed", 0, None), ("e", "passed", 0, None)], key=repr)
    assert rows(faults) == [("a", "x", "3")]
    for wrong in ([Validator("a", "t", {}, ("b",))], [Validator("a", "t", {}, ("a",))], [Validator("a", "t", {}), Validator("a", "t", {})]):
        with pytest.raises(ValueError, match="valid|itself|one name"):
            validation.ancestors(wrong)


def test_lineage_of_long_chains(spark):
    chain = [(r, f"k{r // 3}", None if r == 0 else f"k{(r - 1) // 3}") for r in range(40)]
    odd = [(5, "lost", "nobody"), (6, "after", "lost"), (0, "alone", None), (7, "two", "after"), (7, "three", "after")]
    df = spark.createDataFrame(chain + odd, "release long, source_feature_id string, previous_id string")
    got = {(r.release, r.source_feature_id): (r.origin_release, r.origin_id, r.steps) for r in reconcile.lineage(df).collect()}
    assert all(got[r, f"k{r // 3}"] == (0, "k0", r) for r in range(40))
    assert got[5, "lost"] == (5, "lost", 0) and got[6, "after"] == (5, "lost", 1) and got[7, "three"] == (5, "lost", 2) and got[0, "alone"] == (0, "alone", 0)
    assert reconcile.lineage(df.limit(0)).count() == 0
