"""Joins of boxes of all sizes against brute force, and how a hot cell is divided."""

import random
import re

from pyspark.sql import functions as F

from geolith.functions.spatial import intersects
from geolith.operators import graph, spatial_join
from geolith.plans import maps

SCHEMA = "id long, min_x double, min_y double, max_x double, max_y double"


def boxes(rng, n, first=0):
    out = []
    for i in range(n):
        size = rng.choice([0.0, 1e-5, 1e-3, 0.01, 0.3, 5.0, 80.0, 360.0])
        x, y = rng.choice([(-88.3, 41.9), (10.0, 10.0), (rng.uniform(-180, 180), rng.uniform(-90, 90))])
        x, y = x + rng.uniform(-1, 1) * size, y + rng.uniform(-1, 1) * size
        out.append((first + i, x, y, x + size * rng.choice([1, 0.5]), y + size * rng.choice([1, 0.1])))
    return out


def brute(left, right, closed=False):
    if closed:
        return sorted((a[0], b[0]) for a in left for b in right if not (a[3] < b[1] or b[3] < a[1] or a[4] < b[2] or b[4] < a[2]))
    return sorted((a[0], b[0]) for a in left for b in right if min(a[3], b[3]) > max(a[1], b[1]) and min(a[4], b[4]) > max(a[2], b[2]))


def pairs(df):
    return sorted((r.a_key, r.b_key) for r in df.collect())


def test_boxes_of_all_sizes(spark, monkeypatch):
    rng = random.Random(8)
    left, right = boxes(rng, 250), boxes(rng, 250, 1000)
    left += [(900, -1.0, -1.0, 0.0, 0.0), (901, 0.0, 0.0, 1.0, 1.0), (902, 0.25, 0.25, 0.25, 0.25)]
    right += [(1900, 0.0, 0.0, 1.0, 1.0), (1901, 0.25, 0.25, 0.25, 0.25)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for block in (spatial_join.BLOCK, 7):
        monkeypatch.setattr(spatial_join, "BLOCK", block)
        assert pairs(spatial_join.overlap_pairs(a, b, "id", "id")) == brute(left, right)
        assert pairs(spatial_join.overlap_pairs(a, b, "id", "id", test=intersects)) == brute(left, right, closed=True)
    odd = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0), (2, float("nan"), 0.0, 1.0, 1.0), (3, 2.0, 0.0, 1.0, 1.0)], SCHEMA)
    assert spatial_join.overlap_pairs(odd, b, "id", "id").count() == 0 == spatial_join.overlap_pairs(b, odd, "id", "id").count()
    assert spatial_join.overlap_pairs(a.limit(0), b, "id", "id").count() == 0


def test_a_broad_box_and_a_hot_cell(spark, monkeypatch):
    """One box over everything, and a third of all boxes in one place: no group has more than BLOCK boxes of a side."""
    monkeypatch.setattr(spatial_join, "BLOCK", 50)
    rng = random.Random(4)
    left = [(i, x := rng.uniform(-80, 80), y := rng.uniform(-80, 80), x + 0.001, y + 0.001) for i in range(600)] + [(600, -180.0, -90.0, 180.0, 90.0)]
    right = [(i, 10.0 + i * 1e-7, 10.0, 10.0 + i * 1e-7 + 0.001, 10.001) for i in range(1000, 1300)] + [(i, x := rng.uniform(-80, 80), y := rng.uniform(-80, 80), x + 0.001, y + 0.001) for i in range(2000, 2600)]
    left += [(700 + i, 10.0, 10.0, 10.0005, 10.0005) for i in range(120)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    placed = [spatial_join._placed(x, tuple(F.col(c) for c in spatial_join.BOUNDS)) for x in (a, b)]
    for owners, visitors in (placed, placed[::-1]):
        for side in spatial_join._sides(owners, visitors, deeper=False):
            assert side.groupBy(*spatial_join.CELL_KEY, "__b0", "__b1").count().agg(F.max("count")).first()[0] < 2 * 50
    assert pairs(spatial_join.overlap_pairs(a, b, "id", "id")) == brute(left, right)


def test_points_in_boxes(spark):
    rng = random.Random(2)
    feats = boxes(rng, 200)
    points = [(i, rng.choice([-88.3, 10.0, rng.uniform(-180, 180)]), rng.choice([41.9, 10.0, rng.uniform(-90, 90)])) for i in range(200)] + [(999, None, 1.0)]
    got = spatial_join.hit_test(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(feats, SCHEMA), "p", "id")
    want = sorted((p, f[0]) for p, x, y in points if x is not None for f in feats if f[1] <= x <= f[3] and f[2] <= y <= f[4])
    assert sorted((r.p, r.id) for r in got.collect()) == want


def test_equal_boxes_are_one_node(spark, monkeypatch):
    """Copies of boxes make no edges of their own; a key of two boxes connects what both overlap."""
    edges = []
    saved = graph.save
    monkeypatch.setattr(graph, "save", lambda df, tag, **options: (edges.append(df.count()) if tag == "edges" else None, saved(df, tag, **options))[1])
    left = [(i, float(i % 3), 0.0, i % 3 + 0.5, 1.0) for i in range(120)] + [(500, 50.0, 0.0, 51.0, 1.0), (500, 60.0, 0.0, 61.0, 1.0), (501, 60.0, 0.0, 61.0, 1.0)]
    right = [(i, float(i % 3), 0.5, i % 3 + 0.5, 2.0) for i in range(90)] + [(700, 50.5, 0.0, 52.0, 1.0), (701, 60.5, 0.0, 62.0, 1.0), (702, 90.0, 0.0, 91.0, 1.0)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    d = spatial_join.overlap_components(a, b, "id", "id")
    assert max(edges) < 10
    want = spatial_join.components(spark.createDataFrame(brute(left, right), "a_key long, b_key long"))
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, want.collect()))
    assert {r.node for r in d.where("component = 'a:500'").collect()} == {"a:500", "a:501", "b:700", "b:701"}


def test_registered_components_have_no_pairs_of_copies(spark, monkeypatch, tmp_path):
    edges = []
    saved = graph.save
    monkeypatch.setattr(graph, "save", lambda df, tag, **options: (edges.append(df.count()) if tag == "edges" else None, saved(df, tag, **options))[1])
    spark.range(200).selectExpr("id * 920 AS p_partkey", "7 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    assert maps.component_kinds(spark, str(tmp_path)).count() == 1
    assert edges[0] == 1


def test_copies_in_slices(spark, monkeypatch):
    """More copies of a box or of a point than go together; keys may be null."""
    monkeypatch.setattr(spatial_join, "COPIES", 4)
    left = [(i, 0.0, 0.0, 1.0, 1.0) for i in range(50)] + [(None, 0.0, 0.0, 1.0, 1.0), (90, 5.0, 5.0, 6.0, 6.0), (90, 5.0, 5.0, 6.0, 6.0)]
    right = [(i, 0.5, 0.5, 1.5, 1.5) for i in range(40)] + [(95, 5.5, 5.5, 7.0, 7.0)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = [(r.a_key, r.b_key) for r in spatial_join.overlap_pairs(a, b, "id", "id").collect()]
    assert sorted(got, key=repr) == sorted([(x[0], y[0]) for x in left for y in right if (x[1] == 5.0) == (y[0] == 95)], key=repr)
    points = spark.createDataFrame([(i, 0.25, 0.25) for i in range(30)] + [(77, 0.25, 0.75)], "p long, x double, y double")
    shown = a.select("id", *spatial_join.BOUNDS).withColumn("slope", F.lit(1.0))
    got = [(r.p, r.id) for r in spatial_join.hit_test(points, shown, "p", "id", F.expr("y <= x * slope")).collect()]
    assert sorted(got, key=repr) == sorted([(i, k) for i in range(30) for k in [*range(50), None]], key=repr)


def test_no_side_is_broadcast(spark):
    """The size of a file of parts says little about that of its boxes in their cells."""
    d = "/root/testdata/sf0.001"
    plan = maps.overlap_pairs(spark, d)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "__obox" not in "".join(x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    sides = [x for x in plan.splitlines() if "Join" in x and "__gx" in x and "__b0" in x]
    assert sides and all("SortMergeJoin" in x for x in sides)


def test_pairs_of_copies_are_spread(spark, monkeypatch):
    """Few boxes of many keys in one cell: no task has most of their pairs."""
    monkeypatch.setattr(spatial_join, "KEYS", 50, raising=False)
    left = [(20 * i + k, i * 1e-5, 0.0, i * 1e-5 + 0.01, 0.01) for i in range(20) for k in range(20)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame([(1000 + x[0], *x[1:]) for x in left], SCHEMA)
    found = spatial_join.overlap_pairs(a, b, "id", "id").withColumn("part", F.spark_partition_id())
    rows = found.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("a_key", "b_key").alias("different")).collect()
    assert sum(r.n for r in rows) == sum(r.different for r in rows) == 400 * 400
    assert max(r.n for r in rows) < 400 * 400 / 2


def test_keys_are_paired_apart_from_the_join(spark):
    """Fused with a merge join, the pairs of a row with all its matches would be in memory before the first is given."""
    rows = spark.createDataFrame([(i, i % 3 * 0.1, 0.0, i % 3 * 0.1 + 0.5, 1.0) for i in range(30)], SCHEMA)
    points = rows.selectExpr("id AS p", "min_x AS x", "min_y AS y")
    for df, n in ((spatial_join.overlap_pairs(rows, rows, "id", "id"), 900), (spatial_join.hit_test(points, rows, "p", "id"), 600)):
        assert len(df.collect()) == n
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        of = {kind: set(re.findall(rf"\*\((\d+)\) {kind}", final)) for kind in ("SortMergeJoin", "Generate explode\\(__")}
        assert all(of.values()) and not set.intersection(*of.values())
