"""Small cases with known results for the operators on releases, the log and boxes."""

import math

import pytest
from pyspark.sql import functions as F

from geolith.functions import checks, geometry, spatial
from geolith.operators import diff, history, levels, reconcile, release, spatial_join
from geolith.plans import frames, maps, registry  # noqa: F401
from geolith.sources import container, geojson

RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_diff_has_six_categories(spark):
    a = spark.createDataFrame([("a", "g1", "a1"), ("b", "g2", "a2"), ("c", "g3", "a3"), ("d", "g4", "a4"), ("e", "g5", "a5")], "id string, geometry_sha256 string, attributes_sha256 string")
    b = spark.createDataFrame([("a", "g1", "a1"), ("b", "x", "a2"), ("c", "g3", "x"), ("d", "x", "x"), ("f", "g6", "a6")], a.schema)
    want = [("a", "unchanged"), ("b", "geometry_changed"), ("c", "attributes_changed"), ("d", "both_changed"), ("e", "removed"), ("f", "added")]
    assert rows(diff.feature_diff(a, b, "id"), "id", "category") == want


def test_fold_with_undo_and_no_op(spark):
    acts = ["a", "a", "b", "undo", "undo", "c"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(acts)] + [(2, 0, "undo")], "k long, at long, action string")
    assert rows(history.fold(df, "k", "at"), "k", "current", "changes") == [(1, "c", 5), (2, "unclassified", 0)]
    log = history.events_of(df, "k", "at")
    assert [r[0] for r in log.orderBy("at").select("event_kind").collect()] == ["classification", "correction", "undo", "undo", "correction"]
    assert history.chain_audit(log, "k", "at").count() == 0


def test_replay_keeps_the_first_and_reports_conflicts(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("m", 3, "a"), ("m", 4, "b")], "event string, at long, action string")
    assert rows(history.replay(df, "event", "at", ["action"]), "event", "at", "replays", "conflict") == [("k", 1, 1, False), ("m", 3, 1, True)]


def box(key, x0, x1, y0=41.90, y1=41.91):
    return key, key, x0, y0, x1, y1


def test_reconciliation_cases(spark):
    schema = "source_feature_id string, geometry_sha256 string, min_x double, min_y double, max_x double, max_y double"
    old = spark.createDataFrame([("kept", "g", -88.5, 41.9, -88.49, 41.91), ("renamed-a", "same", -88.3, 41.9, -88.29, 41.91), ("gone", "q", -88.1, 41.9, -88.09, 41.91), ("one", "r", -87.5, 41.9, -87.48, 41.91)], schema)
    new = spark.createDataFrame([("kept", "h", -88.5, 41.9, -88.49, 41.91), ("renamed-b", "same", -88.3, 41.9, -88.29, 41.91), ("fresh", "s", -87.9, 41.9, -87.89, 41.91), ("left", "t", -87.5, 41.9, -87.49, 41.91), ("right", "u", -87.488, 41.9, -87.48, 41.91)], schema)
    parts = reconcile.plan(old, new)
    want = [("addition", 1), ("continuation", 1), ("disappearance", 1), ("exact_geometry_replacement", 1), ("split", 1)]
    assert rows(reconcile.summary(parts), "kind", "n") == want
    mappings = spark.createDataFrame([("p1", "kept", "initial", "r1"), ("p2", "renamed-a", "initial", "r1")], "project_key string, source_feature_id string, relationship string, release string")
    got = rows(reconcile.applied(mappings, parts, "r2").where("release = 'r2'"), "source_feature_id", "relationship")
    assert got == [("fresh", "initial"), ("kept", "continuation"), ("renamed-b", "exact_geometry_replacement")]


def test_reconciliation_of_long_keys(spark):
    schema = "source_feature_id string, geometry_sha256 string, min_x double, min_y double, max_x double, max_y double"
    stem = "k" * 120
    old = spark.createDataFrame([(stem + "a", "r", -87.5, 41.9, -87.48, 41.91)], schema)
    new = spark.createDataFrame([(stem + "b", "t", -87.5, 41.9, -87.49, 41.91), (stem + "c", "u", -87.488, 41.9, -87.48, 41.91)], schema)
    got = rows(reconcile.summary(reconcile.plan(old, new)), "kind", "n")
    assert got == [("addition", 0), ("disappearance", 0), ("exact_geometry_replacement", 0), ("split", 1)]


def test_broad_features_meet_too(spark):
    schema = "id string, min_x double, min_y double, max_x double, max_y double"
    wide = spark.createDataFrame([("w", -180.0, -90.0, 180.0, 90.0), ("touch", 0.0, 0.0, 0.005, 0.005)], schema)
    small = spark.createDataFrame([("s", 10.0, 10.0, 10.001, 10.001), ("edge", 0.005, 0.0, 0.01, 0.005)], schema)
    assert rows(spatial_join.overlap_pairs(wide, small, "id", "id"), "a_key", "b_key") == [("w", "edge"), ("w", "s")]
    assert ("touch", "edge") in rows(spatial_join.overlap_pairs(wide, small, "id", "id", test=spatial.intersects), "a_key", "b_key")


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)], "a_key long, b_key long")
    assert spatial_join.components(pairs, side=False).select("component").distinct().count() == 1


@pytest.mark.parametrize("name", ["overlap_components", "component_kinds"])
def test_components_of_all_rows(spark, name):
    d = "/root/testdata/sf0.001"
    a, b = ([(f"{side}:{r.id}", r) for r in frame(spark, d).collect()] for side, frame in (("a", frames.accepted), ("b", frames.candidate)))
    of = {}
    for u, x in a:
        for v, y in b:
            if min(x.max_x, y.max_x) > max(x.min_x, y.min_x) and min(x.max_y, y.max_y) > max(x.min_y, y.min_y):
                mine, other = (of.get(k, {k}) for k in (u, v))
                mine |= other
                of |= dict.fromkeys(mine, mine)
    want = {n: min(m) for n, m in of.items()}
    got = registry.QUERIES[name](spark, d).collect()
    if name == "overlap_components":
        assert len(got) == len(want) > 200 and {r.node: r.component for r in got} == want
        return
    sides = {c: [sum(n[0] == side and m == c for n, m in want.items()) for side in "ab"] for c in set(want.values())}
    assert {r.component: [r.n_old, r.n_new] for r in got} == sides
    kinds = {(True, True): "uncertain_replacement", (True, False): "split", (False, True): "merge", (False, False): "complex"}
    assert all(r.kind == kinds[r.n_old == 1, r.n_new == 1] for r in got)


def test_top_fraction_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(1, 50), (2, 30), (3, 20)], "id long, score long")
    assert rows(levels.top_fraction(df, "score", "id", 1, 2), "id") == [(1,)]
    assert rows(levels.top_fraction(df, "score", "id", 51, 100), "id") == [(1,), (2,)]
    assert levels.top_fraction(df.limit(0), "score", "id", 1, 2).count() == 0


def test_transition_and_rollback(spark):
    df = spark.createDataFrame([("d", 1, "accepted"), ("d", 2, "candidate"), ("e", 1, "accepted")], "dataset string, version long, lifecycle string")
    plan = release.transition(df, "dataset", "version")
    assert rows(plan, "dataset", "version", "after") == [("d", 1, "superseded"), ("d", 2, "accepted"), ("e", 1, "accepted")]
    assert rows(release.rolled_back(plan, "dataset", "version"), "dataset", "version", "lifecycle") == rows(df, "dataset", "version", "lifecycle")


def test_containment(spark):
    points = [(0.0, 1.0, True), (1.0, 1.5, False), (5.0, 1.0, False), (0.5, 0.5, True)]  # on the boundary, on the hole's, outside, inside
    parts = [[[{"x": x, "y": y} for x, y in ring] for ring in (RING, HOLE)]]
    df = spark.createDataFrame([(x, y, parts, want) for x, y, want in points] + [(0.0, 1.0, None, False), (0.0, 1.0, [[]], False)], "x double, y double, parts array<array<array<struct<x: double, y: double>>>>, want boolean")
    assert df.where(geometry.contains("x", "y", "parts") != F.col("want")).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([([[[(0.0, 0.0), (3e-7, 4e-7)]]],)], f"parts {geometry.PARTS.simpleString()}")
    assert df.select(geometry.length_score("parts")).first()[0] == 5
    assert df.select(geometry.area_score("parts")).first()[0] == 1


def test_morton_bounds(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (9.0, 0.0)], "x double, y double")
    got = df.select(spatial.quantize("x", F.lit(0.0), F.lit(1.0)).alias("q"), spatial.quantize("y", F.lit(1.0), F.lit(1.0)).alias("z")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (65535, 0), (65535, 0)]
    assert spark.range(1).select(spatial.morton(F.lit(3), F.lit(1))).first()[0] == 0b111


def test_checks(spark):
    df = spark.createDataFrame([("2024-02-29T00:00:00.000Z",), ("2023-02-29T00:00:00.000Z",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(checks.is_timestamp("t")).collect()] == [True, False, False, False]
    ids = spark.createDataFrame([("7",), (" 7 ",), ("07",), ("-1",), ("",), (None,)], "t string")
    assert [r[0] for r in ids.select(checks.object_id("t")).collect()] == [7, 7, None, None, None, None]


def test_geojson(spark, tmp_path):
    path = tmp_path / "a.geojson"
    one = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"FPId":" B-1 ","h":1.5}}'
    path.write_text('{"type":"FeatureCollection","features":[' + one + "," + one.replace("B-1", "B-2").replace("[1,1],[0,0]", "[1,1],[0,1]") + "]}")
    got = rows(geojson.normalise(geojson.read(spark, str(path)), "FPId"), "source_feature_id", "source_ordinal", "max_x", "fault")
    assert got == [("B-1", 1, 1.0, None), ("B-2", 2, 1.0, "geometry")]
    path.write_text('{"type":"Feature"}')
    with pytest.raises(Exception, match="collection"):
        geojson.read(spark, str(path)).collect()


def test_container(spark, tmp_path):
    df = spark.createDataFrame([(1, i // 2, f"k{i}", float(i), 0.0, float(i), 1.0) for i in range(5)], "level int, chunk long, id string, min_x double, min_y double, max_x double, max_y double")
    container.write(container.encode(df, "id"), str(tmp_path / "c"))
    chunks = container.read(spark, str(tmp_path / "c"))
    assert rows(container.decode(chunks, "id string, min_x double"), "id", "min_x") == [(f"k{i}", float(i)) for i in range(5)]
    assert rows(container.decode(chunks, "id string", level=1, view=(2.5, 0, 3.5, 1)), "id") == [("k2",), ("k3",)]
    with pytest.raises(Exception, match="checksum"):
        container.decode(chunks.withColumn("payload_sha256", F.lit("0")), "id string").collect()


def test_extent_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, min_x double, min_y double, max_x double, max_y double")
    assert tuple(spatial_join.extent(empty).first()) == (None,) * 4
    assert math.isclose(spark.range(1).select(spatial.wheel_scale(F.lit(9999.0))).first()[0], math.exp(0.36))
