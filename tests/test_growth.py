"""What keeps tasks and the driver small when tables grow: no text in joins of trees, no broadcast of what grows, no key for all rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from geolith.operators import reconcile, spatial_join, stored
from geolith.plans import artifacts, maps
from geolith.sources import tree

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def leaves(monkeypatch):
    """The files of each tree that is made."""
    found, made = [], tree.tree
    monkeypatch.setattr(tree, "tree", lambda files, depth=None: (found.append(files), made(files, depth))[1])
    return found


def test_texts_are_not_joined(spark, leaves):
    artifacts.tree_differences(spark, D)
    assert len(leaves) == 2 and any("geolith-contents" in x for x in leaves[1].inputFiles())


def test_one_tree_for_its_nodes(spark, leaves):
    artifacts.tree_nodes(spark, D)
    assert len(leaves) == 1


def test_folders_are_digested_in_shares(spark):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    files = [(f"a/{i}", f"text {i}") for i in range(300)]
    child = [f"{len(p) - 2}:{p[2:]}:fi:{sha(t)}" for p, t in files]
    shares = {}
    for c in child:
        shares.setdefault(sha(c)[:4], []).append(c)
    want = sha(",".join(sorted(sha(",".join(sorted(x))) for x in shares.values())))
    nodes = tree.tree(tree.of_contents(spark.createDataFrame(files, "path string, content string")), 2)
    row = nodes.where("path = 'a'").first()
    assert (row.sha256, row.length) == (want, sum(len(t) for _, t in files))


def test_faults_are_not_shuffled_by_validator(spark):
    assert "BroadcastHashJoin" in plan(artifacts.validator_faults(spark, D))


def test_lineage_is_not_broadcast(spark, monkeypatch):
    plans, saved = [], reconcile.save
    monkeypatch.setattr(reconcile, "save", lambda df, tag, **options: (plans.append(plan(df)), saved(df, tag, **options))[1])
    plans.append(plan(artifacts.identity_lineage(spark, D)))
    assert len(plans) > 3 and not any("BroadcastHashJoin" in x for x in plans)


def test_records_are_not_broadcast(spark):
    rows = spark.read.parquet(f"{D}/orders.parquet").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    assert "BroadcastHashJoin" not in plan(stored.recorded(rows, rows, ["key"], ["o_orderstatus"]))


def test_sides_of_a_plan_are_not_broadcast(spark):
    old, new = (artifacts.accepted(spark, D), artifacts.candidate(spark, D))
    for df in (reconcile.continuations(old, new, "id"), reconcile.replacements(old, new, "id")):
        assert "BroadcastHashJoin" not in plan(df)


def test_points_and_shapes_that_are_alike_are_tested_once(spark):
    for name in (maps.exact_hit_test, maps.triangle_hits):
        assert plan(name(spark, D)).count("collect_list") >= 2


def test_copies_of_points_and_shapes_do_not_meet_again(spark, tmp_path, monkeypatch):
    """Three copies of each side give nine times the pairs by as many rows in the join as one."""
    sides, meet = [], spatial_join._meet
    monkeypatch.setattr(spatial_join, "_meet", lambda own, near, *rest: (sides.append((own.count(), near.count())), meet(own, near, *rest))[1])
    for table, key, step in (("part", "p_partkey", 40 * 23), ("customer", "c_custkey", 300 * 433)):
        copies = spark.read.parquet(f"{D}/{table}.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
        copies.withColumn(key, F.col(key) + F.col("copy") * step).drop("copy").write.parquet(f"{tmp_path}/{table}.parquet")
    assert maps.exact_hit_test(spark, str(tmp_path)).count() == 9 * maps.exact_hit_test(spark, D).count() > 0
    assert len(sides) == 2 and sides[0] == sides[1]
