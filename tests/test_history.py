"""Folds of the classification log: transitions, long histories, refusals."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geolith.operators import history

ACTIONS = st.lists(st.sampled_from(["undo", "undo", "a", "b", "c", "d"]), max_size=40)
STATES = [(p, c) for c in "abxy" for p in (None, *"abxy") if p != c]


def one_by_one(rows, previous=None, current=history.DEFAULT, changes=0, last=None, log=None):
    for at, action in rows:
        undo = action == "undo"
        if (previous is None) if undo else (action == current):
            continue
        new = previous if undo else action
        if log is not None:
            log.append((at, current, new, "undo" if undo else "classification" if last is None else "correction", last, last if undo else None))
        previous, current, changes, last = current, new, changes + 1, at
    return previous, current, changes, last


@settings(max_examples=300, deadline=None)
@given(ACTIONS, ACTIONS)
def test_transitions_compose(first, second):
    rows = list(enumerate(first + second))
    parts = [history.transition(x) for x in (rows[: len(first)], rows[len(first) :]) if x]
    for previous, current in STATES:
        state = (previous, current, 3, -9)
        for part in parts:
            state = history.applied(part, *state)
        assert state == one_by_one(rows, previous, current, 3, -9)


@pytest.fixture
def parts(spark):
    """Small parts stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_key_with_a_third_of_all_actions(spark, parts):
    rng = random.Random(6)
    vocabulary = ["undo", "undo", "undo", "a", "b", "c"]
    rows = [(1 if rng.random() < 0.34 else rng.randint(2, 400), i, rng.choice(vocabulary)) for i in range(6000)]
    rows += [(5000, i, rng.choice(["undo", "a"])) for i in range(200)] + [(6000, 1, None), (None, 3, "a"), (None, 4, "undo")]
    df = spark.createDataFrame(rows, "k long, at long, action string").repartition(5)
    of_key = {}
    for k, at, action in sorted(rows, key=lambda r: r[1]):
        if action:
            of_key.setdefault(k, []).append((at, action))
    cut = history.segments(df, "k", "at", size=50)
    assert cut.where("size(rows) > 50").count() == 0 and cut.where("k = 1").count() > 30
    assert cut.where("k = 1").select("part").distinct().count() > 1
    got = {r.k: (r.previous, r.current, r.changes) for r in history.fold(df, "k", "at", size=50).collect()}
    assert got == {k: one_by_one(own)[:3] for k, own in of_key.items()}
    want = []
    for k, own in of_key.items():
        log = []
        one_by_one(own, log=log)
        want += [(k, *event) for event in log]
    assert sorted(map(repr, (tuple(r) for r in history.events_of(df, "k", "at", size=50).collect()))) == sorted(map(repr, want))
    assert history.fold(df.limit(0), "k", "at").count() == 0


def test_refused_actions(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "a"), (4, 4, "undo"), (None, 5, "b")], "k long, at long, action string")
    identities = spark.createDataFrame([(1, "active"), (2, "inactive"), (3, "retired")], "k long, identity_status string")
    kept, refused = history.accepted_actions(df, identities, "k")
    assert [tuple(r) for r in kept.collect()] == [(1, 1, "a")]
    assert sorted((r.at, r.reason) for r in refused.collect()) == [(2, "inactive"), (3, "retired"), (4, "unknown"), (5, "unknown")]
