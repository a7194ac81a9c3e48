"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from geolith.plans import artifacts, contracts, maps, registry, releases, shapes, stored  # noqa: F401
from geolith.tables import scratch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, duck, name):
    with scratch(spark):
        df = registry.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert got
        return
    cursor = duck.execute(registry.SQL[name])
    order = [x[0] for x in cursor.description]
    assert sorted(order) == columns
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["collection_features", "candidate_faults"])
def test_features_of_two_faults(spark, tmp_path, name):
    """Numbers that both planted faults of ordinates fall on, with shapes of all four types."""
    part = f"SELECT * REPLACE (p_partkey + CASE p_partkey // 50 WHEN 0 THEN 5270 WHEN 1 THEN 6980 WHEN 2 THEN 1660 ELSE 3370 END AS p_partkey) FROM '{SF}/part.parquet' WHERE p_partkey < 200"
    con = duckdb.connect()
    con.execute(f"COPY ({part}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    both = con.execute("SELECT list(DISTINCT p_partkey % 4) FROM part WHERE p_partkey % 1763 = 0").fetchone()[0]
    assert sorted(both) == [0, 1, 2, 3]
    with scratch(spark):
        df = registry.QUERIES[name](spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=repr)
    order = ", ".join(df.columns)
    assert got == sorted(con.execute(f"SELECT {order} FROM ({registry.SQL[name]})").fetchall(), key=repr)
