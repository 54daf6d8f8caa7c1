"""Verdicts on means that lie at a half: the same whatever order lines are summed in."""

from datetime import datetime
from itertools import permutations

import duckdb
import pytest

from strandlake import catalog

#: Discounts whose mean is 4.5 hundredths; summed in some orders it comes out below.
HALF = (0.0, 0.01, 0.04, 0.06, 0.07, 0.09)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("verdicts"))
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp"
    rows = [(part, part, 1, i % 3 + 1, 10.0, d, 0.05, datetime(2024, 1, 1)) for part, order in enumerate(list(permutations(HALF))[::9]) for i, d in enumerate(order)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def both(spark, folder, name, column):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    sql = {r[0] for r in db.execute(f"SELECT {column} FROM ({catalog.oracle_sql()[name]})").fetchall()}
    return {r[0] for r in catalog.queries()[name](spark, folder).select(column).collect()}, sql


def test_redundancy_verdict_at_a_half(spark, lines):
    assert both(spark, lines, "e7_matched_and_redundancy", "redundancy") == ({"default is fine"}, {"default is fine"})


def test_tradeoff_at_a_half(spark, lines):
    assert both(spark, lines, "q2_tradeoff", "note") == ({"settings"}, {"settings"})


def test_tradeoff_beside_a_half(spark, tmp_path):
    """Means whose seventh place is at a half itself, a hair below 0.5 hundredths, are rounded as in the SQL; so are numbers too large for seven more places."""
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    means = [(d, k / 100) for k in range(-20, 200) for d in ((k - 0.50000005) / 100, (k + 0.49999995) / 100)]
    odd = [(a, b) for a in (1e301, -1e301, 1e305, 1e307, float("inf"), float("nan"), None) for b in (0.0, 2e301, 1e305)]
    rows = [(i, i, 1, 1, 1.0, d, t) for i, (d, t) in enumerate(means + odd)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    sql = dict(db.execute(catalog.oracle_sql()["q2_tradeoff"]).fetchall())
    out = dict(map(tuple, catalog.queries()["q2_tradeoff"](spark, str(tmp_path)).collect()))
    assert len(out) == len(rows)
    assert {rows[i][5:]: (out[i], sql.get(i)) for i in out if out[i] != sql.get(i)} == {}


def test_ranges_grow_in_number(spark, monkeypatch):
    from strandlake.operators import ordering

    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    df = spark.range(3000).selectExpr("id % 2 AS g", "(id * 7919) % 3000 AS x")
    assert ordering.range_count(df) == 30
    out = ordering.placed(df, ["g"], ["x"])
    assert out.selectExpr("spark_partition_id() AS p").groupBy("p").count().selectExpr("max(count)").first()[0] < 1000
    assert all(r.i == r.x // 2 and r.n == 1500 for r in out.collect())
