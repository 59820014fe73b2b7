import duckdb
import pytest
from comparing import assert_same

from tracewell import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert_same(df, ORACLES[name], sf_dir)
    else:
        assert len(df.toPandas()) > 0  # every column is computed


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["early_stop_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(doc_id,800)" in plan and "text" not in plan and "TakeOrdered" in plan


def test_status_snapshot_aggregates_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["status_snapshot"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_missing_index_fill_is_one_aggregation(spark, tmp_path):
    """Repeated and null keys, null and other statuses and tests outside the range, as the SQL has them; no join and no row for each test."""
    orders = [(1,), (2,), (2,), (3,), (None,)]
    lines = [(1, 1, "O"), (1, 1, "F"), (1, 2, "O"), (1, 2, "P"), (1, 3, None), (1, 6, "O"), (2, 5, "O"), (2, 4, "F"), (2, 0, "O"), (9, 1, "O"), (None, 1, "O")]
    spark.createDataFrame(orders, "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["missing_index_fill"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(con.sql(ORACLES["missing_index_fill"]).fetchall(), key=key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "SortAggregate" not in plan
