"""Every query against its SQL in another engine, on the smallest tables."""

import math
import os

import duckdb
import pytest

from bomwright import stages
from bomwright.plans import registry
from bomwright.sources import adapters

ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else str(int(value)) if isinstance(value, bool | int) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(ORACLE[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    theirs = sorted((tuple(plain(row[k]) for k in at) for row in result.fetchall()), key=str)
    ours = sorted((tuple(map(plain, row)) for row in df.select(*columns).collect()), key=str)
    assert ours == theirs


def test_queries_without_sql_run(spark, sf_dir):
    for name in registry.queries().keys() - ORACLE.keys():
        assert registry.queries()[name](spark, sf_dir).count()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_large_tables_are_dealt_to_more_tasks(spark, sf_dir, monkeypatch):
    """Lines are dealt by their order to as many tasks as they need, and stay there when they are joined and grouped."""
    monkeypatch.setattr(stages, "ROWS_A_TASK", 300)
    lines = adapters.read(spark, sf_dir, "lineitem").count()
    for name in ("map_nodes", "map_edges", "map_totals", "step_places", "material_overall_shares", "hazardous_locations", "ghg_footprint_dedup"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_orderkey" in plan and f", {-(-lines // 300)}), REPARTITION_BY_NUM" in plan, name
        assert "hashpartitioning(tree_id" not in plan, name
    rows = spark.range(1200)
    assert stages.dealt(rows, 1200, "id") is rows
