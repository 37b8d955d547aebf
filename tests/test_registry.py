import pathlib
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from meltemi.plans.sf_views import VIEWS, sql
from tools_check import TABLES, canonical

SF = "/root/testdata/sf0.001"
#: The queries of this library's own operators; the training-data subpackage has its own tests.
QUERIES = entry_points.REGISTRY
ORACLE = {name: query.sql for name, query in QUERIES.items() if query.sql is not None}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["Renewable_Pct"] and df.count() == 1


def test_inventory_is_covered():
    ids = {name.split("_")[0] for name in QUERIES}
    want = {f"{p}{i:02d}" for p, n in (("A", 10), ("B", 12), ("C", 14), ("D", 7), ("E", 30), ("F", 17), ("G", 27)) for i in range(1, n + 1)}
    assert ids == want
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "stream" not in n and not n.startswith("A05")))
def test_no_cartesian_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["E01_total_generation"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ts", plan)
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "props" not in schema and "event_id" not in schema


def test_views_and_tables_agree(spark, duck):
    from meltemi.plans.sf import SfTables

    names = {"ev": "events", "gas": "emissions", "pos": "vessel_positions"}
    tables = SfTables(spark, SF)
    for view in VIEWS:
        df = tables[names.get(view, view)]
        want = duck.sql(sql(view, f"select * from {view}")).df()
        assert sorted(df.columns) == sorted(want.columns), view
        assert df.count() == len(want), view


def test_nothing_is_pulled_through_the_driver():
    sources = [p.read_text() for p in pathlib.Path(entry_points.__file__).parent.glob("meltemi/**/*.py") if "llm" not in p.parts]
    for word in (".collect(", ".toPandas(", "crossJoin(", "localCheckpoint(", ".rdd", "toLocalIterator("):
        assert not any(word in text for text in sources), word
