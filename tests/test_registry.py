"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

from allelith.plans.registry import R
from allelith.plans.relation import expand

TABLES = ("part", "orders", "lineitem", "documents", "benchmark")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return c


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(round(r[i], 4) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(R))
def test_query_equals_sql(spark, con, sf, name):
    df = R.queries()[name](spark, sf)
    want = con.sql(R.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    types = dict(df.dtypes)
    assert {c: TYPES.get(types[c]) for c in types} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_macros_nest_and_keep_commas():
    assert expand("x @size(@split(a; ,)) y", "duckdb") == "x len(string_split(a, ',')) y"
    assert expand("@split(f(a, b); /)", "spark") == "split(f(a, b), '/')"


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    # every query that isn't compared with SQL here or in tests/llm runs at least
    for name in sorted(set(e.queries()) - set(R)):
        if not name.startswith("op") and name != "pipeline":
            assert e.queries()[name](spark, sf).count() >= 0, name


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["interval_merge_pad", "path_append", "haplotype_to_path", "best_helper", "node_counts", "covered_by_sv", "overlap_depth", "segments", "min_count_sketch"])
def test_plans_have_no_products(spark, sf, name):
    """No nested loops or products of two tables; one-row scalars are subqueries."""
    plan = planned(R.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_written_relations_follow_their_input(spark, sf, tmp_path):
    import shutil

    for t in TABLES:
        shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    run = R.queries()["genotype_confusion"]
    before = run(spark, str(tmp_path)).first()
    spark.read.parquet(f"{sf}/lineitem.parquet").limit(500).coalesce(1).write.parquet(f"{tmp_path}/few")
    (tmp_path / "lineitem.parquet").unlink()
    shutil.move(next((tmp_path / "few").glob("part*.parquet")), tmp_path / "lineitem.parquet")
    assert run(spark, str(tmp_path)).first() != before
