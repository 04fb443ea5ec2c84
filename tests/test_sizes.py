"""What large tables need: rows of one row group are dealt out to many tasks, and dear texts are made once."""

import pytest
from pyspark.sql import functions as F

from fundsieve.operators import ranks
from fundsieve.plans import catalogue, funds


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    """A folder whose parts are one row group, to be dealt out by ten rows a task."""
    pq = pytest.importorskip("pyarrow.parquet")
    pa = pytest.importorskip("pyarrow")
    n = range(200)
    columns = {"p_partkey": list(n), "p_name": [("old ring", "hot gizmo", "small bolt")[i % 3] for i in n], "p_brand": [f"Brand#{i % 25 + 1}" for i in n]}
    columns |= {"p_type": [("STANDARD", "SMALL", "PROMO", "MEDIUM")[i % 4] for i in n], "p_size": pa.array([i % 50 + 1 for i in n], pa.int32()), "p_retailprice": [900 + i / 10 for i in n]}
    pq.write_table(pa.table(columns), tmp_path / "part.parquet")
    monkeypatch.setattr(ranks, "DEALT", 10)
    return str(tmp_path)


def tasks(df):
    """How many tasks have rows."""
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.mark.parametrize("name", ["fund_taxonomy", "product_page_facts", "search_terms", "tearsheet_page_facts", "text_sheet_facts"])
def test_a_row_group_is_read_by_many_tasks(spark, table, name):
    assert tasks(catalogue.QUERIES[name](spark, table)) >= 15


def test_a_name_is_opened_once(spark, table):
    plan = catalogue.QUERIES["search_terms"](spark, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ISHRS\\b") == 1


def test_a_run_counts_without_sorting_and_sorts_what_counts(spark, table):
    run = funds.run(spark, table)
    assert tasks(run.matched) >= 15
    assert "Window" not in run.chosen()._jdf.queryExecution().optimizedPlan().toString()


def test_a_snapshot_sorts_its_rows_once(spark, table):
    plan = catalogue.QUERIES["strategy_snapshot"](spark, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1


@pytest.mark.parametrize("name", ["strategy_emitted", "strategy_report", "strategy_snapshot"])
def test_strategies_match_funds_to_their_own_buckets_only(spark, table, monkeypatch, name):
    runs, run = [], funds.run
    monkeypatch.setattr(funds, "run", lambda *args: runs.append(run(*args)) or runs[-1])
    catalogue.QUERIES[name](spark, table)
    tried = {r.bucket for r in runs[0].ladder_df.collect()}
    assert tried == {bucket for parts in funds.MIXES.values() for bucket, _ in parts}


def test_a_run_for_strategies_diagnoses_and_picks_as_one_over_all_buckets(spark, table):
    every, own = funds.run(spark, table), funds.run(spark, table, funds.S.held(funds.MIXES))
    names = [s["bucket"] for s in own.specs]
    rows = lambda df: sorted(map(str, df.where(F.col("bucket").isin(names)).collect()))
    assert rows(own.attempt_counts()) == rows(every.attempt_counts())
    shown = ("bucket", "attempt", "rank", "isin", "selection_reason")
    assert rows(own.picked().select(*shown)) == rows(every.picked().select(*shown)) != []


def test_a_task_of_a_snapshot_sorts_no_more_rows_of_a_larger_table(spark, table, tmp_path):
    rows = lambda: funds.run(spark, table, funds.S.held(funds.MIXES)).matched.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    few, part = rows(), spark.read.parquet(f"{table}/part.parquet")
    more = part.crossJoin(spark.range(4)).withColumn("p_partkey", F.col("p_partkey") * 4 + F.col("id")).drop("id")
    table = str(tmp_path / "more")
    more.coalesce(1).write.parquet(f"{table}/part.parquet")
    assert rows() <= 3 * few
