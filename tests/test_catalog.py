"""Registered queries: same answers as their SQL, and plans that scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["ranked_search", "chunks", "caption_dedup", "diarize", "quote_check", "ingest_formats", "track_ranking",
          "stale_items", "page_title_links", "quality_score", "stream_captions", "stream_chunks"]
# Queries whose plans are looked at without running them.
PLANNED = ["chunk_membership", "diarization_coverage", "global_timeline", "translation_coverage", "select_item", "contract_audit",
           "completion_gate", "coverage_audit", "sample_asof_segment", "reusable_episodes", "topic_timeline", "query_expansion"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairwise_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    from earmark.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_columns_reach_the_scan(spark):
    plan = entry.queries()["global_timeline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in plan
    assert "l_shipdate" not in plan
