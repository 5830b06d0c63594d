"""Every registered query against its expected-result SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.oracle(FOLDER)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["record_type"] for r in rows} == {"news", "parliament"} and any(r["included"] for r in rows)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.SQL)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, connection, name):
    assert compare.difference(entry.QUERIES[name](spark, FOLDER), connection, entry.SQL[name]) == ""


def test_streams_read_tables_of_part_files(spark, tmp_path):
    for table in ("documents", "events", "orders"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in ("stream_dedupe", "stream_score", "stream_health_window", "stream_ledger"):
        whole, parts = (sorted(map(str, entry.QUERIES[name](spark, folder).collect())) for folder in (FOLDER, str(tmp_path)))
        assert whole == parts and "records=0" not in whole[0]


def test_sort_results_scores_its_texts_once(spark, monkeypatch):
    from pubwatch.operators import ranking

    seen = []
    monkeypatch.setattr(ranking, "number_rows", lambda df, order, name: seen.append(df) or df)
    entry.QUERIES["sort_results"](spark, FOLDER)
    # What is range-sorted holds only what was written, no text and no scoring.
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [doc_id#" in plan and "text" not in plan and "Generate" not in plan
