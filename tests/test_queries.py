"""A sample of the registered queries against their SQL; all are compared by
the driver."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
SAMPLE = ("overall", "find_sec_secrets", "find_perf_api_efficiency", "duplicate_lines", "patched_files", "judge_blend",
          "evidence", "error_audits", "project_hash", "sarif_documents", "judged_audit", "stream_updates", "stored_other_config",
          "single_files_shared_paths", "incremental_appended_twice", "call_judge", "incremental_dimensions", "incremental_file_findings",
          "stream_audits", "stream_late", "configured_per_project", "findings_per_project", "project_ranks", "report_lines",
          "reaudit_all_rules", "judge_usage_merged", "project_tree")

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([r[i] for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "events", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    want = con.execute(entry_points.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in want.description], want.fetchall())


def test_every_statement_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    own = set(entry_points.queries()) - set(entry_points.LLM_QUERIES)
    assert own - set(entry_points.oracle_sql()) == set()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """Tables may be folders; a name is then that of no file."""
    words = "You are an expert. api_key = 'sk-" + "a1B2" * 13 + "'"
    docs = spark.createDataFrame([(i, f"{words} {i}", "en", "web", 60) for i in range(64)], "doc_id long, text string, lang string, source string, n_chars long")
    times = spark.range(8).selectExpr("id AS event_id", "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(id AS INT)) AS ts")
    parts, whole = tmp_path / "parts", tmp_path / "whole"
    docs.repartition(3).write.parquet(str(parts / "documents.parquet"))
    times.repartition(2).write.parquet(str(parts / "events.parquet"))
    whole.mkdir()
    for name, df in (("documents", docs), ("events", times)):
        df.toPandas().to_parquet(whole / f"{name}.parquet", index=False, coerce_timestamps="us")
    for name in ("stream_findings", "stream_signals", "stream_windows"):
        query = entry_points.queries()[name]
        rows = sorted(map(str, query(spark, str(parts)).collect()))
        assert rows and rows == sorted(map(str, query(spark, str(whole)).collect()))
