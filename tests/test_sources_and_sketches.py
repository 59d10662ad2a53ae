"""The folder tree as a data source, and usage that merges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscan.operators import judges as jd, reports as rp
from folioscan.plans.audit import Audit
from folioscan.sources import sinks, tree_source as ts

FILES = "project_id string, path string, content string"


@pytest.fixture()
def tree(spark, tmp_path):
    spark.dataSource.register(ts.ProjectTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = [("a", "x.py", "1"), ("a", "lib/y.py", "é"), ("a", "lib/deep/z.md", ""), ("a", ".gitignore", "*.pyc"), ("b", "x.py", "2"), (".", "top.md", "t")]
    spark.createDataFrame(rows, FILES).write.format("project_tree").mode("append").save(str(tmp_path))
    os.makedirs(tmp_path / "a" / ".git")
    (tmp_path / "a" / ".git" / "config").write_text("no")
    (tmp_path / "b" / "broken.py").write_bytes(b"\xff\xfe")
    return str(tmp_path), [*rows, ("b", "broken.py", None)]


def read(spark, root):
    return spark.read.format("project_tree").load(root)


def test_round_trip(spark, tree):
    root, rows = tree
    assert sorted(map(tuple, read(spark, root).collect()), key=str) == sorted(rows, key=str)
    assert not [x for x in os.listdir(root) if x.startswith(ts.STAGING)]
    got = read(spark, root).filter("project_id = 'a' AND path LIKE '%.py' AND content <> '1'").collect()
    assert [tuple(r) for r in got] == [("a", "lib/y.py", "é")]
    assert read(spark, root).filter("path LIKE 'lib/d%'").count() == 1
    spark.createDataFrame([("c", "n.py", "3")], FILES).write.format("project_tree").mode("overwrite").save(root)
    assert [tuple(r) for r in read(spark, root).collect()] == [("c", "n.py", "3")]


def test_conditions_leave_out_folders(tree, monkeypatch):
    root, _ = tree
    reader = ts.TreeReader(root)
    rest = list(reader.pushFilters([ts.EqualTo(("project_id",), "a"), ts.StringEndsWith(("path",), ".md"), ts.StringStartsWith(("path",), "lib/deep"),
                                    ts.EqualTo(("content",), "x"), ts.IsNotNull(("path",)), ts.IsNotNull(("content",))]))
    assert len(rest) == 2
    listed = []
    fs, _ = ts._file_system(root)

    class Seen:
        def get_file_info(self, what):
            listed.append(getattr(what, "base_dir", what)[len(root):])
            return fs.get_file_info(what)

        open_input_stream = fs.open_input_stream

    monkeypatch.setattr(ts, "_file_system", lambda path: (Seen(), path.rstrip("/")))
    parts = reader.partitions()
    assert {(p.project, p.folder) for p in parts} == {("a", ""), ("a", "lib")} and listed == ["", "/a"]
    assert [r for p in parts for r in reader.read(p)] == [("a", "lib/deep/z.md", "")]
    assert listed == ["", "/a", "/a", "/a/lib", "/a/lib/deep"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(ts.ProjectTree)
    rows = spark.range(40).repartition(4).selectExpr("'p' AS project_id", "CASE WHEN id = 33 THEN '../out' ELSE concat('f', id) END AS path", "'x' AS content")
    with pytest.raises(Exception):
        rows.write.format("project_tree").mode("append").save(str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_sarif_files(spark, tmp_path):
    files = spark.createDataFrame([("a", "lib/main.py", "exec(x)\npassword = 'hunter2hunter2'"), ("b", "x.py", "eval(y)")], FILES)
    docs = rp.sarif_documents(Audit(files).findings())
    sinks.write_tree(docs, str(tmp_path), "project_id", sinks.SARIF_PATH, "sarif")
    found = {(r["project_id"], r["path"]): json.loads(r["content"])["version"] for r in read(spark, str(tmp_path)).collect()}
    assert len(found) == docs.count() and set(found.values()) == {"2.1.0"} and ("a", "S/lib/main.py.sarif") in found and ("b", "X/project.sarif") in found


def test_sketches_merge(spark):
    calls = spark.range(40_000).selectExpr(
        "concat('p', id % 900) AS project_id", "CASE WHEN id % 4 = 0 THEN 'P' ELSE 'C' END AS judge", "'success' AS status", "CAST(id % 31 AS INT) AS day",
        "CAST((id * 7919) % 10007 AS INT) AS latency_ms", "10 AS input_tokens", "2 AS output_tokens", "CAST(id % 2 AS INT) AS retries")
    daily = jd.usage_sketches(calls, "day")
    got = {r["judge"]: r for r in jd.merged_usage(daily).collect()}
    for judge, rows in (("P", calls.filter("judge = 'P'")), ("C", calls.filter("judge = 'C'"))):
        n, projects = rows.count(), rows.select("project_id").distinct().count()
        assert got[judge]["n_calls"] == n and got[judge]["input_tokens"] == 10 * n
        assert abs(got[judge]["n_projects"] - projects) <= 0.05 * projects
        for q, name in ((0.5, "median"), (0.95, "p95")):
            value = got[judge][f"{name}_latency_ms"]
            share = rows.filter(F.col("latency_ms") <= value).count() / n
            assert abs(share - q) <= 0.02
    assert jd.merged_usage(daily, "day").count() == 62
    small = calls.limit(90)
    exact = {(r["judge"]): r["median_latency_ms"] for r in jd.judge_usage(small).collect()}
    assert {r["judge"]: r["median_latency_ms"] for r in jd.merged_usage(jd.usage_sketches(small, "day")).collect()} == exact
    scores = spark.createDataFrame([("S", i, i % 3) for i in range(101)], "dimension string, score int, day int")
    assert jd.merged_scores(jd.score_sketches(scores, "day")).first().asDict() == {
        "dimension": "S", "n": 101, "mean": 50.0, "least": 0, "lower": 25, "median": 50, "upper": 75, "most": 100}
