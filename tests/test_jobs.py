"""Sources, reports, judges and streams."""

import json

from pyspark.sql import functions as F

from folioscan.operators import classify as cl, findings as fd, fixes as fx, judges as jd, reports as rp
from folioscan.operators.custom import CustomDimension, CustomRule, custom_findings, with_custom_dimensions
from folioscan.plans.audit import Audit
from folioscan.rules import catalog as cat
from folioscan.sources import files as src, sinks
from folioscan.streaming import audit as st


def frame(spark, rows):
    return spark.createDataFrame(rows, "project_id string, path string, content string")


def test_read_project_tree(spark, tmp_path):
    for name, data in {
        "a/main.py": b"x = eval(y)\r\n\xff", "a/pkg/__pycache__/m.py": b"eval(1)", "a/.git/config": b"", "a/.gitignore": b"*.pyc", "a/x/y/__init__.py": b"",
        "b/README.md": "é".encode(), "top.txt": b"no project", "c/1/2/3/4/5/deep.txt": b"d",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {("a", "main.py"): "x = eval(y)\r\n", ("a", ".gitignore"): "*.pyc", ("a", "x/y/__init__.py"): "", ("b", "README.md"): "é",
            (".", "top.txt"): "no project", ("c", "1/2/3/4/5/deep.txt"): "d"}
    got = {(r.project_id, r.path): r.content for r in src.read_project_tree(spark, str(tmp_path), 4).collect()}
    assert got == want
    lone = {(r.project_id, r.path) for r in src.read_project_tree(spark, str(tmp_path), 4, project="all").collect()}
    assert lone == {("all", f"{p}/{path}".removeprefix("./")) for p, path in want}
    one = src.read_single_file(spark, str(tmp_path / "b" / "README.md")).collect()
    assert [(r.path, r.kind, r.text) for r in one] == [("README.md", "prompt", "é")]


def test_read_many_folders(spark, tmp_path):
    for i in range(2000):
        (tmp_path / "src" / f"d{i:04}").mkdir(parents=True)
        (tmp_path / "src" / f"d{i:04}" / "f.txt").write_text(str(i))
    assert src.read_project_tree(spark, str(tmp_path), 8, project="p").selectExpr("sum(CAST(content AS INT))").first()[0] == sum(range(2000))


FILES = [("p", "main.py", "eval(a)\nexec(b)\n"), ("p", "z.py", "\n\nx = eval(c)"), ("q", "m.md", "hi")]


def test_sarif(spark):
    found = Audit(frame(spark, FILES)).findings()
    results = {(r.uri, r.start_line): r for r in rp.sarif_results(found).filter("rule_id = 'sec_dangerous_functions'").collect()}
    assert set(results) == {("main.py", 1), ("main.py", 2), ("z.py", 3)}
    assert results["z.py", 3].level == "warning" and "\nFix: " in results["z.py", 3].message
    docs = {(r.dimension, r.path): json.loads(r.sarif) for r in rp.sarif_documents(found).filter("project_id = 'p'").collect()}
    assert {d["version"] for d in docs.values()} == {"2.1.0"}
    assert sum(len(d["runs"][0]["results"]) for d in docs.values()) == found.filter("project_id = 'p'").count()
    for d in docs.values():
        ids = [r["id"] for r in d["runs"][0]["tool"]["driver"]["rules"]]
        assert ids == list(dict.fromkeys(r["ruleId"] for r in d["runs"][0]["results"]))
    whole = [r for r in docs["X", None]["runs"][0]["results"] if r["ruleId"] == "maint_documentation"]
    assert whole[0]["locations"][0]["physicalLocation"]["region"] == {}


def test_a_document_keeps_any_number_of_results_in_order(spark):
    rows = frame(spark, [("p", "big.py", "eval(x)\nexec(y)\n" * 10_000), ("p", "small.py", "eval(z)")])
    docs = {r.path: json.loads(r.sarif)["runs"][0]["results"] for r in rp.sarif_documents(fd.findings(rows, rules=["sec_dangerous_functions"])).collect()}
    assert {p: len(d) for p, d in docs.items()} == {"big.py": 20_000, "small.py": 1}
    lines = [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in docs["big.py"]]
    assert lines == [*range(1, 20_001, 2), *range(2, 20_001, 2)]  # by pattern, then by place


def test_report_lines(spark):
    audit = Audit(frame(spark, FILES))
    rows = rp.report_lines(audit.audits(nested=True), audit.findings(), audit.patches("suggested"), cl.project_files(audit.files)).collect()
    kinds = {k: [json.loads(r.line) for r in rows if r.record == k] for k in ("audit", "issue", "patch", "file")}
    assert len(rows) == sum(map(len, kinds.values())) and len(kinds["audit"]) == 2 and len(kinds["file"]) == len(FILES)
    assert len(kinds["issue"]) == audit.findings().count() and {p["applied"] for p in kinds["patch"]} == {True}


def test_patches_that_cannot_be_applied(spark):
    """A line that lies within one patched before is gone when its turn comes."""
    own = (("sec_dangerous_functions", lambda line: "'done'", "x", "suggested"),)
    rows = frame(spark, [("p", "m.py", "a = eval(x) + b\neval(x)\n")])
    got = {r.original: r.applied for r in fx.patches(rows, "suggested", line_fixers=own).filter("file_path = 'm.py'").collect()}
    assert got == {"a = eval(x) + b": True, "eval(x)": True}
    rows = frame(spark, [("p", "m.py", "eval(x)\n  eval(x)\n")])
    again = (("sec_dangerous_functions", lambda line: f"concat('#', replace({line}, 'eval', 'parse'))", "x", "suggested"),)
    stats = fx.patch_stats(fx.patches(rows, "suggested", line_fixers=again).filter("file_path = 'm.py'")).first()
    assert (stats.n_patches, stats.n_applied, stats.n_failed) == (2, 2, 0)


def test_sinks(spark, tmp_path):
    found = Audit(frame(spark, FILES)).findings()
    sinks.write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == found.count()
    sinks.write_documents(rp.json_reports(Audit(frame(spark, FILES)).audits(nested=True)), "report", str(tmp_path / "r"))
    reports = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert {r["project_id"] for r in reports} == {"p", "q"} and "S" in reports[0]["dimension_scores"]


def test_judge_requests_cut_prompts(spark):
    rows = [("p", f"m{i:04}.md", "y" * (i % 7)) for i in range(3000)] + [("p", f"c{i}.py", f"{i}" * 4000) for i in range(7)] + [("e", "x.bin", "")]
    got = {(r.project_id, r.judge): r.user_prompt for r in jd.judge_requests(frame(spark, rows), limits=jd.Limits()).collect()}
    prompt = "\n".join("y" * (i % 7) for i in range(3000))[:6000]
    code = "\n".join(f"{i}" * 3000 for i in range(5))[:4000]
    assert got["p", "P"] == f"## Prompt\n```\n{prompt}\n```\n\n## Code\n```\n{code}\n```"
    assert got["e", "C"] == "Nothing to review was found."
    whole = {}
    for r in jd.judge_requests(frame(spark, rows), size=1500).filter("judge = 'P'").orderBy("path", "part").collect():
        assert not r.truncated and len(r.user_prompt) < 1600
        body = r.user_prompt.split("```")[1][1:-1] if r.path else ""
        whole[r.project_id, r.path] = whole.get((r.project_id, r.path), "") + body
    whole.pop(("e", None))
    assert whole == {(p, path): text for p, path, text in rows if text}


def test_call_judge_retries(spark):
    def flaky():
        calls = {}

        def ask(system, user, timeout):
            calls[user] = calls.get(user, 0) + 1
            if user == "never" or (user == "later" and calls[user] < 2):
                raise TimeoutError("slow")
            return '{"clarity": {"score": 50}}', 3, 4
        return ask

    requests = spark.createDataFrame([("a", "P", "x", 0, "s", "now"), ("b", "P", "x", 0, "s", "later"), ("c", "P", "x", 0, "s", "never")],
                                     "project_id string, judge string, path string, part int, system_prompt string, user_prompt string").coalesce(1)
    answers = jd.call_judge(requests, flaky, retry_delay=0.0, model="m1", temperature=0.5)
    got = {r.project_id: r for r in answers.collect()}
    assert {(r.model, r.temperature) for r in got.values()} == {("m1", 0.5)}
    assert [r.project_id for r in jd.call_judge(requests, flaky, retry_delay=0.0, answered=answers, partitions=2).collect()] == ["c"]
    assert {r.model for r in jd.judge_usage(answers).collect()} == {"m1"}
    several = jd.averaged(jd.parse_responses(spark.createDataFrame([("a", "P", '{"clarity": {"score": %d}}' % n) for n in (10, 40)] + [("a", "P", "x")],
                                                                   "project_id string, judge string, raw string"))).collect()
    assert [(r.project_id, r.clarity_score) for r in several] == [("a", 25.0)]
    assert (got["a"].status, got["a"].retries) == ("success", 0)
    assert (got["b"].status, got["b"].retries) == ("success", 1)
    assert got["c"].status == "error: slow" and got["c"].raw is None and got["c"].retries == 2
    off = jd.call_judge(requests, lambda: None).collect()
    assert {r.status for r in off} == {"unavailable"}


def test_parse_responses(spark):
    raws = ['{"clarity": {"score": 80, "reason": "r"}}', 'text ```{"clarity": {"score": 7.9}}``` end', "none", '{"clarity": {"score": "80"}}',
            '{"clarity": 3}', "{}", '{"a": ', None]
    rows = spark.createDataFrame([(str(i), "P", r) for i, r in enumerate(raws)], "project_id string, judge string, raw string")
    got = {int(r.project_id): (r.parsed, r.clarity_score) for r in jd.parse_responses(rows).collect()}
    assert got == {0: (True, 80.0), 1: (True, 7.9), 2: (False, None), 3: (True, None), 4: (True, None), 5: (False, None),
                   6: (False, None), 7: (False, None)}


def stamped(rows, when):
    return rows.withColumn("arrived", F.lit(when).cast("timestamp"))


def test_streams_follow_the_last_version(spark, tmp_path):
    """A file that changed, one that came again, one that changed and went back."""
    first = frame(spark, FILES + [("q", "s.py", 'password = "abcdefgh1"')])
    changed = frame(spark, [("p", "main.py", "x = 1\n"), ("q", "s.py", "y = 2")])
    back = frame(spark, [("q", "s.py", 'password = "abcdefgh1"')])
    deliveries = [stamped(first, "2024-01-01 00:00:00"), stamped(changed, "2024-01-01 00:20:00"), stamped(changed, "2024-01-01 00:20:00"),
                  stamped(back, "2024-01-01 00:30:00").unionByName(stamped(first.filter("path = 'z.py'"), "2024-01-01 00:30:00"))]
    source, outs = str(tmp_path / "in"), {}
    for rows in deliveries:
        rows.write.mode("append").parquet(source)
        for name, make in (("findings", st.stream_findings), ("signals", st.stream_signals), ("counts", st.stream_counts)):
            stream = make(spark.readStream.schema(rows.schema).parquet(source))
            st.write_stream(stream, str(tmp_path / name), str(tmp_path / f"state-{name}")).awaitTermination()
            outs[name] = spark.read.parquet(str(tmp_path / name))
    now = first.filter("path <> 'main.py'").unionByName(changed.filter("path = 'main.py'"))
    arrived = spark.read.parquet(source)
    assert sorted(st.current_files(arrived).collect()) == sorted(now.collect())
    got = st.current_findings(outs["findings"], outs["signals"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, fd.findings(now, rules=st.FILE_LEVEL_RULES).collect())) and got
    streamed = Audit(st.current_files(arrived), signals=st.newest(outs["signals"])).audits().collect()
    assert sorted(map(str, streamed)) == sorted(map(str, Audit(now).audits().collect()))
    # Each content of a file counts once while the watermark remembers it.
    n = {r.rule_id: r.n for r in outs["counts"].groupBy("rule_id").agg(F.sum("n").alias("n")).collect()}
    assert n["sec_dangerous_functions"] == 3 and n["sec_secrets"] == 1


def test_versions_are_stored_once(spark, tmp_path):
    """Repeats within a delivery, later and late, rows without names, an earlier version that comes last."""
    first = stamped(frame(spark, FILES + [("q", None, "x"), (None, "n.py", None)]), "2024-01-02 00:00:00")
    late = stamped(frame(spark, [("p", "main.py", "old"), ("r", "late.py", "eval(z)")]), "2023-01-01 00:00:00")
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for rows in (first.unionByName(first), first.unionByName(late), late):
        rows.write.mode("append").parquet(source)
        st.store_versions(spark.readStream.schema(rows.schema).parquet(source), out, state).awaitTermination()
    kept = spark.read.parquet(f"{out}/files")
    assert sorted(map(str, kept.select(rows.columns).collect())) == sorted(map(str, first.unionByName(late).collect()))
    now = frame(spark, FILES + [("q", None, "x"), (None, "n.py", None), ("r", "late.py", "eval(z)")])
    assert sorted(map(str, st.current_files(kept).collect())) == sorted(map(str, now.collect()))


def test_streams_do_not_shuffle_texts(spark, tmp_path):
    source = str(tmp_path / "in")
    stamped(frame(spark, FILES), "2024-01-01 00:00:00").write.parquet(source)
    arrivals = spark.readStream.schema("project_id string, path string, content string, arrived timestamp").parquet(source)
    for make in (st.stream_findings, st.stream_signals):
        query = st.write_stream(make(arrivals), str(tmp_path / make.__name__), str(tmp_path / f"state-{make.__name__}"))
        query.awaitTermination()
        plan = query._jsq.explainInternal(True)
        moves = [line for line in plan.split("== Physical Plan ==")[1].split("\n") if "Exchange" in line or "Arguments" in line]
        assert moves and "StreamingDeduplicate" in plan
        below = plan.split("== Physical Plan ==")[1].split("Exchange", 1)[1]
        assert "hits" in below or "n_files" in below  # matched before the exchange


def test_custom_dimension(spark):
    rows = frame(spark, FILES)
    dims = (CustomDimension("Z", "style", (
        CustomRule("z_exec", "exec is used", pattern=r"\bexec\s*\(", penalty=30),
        CustomRule("z_name", "file is called z", "info", condition="startswith(path, 'z')", penalty=5)), weight=0.5),)
    found = {(r.rule_id, r.location, r.severity) for r in custom_findings(rows, dims).collect()}
    assert found == {("z_exec", "main.py:2", "warning"), ("z_name", "z.py", "info")}
    audit = Audit(rows)
    table = {r.project_id: r for r in with_custom_dimensions(rows, audit.score_table, dims, audit.config).collect()}
    assert (table["p"].Z, table["q"].Z) == (65, 100)
    plain = {r.project_id: r for r in audit.score_table.collect()}
    p = plain["p"]
    weights = cat.DIMENSION_WEIGHTS
    assert table["p"].overall == int((sum(p[d] * weights[d] for d in cat.DIMENSIONS) + 65 * 0.5) / (sum(weights.values()) + 0.5))


def test_own_line_fixer(spark):
    own = (("sec_dangerous_functions", lambda line: f"concat('# ', {line})", "comment it out", "suggested"),)
    got = {r.file_path: r.replacement for r in fx.patches(frame(spark, FILES), "suggested", line_fixers=own).filter("file_path = 'z.py'").collect()}
    assert got == {"z.py": "# x = eval(c)"}


def test_exact_tokens(spark):
    rows = cl.exact_token_counts(frame(spark, FILES + [("q", "n.bin", "x")]), lambda: str.split)
    assert {(r.project_id, r.path, r.tokens) for r in rows.collect()} == {("p", "main.py", 2), ("p", "z.py", 3), ("q", "m.md", 1)}


def _exchanged(df):
    """Columns that each exchange of the plan moves."""
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return [b for b in out.getvalue().split("\n\n") if ") Exchange" in b.split("\n")[0]]


def _plan(df):
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_text_is_not_shuffled(spark, tmp_path):
    frame(spark, FILES).repartition(3).write.parquet(str(tmp_path / "f"))
    files = src.files_from_table(spark.read.parquet(str(tmp_path / "f")), "project_id", "path", "content")
    for df in (Audit(files).audits(), Audit(files).findings(), Audit(files).patched_files("suggested"), rp.sarif_documents(Audit(files).findings())):
        moves = _exchanged(df)
        assert moves and not any("text#" in m or "content#" in m for m in moves)


def test_findings_read_the_text_few_times(spark, tmp_path):
    frame(spark, FILES).write.parquet(str(tmp_path / "f"))
    audit = Audit(spark.read.parquet(str(tmp_path / "f")))
    for df, most in ((audit.findings(), 5), (rp.sarif_documents(audit.findings()), 5), (audit.audits(), 2), (audit.manifests(), 1)):
        assert sum(") Scan parquet" in part.split("\n")[0] for part in _plan(df).split("\n\n")) <= most


def test_planning_starts_no_job(spark):
    """Building a table runs nothing, but for what streams, lists folders or stores."""
    from folioscan.workloads.queries import QUERIES

    runs = {n for n in QUERIES if n.startswith("stream_")} | {"stored_other_config"}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    small = "/root/testdata/sf0.001"
    spark.read.parquet(f"{small}/documents.parquet")
    started = {}
    for name in ("overall", "findings", "sarif_documents", "json_reports", "judge_blend", "judged_audit", "incremental", "patched_files",
                 "reaudit_patched", "evidence", "single_file_scores", "files_from_table", "duplicate_lines", "error_audits"):
        before = jobs()
        df = QUERIES[name](spark, small)
        reading = len(df.inputFiles())  # reading a footer for a schema is a job of Spark's own
        started[name] = jobs() - before
        assert name not in runs and reading and started[name] <= 6, started


def test_report_carries_configuration_and_time(spark):
    audit = Audit(frame(spark, FILES))
    row = rp.json_reports(audit.audits(nested=True), audit.config, "2024-01-02 03:04:05").first()
    report = json.loads(row.report)
    assert report["audit_timestamp"].startswith("2024-01-02T03:04:05")
    assert json.loads(report["config_snapshot"])["dimensions"]["S"]["weight"] == 0.25


def test_single_files(spark):
    rows = frame(spark, [("x", "README.md", "You are an expert"), ("x", "tool.py", "eval(a)"), ("x", "requirements.txt", "flask")])
    audit = Audit(rows, single=True)
    got = {r.project_id.path: r for r in audit.score_table.collect()}
    assert {p: r.skill_type for p, r in got.items()} == {"README.md": "prompt", "tool.py": "unknown", "requirements.txt": "prompt"}
    assert got["README.md"].X_documentation == 60 and got["requirements.txt"].S_dependencies == 70
    assert got["tool.py"].S_dangerous == 100 and got["tool.py"].P == 0 and got["tool.py"].estimated_total_tokens == 2
    rules = {(r.project_id.path, r.rule_id) for r in audit.findings().collect()}
    assert ("tool.py", "prompt_missing") in rules and not any(r == "sec_dependencies" for _, r in rules)
    shared = frame(spark, [("a", "README.md", "x"), ("b", "README.md", "y"), ("b", "m.py", "z")])
    assert {(*r.project_id, r.n_files) for r in Audit(shared, single=True).score_table.collect()} == {
        ("a", "README.md", 1), ("b", "README.md", 1), ("b", "m.py", 1)}
