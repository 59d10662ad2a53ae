"""Golden values, worked out by hand, on small projects."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import classify as cl, findings as fd, fixes as fx, incremental as inc, scores as sc, signals as sg
from folioscan.plans.audit import Audit, run
from folioscan.plans.config import AuditConfig, DimensionConfig, RuleConfig, layered_config, merge_layers
from folioscan.rules import catalog as cat

KEY = "sk-" + "a1B2c" * 10 + "xyz"

PROJECTS = {
    "missing": {"main.py": " \n"},
    "good_prompt": {"prompt.md": "你是一名专家\n请分步骤\n1. 阅读\n2. 输出 JSON 格式\n"},
    "injection": {"main.py": 'prompt = f"Sort this mail: {user_input}"'},
    "secret": {"main.py": f'api_key = "{KEY}"'},
    "eval": {"main.py": "total = eval(cell)"},
    "hardcoded": {"main.py": "temperature = 0.25"},
    "good_readme": {"README.md": "# T\ninstall it\nexample\n" + "text " * 50},
    "bare_except": {"main.py": "try:\n    send()\nexcept:\n    stop()"},
    "vendor": {"main.py": 'llm.chat.completions.create(model=NAME, functions=specs)'},
    "unreadable": {"main.py": None, "README.md": "# x"},
    "mcp": {"mcp.json": '{"filesystem": ["read", "write"]}', "a.md": "x"},
    "split_mcp": {"a.json": '{"x": "m', "b.json": 'cp"}', "c.md": "x"},
    "empty_name": {"docs/.gitignore": "x", "LICENSE": "y"},
}

EXPECTED = {
    ("missing", "P"): 0, ("missing", "P_clarity"): 0, ("good_prompt", "P"): 100, ("good_prompt", "P_clarity"): 100,
    ("injection", "P_injection"): 30, ("injection", "P_token"): 100, ("injection", "P_clarity"): 55,
    ("injection", "P_specificity"): 100, ("injection", "P"): 64,
    ("secret", "S_secrets"): 40, ("secret", "S_dependencies"): 70, ("secret", "S"): 80,
    ("eval", "S_dangerous"): 80, ("eval", "S"): 91, ("hardcoded", "S_hardcoded_config"): 90, ("hardcoded", "S"): 94,
    ("eval", "X_documentation"): 60, ("eval", "X_tests"): 50, ("eval", "X_versioning"): 55, ("eval", "X"): 68,
    ("good_readme", "X_documentation"): 95, ("bare_except", "C_error_handling"): 85, ("bare_except", "C"): 96,
    ("vendor", "M_vendor_lock"): 85, ("vendor", "M"): 94, ("unreadable", "P"): 0, ("mcp", "S_mcp"): 75, ("mcp", "M_protocol"): 75,
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, path, text) for p, fs in PROJECTS.items() for path, text in fs.items()]
    return spark.createDataFrame(rows, "project_id string, path string, content string").cache()


@pytest.fixture(scope="module")
def scores(files):
    return {r.project_id: r.asDict() for r in Audit(files).score_table.collect()}


def test_first_configuration_files(files, spark):
    """All configuration files tell the skill type, or the first few as one text."""
    def types(n):
        return {r.project_id: r.skill_type for r in Audit(files.unionByName(more), first_configs=n).score_table.collect()}

    more = spark.createDataFrame([("late_mcp", f"{c}.json", "{}" if c < "d" else '{"mcp": 1}') for c in "abcd"], files.schema)
    assert types(None)["late_mcp"] == "mcp" != types(3)["late_mcp"]
    assert types(3)["split_mcp"] == "mcp" != types(None)["split_mcp"]  # the word straddles two files


def test_scores(scores):
    for (project, column), value in EXPECTED.items():
        assert scores[project][column] == value, (project, column)
    assert scores["mcp"]["skill_type"] == "mcp"
    assert scores["empty_name"]["gitignore_exists"] and scores["empty_name"]["n_code"] == 0


def test_failed_dimension_weighs_one(files, scores):
    row = scores["unreadable"]
    assert row["P_failed"] and row["P_injection"] is None
    weights = {d: 1.0 if d == "P" else cat.DIMENSION_WEIGHTS[d] for d in cat.DIMENSIONS}
    total = sum(row[d] * weights[d] for d in cat.DIMENSIONS)
    assert row["overall"] == int(total / sum(weights.values()))
    errors = sc.errors(Audit(files).score_table, AuditConfig()).collect()
    assert [(e.project_id, e.dimension, e.severity) for e in errors] == [("unreadable", "P", "critical")]


def test_findings(files):
    found = Audit(files).findings().collect()
    by = {}
    for f in found:
        by.setdefault((f.project_id, f.rule_id), []).append(f)
    secrets = sorted(by["secret", "sec_secrets"], key=lambda f: f.pattern_rank)
    assert [(f.pattern_id, f.severity, f.location) for f in secrets] == [
        ("openai_api_key", "critical", "main.py:1"), ("generic_api_key", "critical", "main.py:1")]
    assert KEY[:20] in secrets[0].message and KEY[:21] not in secrets[0].message
    assert len(by["missing", "prompt_missing"]) == 1
    assert by["injection", "prompt_injection"][0].line == 1
    assert by["mcp", "sec_mcp_permissions"][0].path == "mcp.json"
    assert ("unreadable", "prompt_injection") not in by
    assert by["hardcoded", "sec_hardcoded_config"][0].message.endswith("temperature = 0.25")


def test_counts_equal_findings(files):
    """Severity counts come from the signals, not from the findings."""
    audits = {r.project_id: (r.n_critical, r.n_warning, r.n_info) for r in Audit(files).audits().collect()}
    found = Audit(files).findings().groupBy("project_id").pivot("severity", list(cat.SEVERITIES)).count().na.fill(0).collect()
    assert audits == {r[0]: tuple(r[1:]) for r in found}


def test_partitioning_does_not_matter(files):
    def rows(df):
        return sorted(Audit(df).findings().collect()), sorted(map(str, Audit(df).audits().collect()))
    assert rows(files) == rows(files.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(4)))


def test_stored_signals_give_the_same(files, tmp_path):
    stored = run(files, str(tmp_path))
    assert sorted(stored.findings().collect()) == sorted(Audit(files).findings().collect())
    assert sorted(map(str, stored.audits().collect())) == sorted(map(str, Audit(files).audits().collect()))


def test_stored_signals_of_another_configuration(files, tmp_path):
    """Rules that are off find nothing in stored hits; rules that were off are refused."""
    off = layered_config({"dimensions": {"S": {"rules": {"sec_secrets": {"enabled": False}}}}})
    stored = Audit(files).store_signals(str(tmp_path / "all"))
    got = Audit(files, off, stored.signals).findings().collect()
    assert sorted(got) == sorted(Audit(files, off).findings().collect()) and not any(f.rule_id == "sec_secrets" for f in got)
    less = Audit(files, off).store_signals(str(tmp_path / "less"))
    with pytest.raises(ValueError, match="n_sec_secrets"):
        Audit(files, AuditConfig(), less.signals)
    with pytest.raises(ValueError, match="sec_secrets"):
        fd.findings(files, AuditConfig(), hits=less.signals.select("project_id", "path", "hits"))


def test_lone_unreadable_readme(spark):
    rows = spark.createDataFrame([("p", "README.md", None), ("q", "README.md", "x")], "project_id string, path string, content string")
    audit = Audit(rows, single=True)
    counts = {r.project_id.project_id: (r.n_critical, r.n_warning, r.n_info) for r in audit.audits().collect()}
    found = [(f.project_id.project_id, f.severity) for f in audit.findings().collect()]
    assert {p: tuple(sum(f == (p, s) for f in found) for s in cat.SEVERITIES) for p in counts} == counts and len(found) > 3


def test_judged_audit(files, spark):
    answers = spark.createDataFrame([
        ("eval", "P", '{"clarity": {"score": 10, "reason": "vague"}, "injection_risk": {"score": 50, "vulnerable_lines": ["a", "b"]}}', "success"),
        ("eval", "C", '{"hallucination_risk": {"score": 0}}', "success"), ("secret", "P", "no answer", "success")],
        "project_id string, judge string, raw string, status string")
    plain, judged = Audit(files), Audit(files, judged=answers)
    before = {r.project_id: r for r in plain.audits().collect()}
    after = {r.project_id: r for r in judged.audits(nested=True).collect()}
    assert {p for p in before if before[p].overall != after[p].overall or before[p].n_warning != after[p].n_warning} == {"eval"}
    row = after["eval"]
    assert (row.n_warning, row.n_info) == (before["eval"].n_warning + 2, before["eval"].n_info + 1)
    subs = row.dimension_scores["P"].sub_scores
    assert subs["clarity_ai"] == 10 and subs["injection_risk"] == int(0.6 * 100 + 0.4 * 50) and row.P == int(sum(subs.values()) / len(subs))
    found = judged.findings().groupBy("project_id").pivot("severity", list(cat.SEVERITIES)).count().na.fill(0).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {p: (r.n_critical, r.n_warning, r.n_info) for p, r in after.items()}
    assert f"{row.n_warning} warning" in row.summary


LINES = ["for x in y:", "  for z in w:", "while True:", "    openai.call()", "  openai.call()", "openai.call()", "", "# openai",
         "  # for a in b:", "    pass", "  x = anthropic.y", "forx in y:", "\tr.invoke(1)", "for a: openai"]


def loop_by_hand(text):
    """Brute force: a call counts if some header above it, with no shallower or
    equal line and no other header in between, is less indented."""
    body = [(len(l) - len(l.lstrip()), l) for l in text.splitlines() if l.strip() and not l.strip().startswith("#")]
    import re
    heads = [bool(re.match(r"(for|while)\s+.+:", l.strip())) for _, l in body]
    for i, (_, line) in enumerate(body):
        if heads[i] or not any(w in line for w in cat.LOOP_API_WORDS):
            continue
        above = [j for j in range(i) if heads[j]]
        if above and all(body[j][0] > body[above[-1]][0] for j in range(above[-1] + 1, i + 1)):
            return True
    return False


def test_loop_calls(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(str(i), "a.py", t) for i, t in enumerate(texts)], "project_id string, path string, content string")
    got = sg.readable(cl.classify(rows)).selectExpr("content", f"{sg.calls_api_in_loop()} AS hit").collect()
    for r in got:
        assert r.hit == loop_by_hand(r.content), r.content


def test_line_fixes(spark):
    lines = {
        'openai_api_key = "abc"': 'openai_api_key = os.environ.get("OPENAI_API_KEY", "")',
        "a_token='x'; name = 'y'; B_SECRET = \"z\" # t": 'a_token = os.environ.get("A_TOKEN", ""); name = \'y\'; B_SECRET = os.environ.get("B_SECRET", "") # t',
        'password = "abc"': 'password = "abc"', "": "",
    }
    got = spark.createDataFrame([(l,) for l in lines], "l string").selectExpr("l", f"{fx.fix_secret('l')} AS r").collect()
    assert {r.l: r.r for r in got} == lines
    lines = {
        "x = eval(a) + eval(b)": "x = ast.literal_eval(a) + ast.literal_eval(b)",
        "ast.literal_eval(a)": "ast.literal_eval(a)",
        "os.system(f(cmd))": "subprocess.run(f(cmd), shell=True, check=True)",
        "os.system()": "os.system()", "pickle.load(f)": "pickle.load(f)",
    }
    got = spark.createDataFrame([(l,) for l in lines], "l string").selectExpr("l", f"{fx.fix_dangerous('l')} AS r").collect()
    assert {r.l: r.r for r in got} == lines


def test_patches(files, spark):
    safe = {(r.project_id, r.file_path): r for r in fx.patches(files, "safe").collect()}
    assert safe["secret", "main.py"].replacement == 'api_key = os.environ.get("API_KEY", "")'
    assert safe["eval", ".gitignore"].original == ""
    assert ("eval", "main.py") not in safe
    assert fx.patches(files, "none").count() == 0
    assert ("eval", "main.py") in {(r.project_id, r.file_path) for r in fx.patches(files, "suggested").collect()}
    done = {(r.project_id, r.path): r.content for r in fx.patched_files(files, "suggested").collect()}
    assert done["eval", "main.py"] == "total = ast.literal_eval(cell)"
    assert done["good_readme", "README.md"] == PROJECTS["good_readme"]["README.md"]
    with pytest.raises(ValueError):
        fx.patches(files, "everything")


def test_patch_replaces_first_occurrence(spark):
    text = f'# k_key = "{KEY}" here\nk_key = "{KEY}"\nk_key = "{KEY}"\n'
    rows = spark.createDataFrame([("p", "m.py", text)], "project_id string, path string, content string")
    got = {r.path: r.content for r in fx.patched_files(rows, "safe").collect()}
    want = text
    for line in dict.fromkeys(text.splitlines()):
        want = want.replace(line, line.replace(f'k_key = "{KEY}"', 'k_key = os.environ.get("K_KEY", "")'), 1)
    assert got["m.py"] == want


def test_config_layers(files):
    base = {"dimensions": {"P": {"weight": 0.2}}}
    merged = merge_layers(base, {"dimensions": {"P": {"enabled": False}}, "x": 1})
    assert merged == {"dimensions": {"P": {"weight": 0.2, "enabled": False}}, "x": 1}
    assert base == {"dimensions": {"P": {"weight": 0.2}}}
    cfg = layered_config({"dimensions": {"S": {"rules": {"sec_secrets": {"enabled": False}}}}}, {"fail_threshold": 85})
    rows = {r.project_id: r for r in Audit(files, cfg).audits().collect()}
    table = {r.project_id: r for r in Audit(files, cfg).score_table.collect()}
    assert table["secret"].S_secrets is None and table["secret"].S == 95
    assert rows["secret"].passed == (rows["secret"].overall >= 85)
    assert cfg.digest() != AuditConfig().digest()
    with pytest.raises(ValueError):
        DimensionConfig(weight=1.5)
    with pytest.raises(ValueError):
        RuleConfig(severity="fatal")


def test_layers_from_files(tmp_path):
    from folioscan.plans.config import load_layer, preset

    (tmp_path / "own.json").write_text('{"fail_threshold": 55, "dimensions": {"P": {"weight": 0.1}}}')
    cfg = layered_config(preset("lean"), load_layer(str(tmp_path / "own.json")))
    assert cfg.fail_threshold == 55 and cfg.weight("P") == 0.1 and not cfg.runs("prompt_specificity")


def test_two_dimensions_make_a_weighted_mean(spark):
    cfg = AuditConfig({"M": DimensionConfig(weight=0.5), "C": DimensionConfig(weight=0.5)})
    row = spark.sql(f"SELECT {sc.overall_score(cfg)} AS o FROM (SELECT 80 AS M, 60 AS C, false AS M_failed, false AS C_failed)").first()
    assert row.o == 70


def test_hashes_and_incremental(files, spark):
    cfg = AuditConfig()
    changed = files.withColumn("content", F.when(F.col("project_id") == "eval", F.lit("x = 1")).otherwise(F.col("content")))
    store = inc.full_audit(files, cfg).cache()
    rows = {r.project_id: r for r in inc.incremental_audit(changed, store, cfg).collect()}
    assert {p for p, r in rows.items() if not r.reused} == {"eval"}
    fresh = {r.project_id: r.overall for r in inc.full_audit(changed, cfg).collect()}
    assert {p: r.overall for p, r in rows.items()} == fresh
    other = layered_config({"fail_threshold": 1})
    assert not any(r.reused for r in inc.incremental_audit(files, store, other).collect())
    twice = {r.project_id for r in inc.incremental_audit(changed, store.unionByName(store), cfg).collect()}
    audited = inc.incremental_audit(changed, store.unionByName(store), cfg)
    assert audited.count() == len(twice) and {r.project_id for r in inc.fresh(audited).collect()} == {"eval"}
    dated = store.withColumn("n", F.lit(1)).unionByName(store.withColumn("n", F.lit(2)).withColumn("overall", F.lit(-1)))
    assert {r.overall for r in inc.newest(dated, "n").collect()} == {-1}
    renamed = files.withColumn("path", F.concat(F.lit("x/"), "path"))
    assert not {r.project_hash for r in inc.project_hashes(files).collect()} & {r.project_hash for r in inc.project_hashes(renamed).collect()}


def test_one_project_with_most_files(spark):
    """A project holding nearly all rows gives the same as its parts say."""
    n = 2000
    rows = spark.range(n).selectExpr(
        "CASE WHEN id % 20 = 0 THEN concat('p', id) ELSE 'hot' END AS project_id", "concat('src/f', id, '.py') AS path",
        "'x = eval(a)\\nsame line' AS content")
    hot = {r.project_id: r for r in sc.score_table(sg.project_signals(rows, AuditConfig()), AuditConfig()).collect()}["hot"]
    assert hot.n_files == n - n // 20 == hot.n_sec_dangerous_functions_warning
    assert hot.n_duplicates == 2 * hot.n_files - 2
