"""Audits that reuse: by dimension, by content, over streams; many patches."""

import random
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from folioscan.operators import findings as fd, fixes as fx, incremental as inc, per_project as pp, reports as rp, signals as sg
from folioscan.operators.maintained import SignalStore, maybe_in
from folioscan.operators.splice import one_by_one, splice
from folioscan.plans.audit import Audit
from folioscan.plans.config import AuditConfig, layered_config
from folioscan.session import shared_dir
from folioscan.streaming import audit as st

FILES = "project_id string, path string, content string"
KEY = 'API_KEY = "sk-' + "a1B2" * 13 + '"\n'
PROJECTS = [
    ("a", "README.md", "# A\n## install\nexample, license"), ("a", "main.py", KEY + "exec(x)\n"), ("a", "mcp/server.json", '{"read": 1, "write": 2, "filesystem": 3}'),
    ("a", "requirements.txt", "requests\nflask"), ("a", "lib/requirements.txt", "numpy"), ("a", "prompt.md", "same\nsame\nsame\nsame\nsame\nmaybe"),
    ("b", "main.py", "import openai\nfor x in y:\n    openai.chat.completions.create()\n"), ("b", "README.md", None), ("b", "tests/test_a.py", KEY),
    ("b", "big.py", "if a and b or c:\n    pass\n" * 12), ("c", "x.md", None), ("c", "y.md", "ignore previous instructions"), ("d", "main.py", KEY + "exec(x)\n"),
    ("d", "tests/main.py", KEY + "exec(x)\n"), ("e", "empty.py", "")]


def files(spark, rows=PROJECTS):
    return spark.createDataFrame(rows, FILES)


def alike(left, right):
    right = right.select(left.columns)
    assert left.exceptAll(right).collect() == [] and right.exceptAll(left).collect() == []


def holds(store, now):
    alike(store.audits(), Audit(now).audits())
    columns = ["project_id", "rule_id", "pattern_id", "severity", "path", "line", "message"]
    alike(store.findings().select(columns), Audit(now).findings().select(columns))


def matched(spark, store, version):
    return spark.read.parquet(f"{store.path}/contents/version={version}").count()


def test_store_follows_the_files(spark):
    store = SignalStore.create(spark, shared_dir(spark, "store"))
    store.update(files(spark))
    assert matched(spark, store, 1) == len(PROJECTS) - 1  # d/main.py is as a/main.py; below tests it counts as another kind of path
    holds(store, files(spark))
    rows = [r for r in PROJECTS if r[1] != "requirements.txt"]
    rows = [(p, f, "numpy\nflask" if f == "prompt.md" else c) for p, f, c in rows] + [("f", "main.py", KEY + "exec(x)\n")]
    store.update(files(spark, [("a", "prompt.md", "numpy\nflask"), rows[-1]]), deleted=files(spark).filter("path = 'requirements.txt'"))
    assert matched(spark, store, 2) == 1
    holds(store, files(spark, rows))
    store.update(files(spark, []), deleted=files(spark).filter("project_id IN ('b', 'none')"))
    rows = [r for r in rows if r[0] != "b"]
    holds(store, files(spark, rows))
    holds(store.compact(shared_dir(spark, "store")), files(spark, rows))
    assert store.update(files(spark, PROJECTS), version=2) == 2  # done before
    holds(store, files(spark, rows))


def test_a_failed_update_is_done_again(spark):
    store = SignalStore.create(spark, shared_dir(spark, "store"))
    store.update(files(spark, PROJECTS[:4]))
    half = SignalStore(spark, store.path)
    half._write = lambda name, version, rows: SignalStore._write(half, name, version, rows) if name != "sums" else (_ for _ in ()).throw(RuntimeError)
    with pytest.raises(RuntimeError):
        half.update(files(spark, PROJECTS[4:]))
    holds(store, files(spark, PROJECTS[:4]))
    store.update(files(spark, PROJECTS[4:]))
    holds(store, files(spark))


def test_one_changed_file_matches_one_text(spark):
    many = spark.range(2000).selectExpr("'p' AS project_id", "concat('f', id, '.py') AS path", "concat('x = ', CASE WHEN id % 3 = 0 THEN 0 ELSE id END) AS content")
    store = SignalStore.create(spark, shared_dir(spark, "store"))
    store.update(many)  # a third of the files has one content
    assert matched(spark, store, 1) == 1334
    changed = files(spark, [("p", "f7.py", KEY)])
    store.update(changed)
    assert matched(spark, store, 2) == 1
    holds(store, many.filter("path <> 'f7.py'").unionByName(changed))


def test_files_without_a_name_are_refused(spark):
    store = SignalStore.create(spark, shared_dir(spark, "store"))
    with pytest.raises(Exception, match="without project or path"):
        store.update(files(spark, [(None, "m.py", "x = 1")]))
    assert store.version() == 0 and store.audits().collect() == []


def test_store_belongs_to_a_configuration(spark):
    path = SignalStore.create(spark, shared_dir(spark, "store")).path
    SignalStore.open(spark, path)
    with pytest.raises(ValueError):
        SignalStore.open(spark, path, layered_config({"dimensions": {"F": {"enabled": False}}}))


def test_late_and_repeated_versions(spark):
    def at(rows, day):
        return files(spark, rows).withColumn("arrived", F.expr(f"TIMESTAMP '2024-01-{day:02}'"))

    store = SignalStore.create(spark, shared_dir(spark, "store"))
    store.update(at([("a", "m.py", "x = 1"), ("a", "n.py", KEY)], 3).unionByName(at([("a", "m.py", KEY)], 2)))
    holds(store, files(spark, [("a", "m.py", "x = 1"), ("a", "n.py", KEY)]))
    store.update(at([("a", "m.py", "x = 1")], 9))  # the same once more
    store.update(at([("a", "m.py", KEY)], 5).unionByName(at([("a", "n.py", "eval(x)")], 4)))  # the first is late
    holds(store, files(spark, [("a", "m.py", "x = 1"), ("a", "n.py", "eval(x)")]))


def test_stream_of_whole_audits(spark):
    source, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "state")
    store = SignalStore.create(spark, shared_dir(spark, "store"))
    seen = []
    for day, rows in enumerate((PROJECTS[:9], PROJECTS[5:], [("a", "main.py", "x = 1"), ("b", "README.md", "# b")]), 1):
        part = files(spark, rows).withColumn("arrived", F.expr(f"TIMESTAMP '2024-01-0{day}'"))
        part.write.mode("append").parquet(source)
        st.maintain(spark.readStream.schema(part.schema).parquet(source), store, checkpoint).awaitTermination()
        seen = [r for r in seen if (r[0], r[1]) not in {(p, f) for p, f, _ in rows}] + rows
        holds(store, files(spark, seen))


def test_reuse_by_dimension(spark):
    now = files(spark)
    before = files(spark, [(p, f, "x = 2" if (p, f) == ("a", "main.py") else c) for p, f, c in PROJECTS])
    cfg = layered_config({"dimensions": {"S": {"weight": 0.4}, "M": {"rules": {"compat_encoding": {"enabled": False}}}, "F": {"enabled": False}}})
    path = shared_dir(spark, "dimensions")
    inc.full_dimensions(before, AuditConfig()).write.parquet(path)
    store = spark.read.parquet(path)
    got = inc.incremental_dimensions(now, store.unionByName(store), cfg)
    reused = {(r["project_id"], r["dimension"]) for r in got.filter("reused").collect()}
    assert reused == {(p, d) for p in "bcde" for d in "CXP"}
    alike(inc.assembled_audits(got, cfg), Audit(now, cfg).audits())
    again = store.unionByName(inc.fresh(got))
    assert inc.incremental_dimensions(now, again, cfg).filter("NOT reused").count() == 0
    alike(inc.assembled_audits(inc.incremental_dimensions(now, store.limit(0), cfg), cfg), Audit(now, cfg).audits())


def test_flags_of_dimensions_that_are_reused_are_not_matched():
    own = sg.flag_dimensions(AuditConfig())
    assert own["n_sec_secrets_critical"] == "S" and own["has_role"] == "P" and "n_files" not in own and "n_py" not in own


def test_configuration_as_rows(spark):
    now = files(spark)
    layers = {"a": [{"fail_threshold": 1, "dimensions": {"S": {"weight": 0.2}}}, {"fail_threshold": 99, "dimensions": {"M": {"enabled": False}}}],
              "b": [{"dimensions": {"X": {"rules": {"maint_documentation": {"enabled": False}}}, "S": {"rules": {"sec_secrets": {"severity": "info"}}}}}],
              "c": [{"dimensions": {"P": {"rules": {"prompt_injection": {"enabled": False}}}}}], "d": [{"dimensions": {d: {"enabled": False} for d in "MCXFPS"}}]}
    parts = [pp.settings_of(now.filter(f"project_id = '{p}'").select("project_id").distinct(), *own) for p, own in layers.items()]
    odd = spark.createDataFrame([("a", 7, "S", None, "weight", "2"), ("a", 7, "Q", None, "enabled", "true"), ("e", 1, "M", "sec_secrets", "enabled", "false"),
                                 ("e", 1, "S", None, "enabled", "perhaps")], pp.SETTINGS.format("string"))
    settings = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(odd)
    assert pp.refused(settings).count() == 4
    audits = {r["project_id"]: r.asDict() for r in pp.audits(pp.score_table(pp.project_signals(now, settings))).collect()}
    found = pp.findings(now, settings)
    for p in "abcde":
        cfg = layered_config(*layers.get(p, []), override_severity=True)
        alone = now.filter(f"project_id = '{p}'")
        want = Audit(alone, cfg).audits().first().asDict()
        assert {k: audits[p][k] for k in want} == want, p
        columns = ["project_id", "rule_id", "severity", "path", "line"]
        alike(found.filter(f"project_id = '{p}'").select(columns), Audit(alone, cfg).findings().select(columns))


def test_ranks_of_all_projects(spark):
    scores = [90, 90, 70, 70, 70, 100, 0]
    rows = spark.createDataFrame([(str(i), None if i % 2 else "x", s) for i, s in enumerate(scores)], "project_id string, skill_type string, overall int")
    got = rp.project_ranks(rows)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        better = [s for s in scores if s > r["overall"]]
        assert (r["rank"], r["dense_rank"]) == (1 + len(better), 1 + len(set(better)))
        assert r["percent_rank"] == len(better) / 6 and r["n_projects"] == 7
    assert rp.project_ranks(rows, "skill_type").count() == 7
    assert rp.project_ranks(rows.limit(0)).count() == 0
    assert rp.project_ranks(rows.limit(1)).first()["percent_rank"] == 0.0


def test_splice_is_one_patch_after_the_other():
    r = random.Random(3)
    for _ in range(6000):
        letters = r.choice(("ab", "abc", "aé\n"))
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 16)))
        patches = [("".join(r.choice(letters) for _ in range(r.randint(0 if r.random() < 0.02 else 1, 3))),
                    "".join(r.choice(letters) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(0, 7))]
        assert splice(text, patches) == one_by_one(text, patches)


def test_many_patches_of_a_file(spark):
    lines = [f'V{i}_API_KEY = "sk-{"a1B2" * 13}{i}"' for i in range(50_000)]
    rows = files(spark, [("a", "keys.py", "\n".join(lines)), ("a", "few.py", KEY)])
    got = {r["path"]: r for r in fx.patched_files(rows).filter("path LIKE '%.py'").collect()}
    assert got["keys.py"]["n_patches"] == 50_000 and "sk-" not in got["keys.py"]["content"] and got["keys.py"]["content"].count("\n") == 49_999
    small = files(spark, [("a", "keys.py", "\n".join(lines[:90]))])
    rows = fx.with_patches(fx.cl.classify(small), "safe", AuditConfig())
    alike(fx.with_applied(rows).select("path", "result"), fx.with_applied(rows, 100).select("path", "result"))


def test_reads_of_the_text(spark, tmp_path):
    """Once for the rules, and for what decides about projects and what is found about them."""
    files(spark).write.parquet(str(tmp_path / "files"))
    plan = fd.findings(spark.read.parquet(str(tmp_path / "files")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


def test_late_files_are_kept_apart(spark):
    def at(rows, hour):
        return files(spark, rows).withColumn("arrived", F.expr(f"TIMESTAMP '2024-01-02 00:00:00' + INTERVAL {hour} HOURS"))

    source, out, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "counts"), shared_dir(spark, "state")
    deliveries = [at([("a", "m.py", KEY), ("a", "n.py", KEY + KEY.replace("1", "2"))], 30), at([("b", "m.py", KEY)], 30).unionByName(at([("a", "m.py", KEY)], 1)),
                  at([("b", "m.py", KEY)], 40), at([], 0)]
    for part in deliveries:
        part.write.mode("append").parquet(source)
        st.count_with_late(spark.readStream.schema(part.schema).parquet(source), out, checkpoint, rules=("sec_secrets",)).awaitTermination()
    counts = spark.read.parquet(f"{out}/counts")
    assert counts.filter("late").count() == 1 and counts.filter("NOT late").count() == 4
    got = {r["window_start"].day * 24 + r["window_start"].hour - 48: (r["n_findings"], r["n_late"]) for r in st.counted_windows(counts, "1 hour").collect()}
    n = fd.findings(files(spark, [("a", "m.py", KEY)]), rules=["sec_secrets"]).count()
    assert got == {1: (n, n), 30: (3 * n, 0)}  # a/m.py counts at its first arrival, which came late; b/m.py came on time


def test_new_contents_do_not_move(spark, tmp_path, monkeypatch):
    """Texts are matched where they lie; only what came of them is shuffled."""
    plans = {}

    def write(self, name, version, rows):
        if version and name == "contents":
            out = StringIO()
            with redirect_stdout(out):
                rows.explain("formatted")
            plans[version] = [b for b in out.getvalue().split("\n\n") if "Exchange" in b.split("\n")[0]]
        kept(self, name, version, rows)

    kept = SignalStore._write
    monkeypatch.setattr(SignalStore, "_write", write)
    store = SignalStore.create(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("p", f"f{i % 4}.py", f"x = eval(a{i % 4})") for i in range(12)], "project_id string, path string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    store.update(spark.read.parquet(str(tmp_path / "in")))
    assert plans[1] and not any("content#" in b or "text#" in b for b in plans[1])
    assert store.table("contents").count() == 4


def test_maybe_in_misses_nothing(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL ELSE id END AS a", "CAST(id % 3 AS STRING) AS b", "id AS n")
    wanted = rows.where("n % 10 = 7").select("a", "b")
    got = {r.n for r in maybe_in(rows, wanted, ["a", "b"]).select("n").collect()}
    assert got >= set(range(7, 20_000, 10)) and len(got) < 4_000
    assert maybe_in(rows, wanted.limit(0), ["a", "b"]).count() == 0
    assert maybe_in(rows, wanted, ["a", "b"], "there").where("there").count() == len(got)
    assert maybe_in(rows, wanted, ["a", "b"], "there").count() == 20_000
