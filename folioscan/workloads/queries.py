"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.operators import (
    classify as cl, evidence as ev, findings as fd, fixes as fx, incremental as inc, judges as jd, per_project as pp, reports as rp,
    scores as sc,
)
from folioscan.operators.maintained import SignalStore
from folioscan.operators.custom import CustomDimension, CustomRule, custom_findings, with_custom_dimensions
from folioscan.plans.audit import Audit
from folioscan.plans.config import AuditConfig, layered_config, preset
from folioscan.rules import catalog as cat
from folioscan.session import shared_dir
from folioscan.sources.files import files_from_table
from folioscan.sources.tree_source import ProjectTree
from folioscan.streaming import audit as st
from folioscan.workloads import corpus

Query = Callable[[SparkSession, str], DataFrame]

DEFAULT = AuditConfig()

# A preset and a user layer: rules and a dimension off, other weights, another severity.
PRESET_LAYER = preset("lean")
USER_LAYER = {"fail_threshold": 85, "dimensions": {"F": {"enabled": False}, "S": {"weight": 0.4}}}
CONFIGURED = layered_config(PRESET_LAYER, USER_LAYER, override_severity=True)

# A dimension of one's own.
STYLE = CustomDimension("Z", "style", (
    CustomRule("z_import", "names a module", pattern=r"\bimport\s+\w+", penalty=3),
    CustomRule("z_source", "lies below src", "info", scope="kind = 'code'", condition="startswith(path, 'src/')", penalty=5)), weight=0.1)

FINDING_COLUMNS = ("project_id", "rule_id", "pattern_id", "severity", "path", "line", "location", "message")
# Every project of the seeded corpus has prompt text.
FOUND_RULES = tuple(dict.fromkeys(r["rule_id"] for r in cat.rows() if r["rule_id"] != "prompt_missing"))
FIND_RULES_ON_CONVERSATIONS = ("prompt_missing", "maint_documentation", "maint_tests", "compat_protocol")


def _wide(df: DataFrame) -> DataFrame:
    """INT as BIGINT and lists as text, so that engines agree on types."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("int", "smallint", "tinyint"):
            out.append(f"CAST(`{f.name}` AS BIGINT) AS `{f.name}`")
        elif kind.startswith("array<string"):
            out.append(f"array_join(`{f.name}`, '|') AS `{f.name}`")
        else:
            out.append(f"`{f.name}`")
    return df.selectExpr(*out)


def _seeded(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: _wide(operator(corpus.seeded_files(spark, sf)))


def _talk(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: _wide(operator(corpus.conversation_files(spark, sf)))


def _find(rule_id: str) -> Callable[[DataFrame], DataFrame]:
    return lambda files: fd.findings(files, DEFAULT, [rule_id]).select(*FINDING_COLUMNS)


def _subs(dim: str) -> Callable[[DataFrame], DataFrame]:
    return lambda files: sc.sub_scores(Audit(files).score_table, DEFAULT, [dim]).select("project_id", "sub", "score")


def _dim(dim: str) -> Callable[[DataFrame], DataFrame]:
    def run(files):
        rows = sc.dimension_scores(Audit(files).score_table, DEFAULT, [dim])
        subs = ", ".join(f"concat('{s}=', sub_scores['{s}'])" for s, _ in cat.SUB_WEIGHTS[dim])
        return rows.selectExpr("project_id", "dimension", "name", "score", "weight", f"concat_ws(',', {subs}) AS sub_scores")
    return run


def _audits(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda files: Audit(files).audits().select("project_id", *columns)


def _manifest(files: DataFrame) -> DataFrame:
    return cl.manifests(files)


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    audit = Audit(corpus.unreadable_files(spark, sf))
    return _wide(sc.errors(audit.score_table, DEFAULT))


def _unreadable_audits(spark: SparkSession, sf: str) -> DataFrame:
    audits = Audit(corpus.unreadable_files(spark, sf)).audits()
    return _wide(audits.select("project_id", "overall", *cat.DIMENSIONS, "n_critical", "n_warning", "n_info"))


def _unreadable_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(fd.finding_counts(Audit(corpus.unreadable_files(spark, sf)).findings()))


def _configured(files: DataFrame) -> DataFrame:
    dims = CONFIGURED.enabled_dimensions()
    return Audit(files, CONFIGURED).audits().select(
        "project_id", "overall", *dims, "n_critical", "n_warning", "n_info", "passed")


def _dimension_gate(files: DataFrame) -> DataFrame:
    return sc.dimension_gate(Audit(files).score_table, DEFAULT)


def _fail_gate(files: DataFrame) -> DataFrame:
    cfg = layered_config({"fail_threshold": 80})
    return Audit(files, cfg).audits().select("project_id", "overall", "passed")


def _single(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.table(spark, sf, "documents").selectExpr(
        "0 AS project_id", "'doc_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path", "text AS content")
    scores = Audit(docs, single=True).score_table
    return _wide(scores.selectExpr("project_id.path AS project_id", "skill_type", "overall", "P", "F", "X", "P_injection", "P_token", "P_clarity", "P_specificity"))


def _sarif_results(files: DataFrame) -> DataFrame:
    return rp.sarif_results(Audit(files).findings()).select("project_id", "rule_id", "level", "message", "uri", "start_line")


def _sarif_rules(files: DataFrame) -> DataFrame:
    return rp.sarif_rules(Audit(files).findings()).select("project_id", "rule_id", "name", "message", "level")


SARIF_RUN = ("struct<tool struct<driver struct<rules array<struct<id string, shortDescription struct<text string>>>>>, results array<struct<ruleId string, "
             "message struct<text string>, locations array<struct<physicalLocation struct<region struct<startLine bigint>>>>>>>")


def _sarif_documents(files: DataFrame) -> DataFrame:
    docs = rp.sarif_documents(Audit(files).findings())
    docs = docs.selectExpr("project_id", "dimension", "path", f"from_json(sarif, 'version string, runs array<{SARIF_RUN}>') AS s")
    run = "s.runs[0]"
    return docs.selectExpr(
        "project_id", "dimension", "path", "s.version AS version",
        f"array_join(transform({run}.results, r -> r.ruleId), '|') AS result_rules",
        f"array_join(transform({run}.results, r -> r.message.text), '|') AS messages",
        f"array_join(transform({run}.results, r -> CAST(r.locations[0].physicalLocation.region.startLine AS STRING)), '|', '-') AS lines",
        f"array_join(transform({run}.tool.driver.rules, r -> r.id), '|') AS described",
        f"array_join(transform({run}.tool.driver.rules, r -> r.shortDescription.text), '|') AS about")


def _json_reports(files: DataFrame) -> DataFrame:
    docs = rp.json_reports(Audit(files).audits(nested=True))
    return docs.selectExpr(
        "project_id", "CAST(get_json_object(report, '$.overall') AS BIGINT) AS overall",
        "get_json_object(report, '$.summary') AS summary",
        "CAST(get_json_object(report, '$.dimension_scores.S.sub_scores.secrets') AS BIGINT) AS secrets",
        "CAST(get_json_object(report, '$.dimension_scores.P.weight') AS DOUBLE) AS p_weight")


LINE_FIELDS = ("rule_id", "pattern_id", "dimension", "severity", "category", "path", "location", "message", "fix_hint", "fix_safety")


def _finding_lines(files: DataFrame) -> DataFrame:
    lines = rp.finding_lines(Audit(files).findings())
    return lines.selectExpr("project_id", *[f"get_json_object(finding, '$.{f}') AS {f}" for f in LINE_FIELDS])


EVIDENCE_PLACE = "row_number() OVER (PARTITION BY project_id ORDER BY seq, path) AS place"


def _json_whole(files: DataFrame) -> DataFrame:
    docs = rp.json_reports(Audit(files).audits(nested=True), DEFAULT)
    texts = ("skill_type", "band")
    cells = [f"get_json_object(report, '$.{c}') AS {c}" for c in texts]
    cells += [f"CAST(get_json_object(report, '$.{c}') AS BIGINT) AS {c}" for c in AUDIT_COLUMNS if c not in (*texts, "project_id")]
    cells += [f"CAST(get_json_object(report, '$.dimension_scores.{d}.sub_scores.{s}') AS BIGINT) AS {d}_{s}" for d in cat.DIMENSIONS for s, _ in cat.SUB_WEIGHTS[d]]
    return docs.selectExpr("project_id", *cells, "CAST(get_json_object(report, '$.passed') AS BOOLEAN) AS passed")


def _report_lines(files: DataFrame) -> DataFrame:
    """What each line of the reports is about."""
    audit = Audit(files)
    lines = rp.report_lines(audit.audits(nested=True), audit.findings(), audit.patches("suggested"), cl.project_files(files), DEFAULT)
    field = "get_json_object(line, '$.{}')".format
    name, value = (f"CASE record WHEN 'audit' THEN {field(a)} WHEN 'issue' THEN {field(i)} WHEN 'patch' THEN {field(p)} ELSE {field(f)} END"
                   for a, i, p, f in (("overall", "rule_id", "file_path", "path"), ("skill_type", "message", "replacement", "kind")))
    return lines.selectExpr("project_id", "record", f"{name} AS name", f"{value} AS value")


def _patches(level: str) -> Callable[[DataFrame], DataFrame]:
    return lambda files: fx.patches(files, level).select(
        "project_id", "file_path", "original", "replacement", "safety", "issue_rule_id")


def _patched(files: DataFrame) -> DataFrame:
    return fx.patched_files(files, "suggested")


def _reaudit(files: DataFrame) -> DataFrame:
    """Secret and dangerous-call findings before and after the fixes."""
    def count(df, when):
        found = fd.findings(df, DEFAULT, ["sec_secrets", "sec_dangerous_functions"])
        return found.groupBy("rule_id").agg(F.expr("count(1) AS n_findings")).withColumn("state", F.lit(when))

    return count(files, "before").unionByName(count(fx.patched_files(files, "suggested"), "after"))


def _incremental(spark: SparkSession, sf: str) -> DataFrame:
    store = inc.full_audit(corpus.earlier_files(spark, sf), DEFAULT)
    rows = inc.incremental_audit(corpus.seeded_files(spark, sf), store, DEFAULT)
    return _wide(rows.select("project_id", "overall", "project_hash", "reused"))


def _appended_twice(spark: SparkSession, sf: str) -> DataFrame:
    """A store that holds every row twice."""
    store = inc.full_audit(corpus.earlier_files(spark, sf), DEFAULT)
    rows = inc.incremental_audit(corpus.seeded_files(spark, sf), store.unionByName(store), DEFAULT)
    return _wide(rows.select("project_id", "overall", "project_hash", "reused"))


# Another weight of one dimension: the others' results still hold.
REWEIGHTED = layered_config({"dimensions": {"S": {"weight": 0.4}}})


def _dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions of the corpus as it is, out of those it had earlier under other weights."""
    store = inc.full_dimensions(corpus.earlier_files(spark, sf), DEFAULT)
    return inc.incremental_dimensions(corpus.seeded_files(spark, sf), store, REWEIGHTED)


# Projects by their number: nothing set, two layers of which the upper holds, and rules and severities of their own.
OWN_LAYERS = {
    1: ({"fail_threshold": 60, "dimensions": {"S": {"weight": 0.9}, "F": {"enabled": False}}}, {"fail_threshold": 88, "dimensions": {"S": {"weight": 0.4}}}),
    2: ({"dimensions": {
        "M": {"rules": {"compat_vendor_lock": {"enabled": False}}}, "X": {"weight": 1.0, "rules": {"maint_documentation": {"enabled": False}}},
        "S": {"rules": {"sec_secrets": {"severity": "info"}, "sec_mcp_permissions": {"enabled": False}}},
        "P": {"threshold": 80, "rules": {"prompt_injection": {"enabled": False}}}}},)}


def _settings(files: DataFrame) -> DataFrame:
    projects = files.select("project_id").distinct()
    parts = [pp.settings_of(projects.filter(F.col("project_id") % 3 == k), *layers) for k, layers in OWN_LAYERS.items()]
    nonsense = projects.selectExpr("project_id", "9 AS layer", "'S' AS dimension", "CAST(NULL AS STRING) AS rule_id", "'weight' AS key", "'heavy' AS value")
    return parts[0].unionByName(parts[1]).unionByName(nonsense)


def _own_audits(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.unreadable_files(spark, sf)
    scores = pp.score_table(pp.project_signals(files, _settings(files)))
    return _wide(pp.audits(scores).select(*AUDIT_COLUMNS, "passed"))


def _own_findings(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.unreadable_files(spark, sf)
    return _wide(fd.finding_counts(pp.findings(files, _settings(files))))


def _own_gates(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.unreadable_files(spark, sf)
    return _wide(pp.dimension_gate(pp.score_table(pp.project_signals(files, _settings(files)))))


AUDIT_COLUMNS = ("project_id", "skill_type", "files_scanned", "overall", *cat.DIMENSIONS, "n_critical", "n_warning", "n_info")


def _by_content(spark: SparkSession, sf: str) -> SignalStore:
    """A store that took in the corpus as it was, then as it is."""
    now = corpus.seeded_files(spark, sf)
    store = SignalStore.create(spark, shared_dir(spark, "store"), project_id="bigint")
    store.update(corpus.earlier_files(spark, sf))
    store.update(now)
    return store


def _incremental_contents(spark: SparkSession, sf: str) -> DataFrame:
    """How many contents each update matched."""
    store = _by_content(spark, sf)
    versions = [spark.read.parquet(f"{store.path}/contents/version={v}").agg(F.count("*").alias("n_matched")).selectExpr(f"{v}L AS version", "n_matched")
                for v in (1, 2)]
    return versions[0].unionByName(versions[1])


def _stream_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Whole audits after each of three deliveries: the corpus as it was; as it is, twice; and as it was once more, late."""
    before, now, _ = _deliveries(spark, sf)
    source, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "state")
    store = SignalStore.create(spark, shared_dir(spark, "store"), project_id="bigint")
    audits = []
    for i, files in enumerate((before, now, before)):
        _deliver(files, source)
        st.maintain(spark.readStream.schema(files.schema).parquet(source), store, checkpoint).awaitTermination()
        audits.append(store.audits().select(F.lit(i).alias("delivery"), *AUDIT_COLUMNS))
    return _wide(audits[0].unionByName(audits[1]).unionByName(audits[2]))


def _stored_other_config(spark: SparkSession, sf: str) -> DataFrame:
    """Signals stored with all rules on, findings with some off."""
    stored = Audit(corpus.seeded_files(spark, sf)).store_signals(shared_dir(spark, "signals"))
    return _wide(fd.finding_counts(Audit(stored.files, CONFIGURED, stored.signals).findings()))


def _shared_paths(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.query(corpus.SHARED_PATHS_SQL, documents=corpus.table(spark, sf, "documents"))
    scores = Audit(files, single=True).score_table
    return _wide(scores.selectExpr("project_id.project_id AS project_id", "project_id.path AS path", "skill_type", "n_files", "overall", "P", "F", "X"))


def _judged_audit(spark: SparkSession, sf: str) -> DataFrame:
    audit = Audit(corpus.seeded_files(spark, sf), layered_config({"fail_threshold": 80}), judged=corpus.responses(spark, sf))
    return _wide(audit.audits().select("project_id", "overall", *cat.DIMENSIONS, *[f"n_{s}" for s in cat.SEVERITIES], "band", "passed"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    parsed = jd.parse_responses(corpus.responses(spark, sf))
    scores = jd.blend(Audit(corpus.seeded_files(spark, sf)).score_table, parsed, DEFAULT)
    merged = [f"concat_ws(',', transform({d}_merged, e -> concat(e.k, '=', e.v))) AS {d}_subs" for d in ("P", "C")]
    return _wide(scores.selectExpr("project_id", "P", "C", *merged, "overall"))


# Below these projects lie the pages that the registered query reads back.
TREE_PROJECTS = ("p1", "p3")


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as a tree of files, written and read again, but for what the conditions leave out."""
    spark.dataSource.register(ProjectTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    root = shared_dir(spark, "tree")
    pages = corpus.table(spark, sf, "pages").selectExpr(
        "concat('p', page_id % 5) AS project_id", "concat('d', page_id % 3, '/', page_id, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.py' END) AS path", "html AS content")
    pages.write.format("project_tree").mode("append").save(root)
    files = spark.read.format("project_tree").load(root)
    kept = files.filter(F.col("project_id").isin(*TREE_PROJECTS) & F.col("path").endswith(".html"))
    return _wide(kept.selectExpr("project_id", "path", "length(content) AS n_chars", "sha2(content, 256) AS digest"))


def _usage_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Merged from sketches of seven days, against the answers themselves."""
    answers = corpus.responses(spark, sf).withColumn("day", F.col("project_id") % 7)
    daily = jd.usage_sketches(answers, "day")
    return _wide(jd.merged_usage(daily).select(
        "judge", "status", "n_calls", "input_tokens", "output_tokens", "retries", F.round("n_projects", 0).cast("bigint").alias("n_projects"),
        "min_latency_ms", "max_latency_ms", "median_latency_ms"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(jd.parse_responses(corpus.responses(spark, sf)))


def _judge_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = jd.judge_findings(jd.parse_responses(corpus.responses(spark, sf)))
    return _wide(rows.select("project_id", "dimension", "severity", "category", "message", "source"))


def _judge_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(jd.judge_usage(corpus.responses(spark, sf)))


def _call_judge(spark: SparkSession, sf: str) -> DataFrame:
    def connect():
        """Stands in for a model: the answer depends on the request alone."""
        import hashlib

        def ask(system: str, user: str, timeout: int):
            score = int(hashlib.sha256(user.encode()).hexdigest()[:4], 16) % 101
            key = "clarity" if "clarity" in system else "hallucination_risk"
            return f'{{"{key}": {{"score": {score}, "reason": "stub"}}}}', len(user), 10
        return ask

    requests = jd.judge_requests(corpus.seeded_files(spark, sf))
    answers = jd.call_judge(requests, connect, retry_delay=0.0)
    return _wide(answers.select("project_id", "judge", "path", "part", "raw", "status", "input_tokens", "output_tokens", "retries"))


def _times(spark: SparkSession, sf: str) -> DataFrame:
    """(project_id, arrived): the files of a project arrive at the time of the
    event with its number.  Stored, so that Spark knows how few they are."""
    # A time without zone is taken as UTC.
    events = corpus.table(spark, sf, "events").selectExpr(
        "event_id AS project_id", "CAST(concat(CAST(ts AS STRING), 'Z') AS TIMESTAMP) AS arrived")
    times = events.join(corpus.seeded_files(spark, sf).select("project_id").distinct(), "project_id", "left_semi")
    path = shared_dir(spark, "times")
    times.write.parquet(path)
    return spark.read.schema(times.schema).parquet(path)


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded corpus as a stream."""
    schema = corpus.table(spark, sf, "documents").schema
    # By a pattern, as the table may be one file or a folder of them; a stream takes only the latter by its name.
    docs = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/documents.parque[t]")
    return corpus.seeded_from(docs).join(_times(spark, sf), "project_id")


def _deliver(files: DataFrame, source: str) -> None:
    files.write.mode("append").option("compression", "zstd").parquet(source)


def _streamed(spark: SparkSession, deliveries: list[DataFrame], *streams: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The versions that arrived, and the tables that ``streams`` write of them,
    one run of each after every delivery."""
    source, once, state = shared_dir(spark, "arrivals"), shared_dir(spark, "versions"), shared_dir(spark, "state")
    places = [(make, shared_dir(spark, "streamed"), shared_dir(spark, "state")) for make in streams]
    for files in deliveries:
        _deliver(files, source)
        versions = files.select("*", F.lit(0).alias("batch")).schema
        st.store_versions(spark.readStream.schema(files.schema).parquet(source), once, state).awaitTermination()
        for make, out, checkpoint in places:
            arrivals = spark.readStream.schema(versions).parquet(f"{once}/files")
            st.write_stream(make(arrivals), out, checkpoint).awaitTermination()
    return [spark.read.parquet(path) for path in (f"{once}/files", *[out for _, out, _ in places])]


def _deliveries(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The corpus as it was earlier, later as it is, that twice within a
    delivery, and once more."""
    times = _times(spark, sf)
    before = corpus.earlier_files(spark, sf).join(times, "project_id")
    now = corpus.seeded_files(spark, sf).join(times, "project_id").withColumn("arrived", F.expr("arrived + INTERVAL 400 DAYS"))
    return [before, now.unionByName(now), now]


def _stream_findings(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = shared_dir(spark, "findings"), shared_dir(spark, "state")
    st.write_stream(st.stream_findings(_arrivals(spark, sf)), out, checkpoint).awaitTermination()
    return _wide(fd.finding_counts(spark.read.parquet(out)))


def _stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every file is delivered again, ten minutes later."""
    arrivals = _arrivals(spark, sf)
    again = arrivals.withColumn("arrived", F.expr("arrived + INTERVAL 10 MINUTES"))
    counts, out = shared_dir(spark, "counts"), shared_dir(spark, "windows")
    st.write_stream(st.stream_counts(arrivals.unionByName(again)), counts, shared_dir(spark, "state")).awaitTermination()
    stream = spark.readStream.schema(spark.read.parquet(counts).schema).parquet(counts)
    st.write_updates(st.windowed_counts(stream, "6 hours"), out, shared_dir(spark, "state")).awaitTermination()
    rows = st.latest_updates(spark.read.parquet(out), ["window_start", "rule_id"])
    return _wide(rows.selectExpr("unix_seconds(window_start) AS window_start", "rule_id", "n_findings"))


def _stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """A fourth of the projects is delivered after all others, with its own times."""
    files = corpus.seeded_files(spark, sf).join(_times(spark, sf), "project_id")
    source, out, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "counts"), shared_dir(spark, "state")
    for part in (files.filter("project_id % 4 <> 1"), files.filter("project_id % 4 = 1")):
        _deliver(part, source)
        st.count_with_late(spark.readStream.schema(files.schema).parquet(source), out, checkpoint).awaitTermination()
    rows = st.counted_windows(spark.read.parquet(f"{out}/counts"), "6 hours")
    return _wide(rows.selectExpr("unix_seconds(window_start) AS window_start", "rule_id", "n_findings", "n_late"))


def _stream_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from signals that streamed in, against the same files."""
    out, checkpoint = shared_dir(spark, "signals"), shared_dir(spark, "state")
    st.write_stream(st.stream_signals(_arrivals(spark, sf)), out, checkpoint).awaitTermination()
    audit = Audit(corpus.seeded_files(spark, sf), signals=st.newest(spark.read.parquet(out)))
    return _wide(audit.audits().select("project_id", "overall", *cat.DIMENSIONS))


def _stream_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Files that changed and came again: the scores of the last versions."""
    arrived, signals = _streamed(spark, _deliveries(spark, sf), st.stream_signals)
    return _wide(Audit(st.current_files(arrived), signals=st.newest(signals)).audits().select("project_id", "overall", *cat.DIMENSIONS))


def _stream_update_findings(spark: SparkSession, sf: str) -> DataFrame:
    _, found, signals = _streamed(spark, _deliveries(spark, sf), st.stream_findings, st.stream_signals)
    return _wide(fd.finding_counts(st.current_findings(found, signals)))


def _lines(files: DataFrame) -> DataFrame:
    return cl.numbered_lines(files).select("project_id", "path", "kind", "line_no", "line")


def _findings(files: DataFrame) -> DataFrame:
    return Audit(files).findings().select(*FINDING_COLUMNS, "dimension", "category", "fix_hint", "auto_fixable", "fix_safety")


QUERIES: dict[str, Query] = {
    "files_from_table": lambda spark, sf: _wide(files_from_table(
        corpus.table(spark, sf, "pages"), "split_part(split_part(url, '//', 2), '/', 1)", "concat('page_', page_id, '.html')", "html"
    ).selectExpr("project_id", "path", "length(content) AS n_chars")),
    "file_kind": _seeded(cl.project_files),
    "file_kind_conversations": _talk(cl.project_files),
    "manifest": _seeded(_manifest),
    "manifest_conversations": _talk(_manifest),
    "single_file_scores": _single,
    "numbered_lines": _seeded(_lines),
    "code_metrics": _seeded(cl.code_metrics),
    "duplicate_lines": _seeded(lambda files: cl.duplicate_lines(cl.classify(files))),
    "duplicate_lines_conversations": _talk(lambda files: cl.duplicate_lines(cl.classify(files))),
    **{f"find_{r}": _seeded(_find(r)) for r in FOUND_RULES},
    **{f"find_{r}_conversations": _talk(_find(r)) for r in FIND_RULES_ON_CONVERSATIONS},
    "findings": _seeded(_findings),
    "finding_counts": _seeded(lambda files: fd.finding_counts(Audit(files).findings())),
    **{f"sub_{d}": _seeded(_subs(d)) for d in cat.DIMENSIONS},
    "sub_P_conversations": _talk(_subs("P")),
    **{f"dim_{d}": _seeded(_dim(d)) for d in cat.DIMENSIONS},
    "evidence": _seeded(lambda files: ev.evidence(files, DEFAULT).drop("seq")),
    "overall": _seeded(_audits("skill_type", "files_scanned", "overall", *cat.DIMENSIONS)),
    "overall_conversations": _talk(_audits("skill_type", "files_scanned", "overall", *cat.DIMENSIONS)),
    "severity_counts": _seeded(_audits("n_critical", "n_warning", "n_info")),
    "summary": _seeded(_audits("band", "summary")),
    "gate": _seeded(_fail_gate),
    "dimension_gate": _seeded(_dimension_gate),
    "configured_per_project": _own_audits,
    "findings_per_project": _own_findings,
    "gates_per_project": _own_gates,
    "configured_audit": _seeded(_configured),
    "error_findings": _errors,
    "error_audits": _unreadable_audits,
    "error_finding_counts": _unreadable_counts,
    "findings_cube": _seeded(lambda files: rp.findings_cube(Audit(files).findings())),
    "rule_coverage": _seeded(lambda files: rp.rule_coverage(Audit(files).findings())),
    "worst_k": _seeded(lambda files: rp.worst_projects(Audit(files).audits(), 20).select("project_id", "overall")),
    "project_ranks": _seeded(lambda files: rp.project_ranks(Audit(files).audits().select("project_id", "overall"))),
    "project_ranks_per_type": _seeded(lambda files: rp.project_ranks(Audit(files).audits().select("project_id", "skill_type", "overall"), "skill_type")),
    "worst_per_type": _seeded(lambda files: rp.worst_per_type(Audit(files).audits(), 3).select("skill_type", "place", "project_id", "overall")),
    "sarif_results": _seeded(_sarif_results),
    "sarif_rules": _seeded(_sarif_rules),
    "sarif_documents": _seeded(_sarif_documents),
    "json_reports": _seeded(_json_reports),
    "json_reports_whole": _seeded(_json_whole),
    "report_lines": _seeded(_report_lines),
    "evidence_in_order": _seeded(lambda files: ev.evidence(files, DEFAULT).selectExpr("*", EVIDENCE_PLACE).drop("seq")),
    "reaudit_all_rules": _seeded(lambda files: fd.finding_counts(Audit(fx.patched_files(files, "suggested")).findings())),
    "finding_lines": _seeded(_finding_lines),
    "patches_safe": _seeded(_patches("safe")),
    "patches_suggested": _seeded(_patches("suggested")),
    "patched_files": _seeded(_patched),
    "patch_stats": _seeded(lambda files: fx.patch_stats(fx.patches(files, "suggested"))),
    "fuzzy_prompt_patches": _seeded(lambda files: fx.fuzzy_prompt_patches(files).select("project_id", "file_path", "original", "replacement")),
    "reaudit_patched": _seeded(_reaudit),
    "content_hash": _seeded(inc.file_hashes),
    "project_hash": _seeded(inc.project_hashes),
    "incremental": _incremental,
    "incremental_dimensions": lambda spark, sf: _wide(_dimensions(spark, sf).select(
        "project_id", "dimension", "score", "weight", "n_critical", "n_warning", "n_info", "reused")),
    "incremental_dimension_audits": lambda spark, sf: _wide(inc.assembled_audits(_dimensions(spark, sf), REWEIGHTED).select(*AUDIT_COLUMNS)),
    "incremental_files": lambda spark, sf: _wide(_by_content(spark, sf).audits().select(*AUDIT_COLUMNS)),
    "incremental_file_findings": lambda spark, sf: _wide(_by_content(spark, sf).findings().select(*FINDING_COLUMNS)),
    "incremental_contents": _incremental_contents,
    "judge_requests": _seeded(lambda files: jd.judge_requests(files).select("project_id", "judge", "path", "part", "user_prompt")),
    "judge_requests_limited": _seeded(lambda files: jd.judge_requests(files, limits=jd.Limits()).select("project_id", "judge", "user_prompt", "truncated")),
    "judge_parse": _parsed,
    "judge_blend": _judged,
    "judge_findings": _judge_findings,
    "judge_usage": _judge_usage,
    "judge_usage_merged": _usage_sketches,
    "score_distributions": _seeded(lambda files: jd.merged_scores(jd.score_sketches(
        sc.dimension_scores(Audit(files).score_table, DEFAULT).withColumn("day", F.col("project_id") % 7), "day")).drop("mean")),
    "project_tree": _tree,
    "call_judge": _call_judge,
    "stream_findings": _stream_findings,
    "stream_windows": _stream_windows,
    "stream_signals": _stream_signals,
    "stream_updates": _stream_updates,
    "stream_update_findings": _stream_update_findings,
    "stream_audits": _stream_audits,
    "stream_late": _stream_late,
    "incremental_appended_twice": _appended_twice,
    "stored_other_config": _stored_other_config,
    "single_files_shared_paths": _shared_paths,
    "judged_audit": _judged_audit,
    "custom_findings": _seeded(lambda files: custom_findings(files, (STYLE,)).groupBy("project_id", "path", "rule_id", "severity").agg(F.expr("count(1) AS n"))),
    "custom_dimension": _seeded(lambda files: with_custom_dimensions(files, Audit(files).score_table, (STYLE,), DEFAULT).select("project_id", "Z", "overall")),
}
