"""Corpus-level roll-ups and report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioscan.functions import text as tx
from folioscan.operators import findings as fd
from folioscan.plans.config import AuditConfig

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"

LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' WHEN 'info' THEN 'note' ELSE 'warning' END"
_LINE_AT_END = r":(\d+)\s*$"


def findings_cube(found: DataFrame) -> DataFrame:
    """Counts by dimension, severity and rule in every combination; NULL = all.

    The findings are counted once and the few counts cubed."""
    counts = found.groupBy("dimension", "severity", "rule_id").agg(F.expr("count(1) AS n"))
    return counts.cube("dimension", "severity", "rule_id").agg(
        F.expr("sum(n) AS n_findings"), F.expr("CAST(grouping_id() AS INT) AS level"))


def rule_coverage(found: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """Each entry of the rule catalog with its number of findings, also 0."""
    counts = found.groupBy("rule_id", "pattern_id").agg(F.expr("count(1) AS n"))
    return fd.rule_catalog(found.sparkSession, cfg).join(counts, ["rule_id", "pattern_id"], "left").selectExpr(
        "rule_id", "pattern_id", "dimension", "severity", "coalesce(n, 0L) AS n_findings")


def worst_projects(audits: DataFrame, k: int) -> DataFrame:
    return audits.orderBy("overall", "project_id").limit(k)


BEST_SCORE = 100


def project_ranks(audits: DataFrame, *within: str) -> DataFrame:
    """Adds rank, dense_rank and percent_rank by ``overall``, the best first, and
    n_projects; among all projects or those alike in ``within``.

    Scores are whole numbers up to 100, so projects are counted by score and each
    score adds its count to the ranks of those below: no project is sorted, and
    no task sees all of them."""
    counts = audits.groupBy(*within, "overall").agg(F.count("*").alias("n"))
    said = counts.select(*within, F.explode(F.sequence(F.lit(0), F.lit(BEST_SCORE))).alias("score"), "overall", "n").groupBy(*within, "score").agg(
        F.expr("1 + sum(CASE WHEN overall > score THEN n ELSE 0 END) AS rank"), F.expr("1 + count_if(overall > score) AS dense_rank"),
        F.sum("n").alias("n_projects"), F.expr("max(overall = score) AS held"))
    said = said.filter("held").withColumn("percent_rank", F.expr("CASE WHEN n_projects > 1 THEN (rank - 1) / (n_projects - 1) ELSE 0.0D END"))
    # A hundred and one scores; with `within`, as often as it has values.
    small = said.selectExpr(*[f"{c} AS of_{c}" for c in within], "score", "rank", "dense_rank", "percent_rank", "n_projects")
    same = F.col("overall") == F.col("score")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    rows = audits.join(small if within else F.broadcast(small), same)
    return rows.drop("score", *[f"of_{c}" for c in within])


def worst_per_type(audits: DataFrame, k: int) -> DataFrame:
    """The k lowest scores of each skill type; pruned before the shuffle."""
    order = Window.partitionBy("skill_type").orderBy("overall", "project_id")
    return audits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def sarif_results(found: DataFrame) -> DataFrame:
    """One SARIF result per finding."""
    line = f"regexp_extract(location, {tx.q(tx.jregex(_LINE_AT_END))}, 1)"
    return found.selectExpr(
        "project_id", "coalesce(rule_id, category) AS rule_id", f"{LEVEL} AS level",
        "concat(message, CASE WHEN fix_hint <> '' THEN concat('\\nFix: ', fix_hint) ELSE '' END) AS message",
        f"regexp_replace(location, {tx.q(tx.jregex(_LINE_AT_END))}, '') AS uri",
        f"try_cast({line} AS BIGINT) AS start_line", *fd.ORDER)


def sarif_rules(found: DataFrame) -> DataFrame:
    """The rules of a project, described by the first finding of each."""
    first = Window.partitionBy("project_id", "rule_id").orderBy(*[F.col(c).asc_nulls_first() for c in fd.ORDER])
    return (
        found.filter("rule_id IS NOT NULL").select("project_id", "rule_id", "category", "message", "severity", *fd.ORDER)
        .withColumn("rn", F.row_number().over(first)).filter("rn = 1")
        .selectExpr("project_id", "rule_id", "category AS name", "message", f"{LEVEL} AS level", "rule_rank"))


def sarif_documents(found: DataFrame, tool: str = "folioscan") -> DataFrame:
    """SARIF 2.1.0 documents as JSON text, one for each project, dimension and
    file (path NULL: about the project as a whole), so that a document is as
    large as what one file gives, and results keep their order.  Results and the
    rules they name come from one pass over the findings."""
    key = ", ".join(fd.ORDER)
    result = (
        "named_struct('ruleId', r.rule_id, 'level', r.level, 'message', named_struct('text', r.message), 'locations', "
        "array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', r.uri), "
        "'region', named_struct('startLine', r.start_line)))))"
    )
    described = (
        "named_struct('id', r.rule_id, 'name', r.category, 'shortDescription', named_struct('text', r.about), "
        "'defaultConfiguration', named_struct('level', r.level))")
    line = f"try_cast(regexp_extract(location, {tx.q(tx.jregex(_LINE_AT_END))}, 1) AS BIGINT)"
    rows = found.selectExpr(
        "project_id", "dimension", "path",
        f"struct({key}, coalesce(rule_id, category) AS rule_id, rule_id AS own_id, {LEVEL} AS level, category, message AS about, "
        "concat(message, CASE WHEN fix_hint <> '' THEN concat('\\nFix: ', fix_hint) ELSE '' END) AS message, "
        f"regexp_replace(location, {tx.q(tx.jregex(_LINE_AT_END))}, '') AS uri, {line} AS start_line) AS r")
    files = rows.groupBy("project_id", "dimension", "path").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    # Sorted by rule first, so a rule's first finding follows another rule's.
    first = "filter(rs, (r, i) -> r.own_id IS NOT NULL AND (i = 0 OR NOT (r.rule_rank <=> get(rs, i - 1).rule_rank)))"
    run = (f"named_struct('tool', named_struct('driver', named_struct('name', '{tool}', 'rules', transform({first}, r -> {described}))), "
           f"'results', transform(rs, r -> {result}))")
    return files.selectExpr(
        "project_id", "dimension", "path",
        f"to_json(named_struct('$schema', '{SARIF_SCHEMA}', 'version', '2.1.0', 'runs', array({run}))) AS sarif")


def json_reports(audits: DataFrame, cfg: AuditConfig | None = None, audited_at: str | None = None) -> DataFrame:
    """The audit of each project as JSON, with the configuration and the time of
    the audit if given; its findings are a table of their own."""
    extra = []
    if cfg is not None:
        extra.append(f"{tx.q(cfg.to_json())} AS config_snapshot")
    if audited_at is not None:
        extra.append(f"TIMESTAMP {tx.q(audited_at)} AS audit_timestamp")
    return audits.selectExpr("project_id", f"to_json(struct({', '.join([*audits.columns, *extra])})) AS report")


def finding_lines(found: DataFrame) -> DataFrame:
    """Findings as JSON lines."""
    return found.selectExpr("project_id", f"to_json(struct({', '.join(fd.COLUMNS)})) AS finding")


def report_lines(audits: DataFrame, found: DataFrame, patches: DataFrame, files: DataFrame, cfg: AuditConfig | None = None,
                 audited_at: str | None = None) -> DataFrame:
    """The whole report of each project as JSON lines (project_id, record, line):
    one ``audit``, and one line for each ``issue``, ``patch`` and ``file``.
    Nothing is gathered, so a project may have any number of them.  ``files``:
    :func:`classify.project_files`."""
    def lines(rows: DataFrame, record: str) -> DataFrame:
        columns = ", ".join(f"`{c}`" for c in rows.columns if c != "project_id")
        return rows.selectExpr("project_id", f"'{record}' AS record", f"to_json(struct({columns})) AS line")

    audit = json_reports(audits, cfg, audited_at).selectExpr("project_id", "'audit' AS record", "report AS line")
    return (audit.unionByName(lines(found.select(*fd.COLUMNS), "issue")).unionByName(lines(patches, "patch"))
            .unionByName(lines(files, "file")))
