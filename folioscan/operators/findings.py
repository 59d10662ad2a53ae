"""Findings: one row per thing found, in a total order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.functions import text as tx
from folioscan.operators import classify as cl, signals as sg
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat

# Sorting by these gives the order in which findings arise.
ORDER = ("rule_rank", "group_rank", "path", "pattern_rank", "pos")

COLUMNS = (
    "project_id", "dimension", "rule_id", "pattern_id", "severity", "category", "path", "line", "location", "message",
    "fix_hint", "auto_fixable", "fix_safety", "source", "rule_rank", "group_rank", "pattern_rank", "pos",
)

HIT = "struct<key string, line int, pos int, grp int, detail string>"

_CATALOG = (
    "array<struct<key string, rule_id string, pattern_id string, pattern_rank int, rule_rank int, dimension string, "
    "severity string, category string, message string, fix_hint string, auto_fixable boolean, fix_safety string>>"
)


def rule_catalog(spark: SparkSession, cfg: AuditConfig | None = None) -> DataFrame:
    """The rule table (fixed, under a hundred rows), with configured severities."""
    rows = cat.rows()
    if cfg is not None:
        rows = [dict(r, severity=cfg.severity(r["rule_id"], r["severity"])) for r in rows]
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, _CATALOG)))


def _hit(key: str, line="NULL", pos="0", group="0", detail="NULL") -> str:
    return (
        f"named_struct('key', {tx.q(key)}, 'line', CAST({line} AS INT), 'pos', CAST({pos} AS INT), "
        f"'grp', CAST({group} AS INT), 'detail', CAST({detail} AS STRING))"
    )


_NONE = f"CAST(array() AS array<{HIT}>)"


def _if(condition: str, hits: str) -> str:
    return f"CASE WHEN {condition} THEN {hits} ELSE {_NONE} END"


def match_hits(rule_id: str, pattern: cat.Pattern) -> str:
    """Every match of a pattern in a file."""
    group, detail = "0", "NULL"
    if rule_id == "sec_secrets":
        group, detail = "kind = 'config'", "concat(substring(m.match, 1, 20), '...')"
    elif rule_id == "sec_hardcoded_config":
        detail = "substring(m.match, 1, 40)"
    found = tx.all_of(sg.match_scope(rule_id), sg.guard(pattern), tx.rlike("text", pattern.regex))
    hit = _hit(f"{rule_id}/{pattern.key}", "m.line", "m.pos", group, detail)
    return _if(found, f"transform({tx.matches('text', pattern.regex)}, m -> {hit})")


def file_hits(rule_id: str) -> list[str]:
    """What a rule finds in one file, as arrays of hits."""
    if rule_id in cat.MATCH_RULES:
        return [match_hits(rule_id, p) for p in cat.RULE[rule_id].patterns]
    if rule_id == "prompt_injection":
        return [
            f"coalesce(transform({sg.injection_lines(p)}, "
            f"m -> {_hit(f'{rule_id}/{p.key}', 'm.line', 'm.line', f'{2 * i} + CAST(is_prompt AS INT)')}), {_NONE})"
            for i, p in enumerate(cat.INJECTION_PATTERNS)]
    if rule_id == "sec_mcp_permissions":
        return [_if(sg.broad_mcp_permission(), f"array({_hit(f'{rule_id}/')})")]
    if rule_id == "compat_vendor_lock":
        return [_if(sg.has_vendor(p), f"array({_hit(f'{rule_id}/{p.key}')})") for p in cat.VENDOR_PATTERNS]
    if rule_id == "maint_complexity":
        n = sg.branch_count()
        return [_if(f"{n} > {cat.MAX_BRANCHES}", f"array({_hit(f'{rule_id}/', detail=f"concat('about ', {n})")})")]
    if rule_id in cat.FILE_RULES:
        return [_if(sg.file_conditions()[rule_id], f"array({_hit(f'{rule_id}/')})")]
    return []


def finish(hits: DataFrame, spark: SparkSession, cfg: AuditConfig) -> DataFrame:
    """(project_id, path, place, hit) rows to findings."""
    rules = F.broadcast(rule_catalog(spark, cfg))  # fixed size
    flat = hits.select("project_id", "path", "place", "hit.*").filter("key IS NOT NULL")
    return flat.join(rules, "key").selectExpr(
        "project_id", "dimension", "rule_id", "pattern_id", "severity", "category", "path", "line",
        "concat(coalesce(path, place), coalesce(concat(':', line), '')) AS location",
        "concat(message, coalesce(concat(': ', detail), '')) AS message",
        "fix_hint", "auto_fixable", "fix_safety", "'deterministic' AS source",
        "rule_rank", "grp AS group_rank", "pattern_rank", "pos")


def _wanted(cfg: AuditConfig, rules) -> set[str]:
    return {r.rule_id for r in cat.RULES if cfg.runs(r.rule_id) and (rules is None or r.rule_id in rules)}


def hits_column(cfg: AuditConfig, rules=None) -> str:
    """Everything the enabled rules find in one file, as one array."""
    wanted = _wanted(cfg, rules)
    hits = [h for r in cat.RULES if r.rule_id in wanted for h in file_hits(r.rule_id)]
    return f"concat({', '.join(hits)})" if hits else ""


def matched_rules(cfg: AuditConfig, rules=None) -> set[str]:
    """The enabled rules that look at one file."""
    return {r for r in _wanted(cfg, rules) if file_hits(r)}


def findings(files: DataFrame, cfg: AuditConfig | None = None, rules=None, classified: DataFrame | None = None,
             project_signals: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """All findings of the given rules (default: all enabled ones).

    ``hits`` may be a stored table of (project_id, path, hits), see
    :func:`hits_column`; the text is then not matched again.  What rules that are
    off found in it is left out; a table that lacks a rule is refused.  With
    ``hits`` and ``project_signals`` no text is read at all.  Else it is read for
    the hits, for what decides about projects, and for what is found about them.
    """
    cfg = cfg or AuditConfig()
    spark = files.sparkSession
    wanted = _wanted(cfg, rules)
    if classified is None and (hits is None or project_signals is None):
        classified = cl.classify(files)
    if project_signals is None and wanted & {*cat.PROJECT_RULES, *PROJECT_DECIDES, "sec_dependencies"} and not files.isStreaming:
        project_signals = sg.project_signals(files, cfg, classified=classified, repeated_lines=False)
    parts = []

    in_file = hits_column(cfg, wanted)
    if in_file:
        # explode_outer: a plain explode would make Spark test the array size
        # below this projection and so evaluate every rule twice.
        if hits is None:
            hits = sg.readable(classified).selectExpr("project_id", "path", f"{in_file} AS hits")
            stored = False
        else:
            missing = matched_rules(cfg, wanted) - set(hits.schema["hits"].metadata.get("rules", ()))
            if missing:
                raise ValueError(f"the stored hits lack {', '.join(sorted(missing))}")
            stored = True
        found = hits.selectExpr("project_id", "path", "CAST(NULL AS STRING) AS place", "explode_outer(hits) AS hit")
        if stored or rules is not None:
            found = found.filter(tx.is_in("substring_index(hit.key, '/', 1)", sorted(wanted)))
        if wanted & set(PROJECT_DECIDES) and project_signals is not None:
            found = _as_projects_decide(found, project_signals, cfg, wanted)
        parts.append(found)

    about_project = [r for r in cat.PROJECT_RULES if r in wanted]
    if about_project or "sec_dependencies" in wanted:
        # One branch tells all that is known of a project.
        conditions = project_conditions(cfg)
        cells = [f"CASE WHEN {conditions[r]} THEN struct(CAST(NULL AS STRING) AS path, '{'prompt' if r == 'prompt_clarity' else '.'}' AS place, "
                 f"{_hit(f'{r}/', detail=FUZZY_WORDS if r == 'prompt_clarity' else 'NULL')} AS hit) END" for r in about_project]
        if "sec_dependencies" in wanted:
            cells += [f"CASE WHEN dependency_readable AND dep_{p} THEN struct(dependency_file AS path, CAST(NULL AS STRING) AS place, "
                      f"{_hit(f'sec_dependencies/{p}')} AS hit) END" for p in cl.PACKAGES]
        parts.append(project_signals.selectExpr("project_id", f"explode_outer(array_compact(array({', '.join(cells)}))) AS x").selectExpr(
            "project_id", "x.path", "x.place", "x.hit"))

    if not parts:  # nothing is on
        parts.append(files.selectExpr("project_id", "path", "CAST(NULL AS STRING) AS place", f"CAST(NULL AS {HIT}) AS hit").limit(0))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return finish(rows, spark, cfg)


# What these rules find in a file counts or not by what is known of its project:
# the kind of the project, or that another file of it cannot be read.
PROJECT_DECIDES = ("sec_mcp_permissions", "prompt_injection", "maint_complexity")


def _as_projects_decide(found: DataFrame, project_signals: DataFrame, cfg: AuditConfig, wanted) -> DataFrame:
    """Of ``found``, what the projects let count.  A row for each project and
    rule where that is not the rule's usual case."""
    unusual = {
        "sec_mcp_permissions": "skill_type = 'mcp'", "prompt_injection": "prompt_unreadable",
        "maint_complexity": "readme_unreadable" if cfg.runs("maint_documentation") else "false"}
    cells = ", ".join(f"CASE WHEN {unusual[r]} THEN '{r}' END" for r in PROJECT_DECIDES if r in wanted)
    said = project_signals.selectExpr("project_id", f"explode(array_compact(array({cells}))) AS rule_id")
    # Rows of one project go apart by their rules.
    rows = found.withColumn("rule_id", F.substring_index("hit.key", "/", 1))
    marked = rows.join(said.withColumn("said", F.lit(True)), ["project_id", "rule_id"], "left")
    kept = marked.filter("CASE WHEN rule_id = 'sec_mcp_permissions' THEN coalesce(said, false) ELSE said IS NULL END")
    return kept.select(*found.columns)


# The prompt rules ran: there is prompt text and all of it could be read.
PROMPT_EVALUATED = "(has_prompt_text AND NOT prompt_unreadable)"
PROMPT_MISSING = "(NOT has_prompt_text AND NOT prompt_unreadable)"

FUZZY_WORDS = "array_join(array({}), ', ')".format(
    ", ".join(f"CASE WHEN fuzzy_{i} THEN {tx.q(w)} END" for i, w in enumerate(cat.FUZZY_WORDS)))
FUZZY_COUNT = "(" + " + ".join(f"CAST(fuzzy_{i} AS INT)" for i in range(len(cat.FUZZY_WORDS))) + ")"


def project_conditions(cfg: AuditConfig) -> dict[str, str]:
    """The condition of each rule with at most one finding per project."""
    maintained = "NOT readme_unreadable" if cfg.runs("maint_documentation") else "true"
    return {
        "prompt_missing": PROMPT_MISSING,
        "compat_protocol": "skill_type = 'mcp' AND NOT declares_version",
        "maint_documentation": "NOT readme_exists",
        "maint_tests": f"NOT has_tests AND {maintained}",
        "maint_versioning": f"NOT gitignore_exists AND {maintained}",
        "prompt_clarity": f"{PROMPT_EVALUATED} AND {FUZZY_COUNT} > 0",
    }


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("project_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
