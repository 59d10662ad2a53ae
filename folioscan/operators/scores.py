"""Sub-scores, dimension scores, the overall score and what follows from it.

Formulas are SQL expressions over the project signals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from folioscan.functions import text as tx
from folioscan.operators import classify as cl, findings as fd
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat

IS_MCP = "skill_type = 'mcp'"
PROMPT_TOKENS = "CAST(floor(prompt_chars / 3.5D) AS BIGINT)"
_DEPENDENCY_HITS = " + ".join(f"CAST(coalesce(dependency_readable AND dep_{p}, false) AS INT)" for p in cl.PACKAGES)


def _minus(*penalties: str, start: str = "100") -> str:
    return f"greatest(0, {start} - {' - '.join(f'({p})' for p in penalties)})"


def _if(condition: str, points: int, otherwise: str = "0") -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE {otherwise} END"


def _bands(value: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {value} > {limit} THEN {score}" for limit, score in bands) + " ELSE 100 END"


def _low_ratio(part: str, whole: str, limit: float) -> str:
    """part / whole < limit; false if there is no whole."""
    return f"coalesce({part} / nullif({whole}, 0) < {limit}D, false)"


SUB_SCORES = {
    ("M", "vendor_lock"): _minus("least(15 * n_vendor, 60)"),
    ("M", "protocol"): _minus(_if(f"{IS_MCP} AND NOT declares_version", 25)),
    ("M", "platform"): _minus("10 * n_platform"),
    ("M", "encoding"): _minus("10 * n_compat_encoding"),
    ("C", "error_handling"): _minus("15 * n_corr_error_handling", _if(_low_ratio("n_handled", "n_py", cat.MIN_RATIO), 20)),
    ("C", "type_safety"): _minus("15 * n_corr_type_safety"),
    ("C", "hallucination_risk"): _minus("25 * n_hallucination"),
    ("C", "validation"): _minus("20 * n_corr_validation"),
    ("C", "resource_cleanup"): _minus("15 * n_corr_resource_cleanup"),
    ("C", "input_sanitization"): _minus("15 * n_corr_input_sanitization"),
    ("X", "documentation"): _minus(
        _if("NOT readme_exists", 40), _if("readme_short", 15), _if("readme_no_install", 10),
        _if("readme_no_example", 10), _if("readme_no_license", 5)),
    ("X", "tests"): _if("NOT has_tests", 50, _minus(_if(_low_ratio("test_lines", "code_lines", cat.MIN_TEST_RATIO), 20))),
    ("X", "versioning"): _minus(
        _if("NOT has_changelog", 20), _if("NOT gitignore_exists", 15), _if("NOT has_version_file", 10)),
    ("X", "comments"): _minus(_if(_low_ratio("n_docstrings", "n_defs", cat.MIN_RATIO), 25)),
    ("X", "complexity"): _minus("least(10 * n_maint_complexity, 40)"),
    ("F", "token_cost"): _if("estimated_total_tokens = 0", 70, _bands("estimated_total_tokens", cat.PROJECT_TOKEN_BANDS)),
    ("F", "api_efficiency"): _minus("30 * n_perf_api_efficiency", "10 * n_uncached"),
    ("F", "latency"): _minus("15 * n_perf_latency"),
    ("F", "streaming"): _minus("10 * n_perf_streaming"),
    ("P", "injection"): _if("n_prompt_injection_critical + n_prompt_injection_warning > 0", 30, "100"),
    ("P", "token"): _minus(_if("coalesce(n_duplicates, 0) > 3", 15), start=_bands(PROMPT_TOKENS, cat.PROMPT_TOKEN_BANDS)),
    ("P", "clarity"): _minus(
        _if("NOT has_role", 20), _if("NOT has_format", 15), _if("NOT has_steps", 10), f"least(5 * {fd.FUZZY_COUNT}, 25)"),
    ("P", "specificity"): _minus(_if("generic_request AND generic_pointer", 30)),
    ("S", "secrets"): _minus("30 * n_sec_secrets_critical", "15 * n_sec_secrets_warning"),
    ("S", "dangerous"): _minus("20 * n_sec_dangerous_functions_warning"),
    ("S", "dependencies"): f"CASE WHEN coalesce(dependency_readable, false) THEN {_minus(f'15 * ({_DEPENDENCY_HITS})')} ELSE 70 END",
    ("S", "mcp"): _minus(f"CASE WHEN {IS_MCP} THEN 25 * n_sec_mcp_permissions ELSE 0 END"),
    ("S", "hardcoded_config"): _minus("10 * n_sec_hardcoded_config_info"),
    ("S", "insecure_network"): _minus("20 * n_sec_insecure_network_warning"),
    ("S", "logging_sensitive"): _minus("20 * n_sec_logging_sensitive_warning"),
}


def sub_score_expressions(cfg: AuditConfig, switch: Callable[[str], str] | None = None) -> dict[tuple[str, str], str]:
    """Each sub-score of the enabled dimensions; NULL where its rule is off, in
    ``cfg`` or by the condition that ``switch`` gives for the rule."""
    out = {}
    for (dim, sub), formula in SUB_SCORES.items():
        if dim not in cfg.enabled_dimensions():
            continue
        expr = formula if cfg.runs(cat.SUB_RULE[dim, sub]) else "NULL"
        if switch is not None:
            expr = f"CASE WHEN {switch(cat.SUB_RULE[dim, sub])} THEN {expr} END"
        if dim == "P":
            # Without prompt text every sub-score is 0, also of rules that are off.
            expr = f"CASE WHEN {fd.PROMPT_MISSING} THEN 0 ELSE {expr} END"
        out[dim, sub] = f"CASE WHEN NOT {dim}_failed THEN CAST({expr} AS INT) END"
    return out


def failed(cfg: AuditConfig, dimension: str) -> str:
    """A dimension fails as a whole if a file it must read cannot be read."""
    if dimension == "P":
        return "prompt_unreadable"
    if dimension == "X" and cfg.runs("maint_documentation"):
        return "readme_unreadable"
    return "false"


def weighted_score(dimension: str) -> str:
    """Weighted sum in a fixed order; a sub-score that is off counts as 100."""
    terms = [f"{w}D * coalesce({dimension}_{s}, 100)" for s, w in cat.SUB_WEIGHTS[dimension]]
    return f"CASE WHEN {dimension}_failed THEN 0 ELSE CAST({' + '.join(terms)} AS INT) END"


def weight(cfg: AuditConfig, dimension: str) -> str:
    """A failed dimension weighs 1."""
    return f"CASE WHEN {dimension}_failed THEN 1.0D ELSE {float(cfg.weight(dimension))!r}D END"


def overall_score(cfg: AuditConfig) -> str:
    """Weighted mean of the dimensions, added up in their fixed order."""
    dims = cfg.enabled_dimensions()
    if not dims:
        return "0"
    total = " + ".join(f"{d} * {weight(cfg, d)}" for d in dims)
    weights = " + ".join(weight(cfg, d) for d in dims)
    return f"coalesce(CAST(({total}) / nullif({weights}, 0.0D) AS INT), 0)"


def score_table(project_signals: DataFrame, cfg: AuditConfig) -> DataFrame:
    """One wide row per project: ``<D>_<sub>`` sub-scores (NULL where a rule is
    off), ``<D>`` scores, ``<D>_failed`` and ``overall``."""
    dims = cfg.enabled_dimensions()
    wide = project_signals.selectExpr("*", *[f"{failed(cfg, d)} AS {d}_failed" for d in dims])
    wide = wide.selectExpr("*", *[f"{c} AS {d}_{s}" for (d, s), c in sub_score_expressions(cfg).items()])
    wide = wide.selectExpr("*", *[f"{weighted_score(d)} AS {d}" for d in dims])
    return wide.selectExpr("*", f"{overall_score(cfg)} AS overall")


def _subs(dimension: str) -> list[str]:
    return [s for s, _ in cat.SUB_WEIGHTS[dimension]]


def sub_scores(scores: DataFrame, cfg: AuditConfig, dimensions=None) -> DataFrame:
    """Long form: (project_id, dimension, sub, score)."""
    cells = ", ".join(
        f"struct('{d}' AS dimension, '{s}' AS sub, {d}_{s} AS score)"
        for d in dimensions or cfg.enabled_dimensions() for s in _subs(d))
    return scores.selectExpr("project_id", f"inline(array({cells}))").filter("score IS NOT NULL")


def _dimension_cells(cfg: AuditConfig, scores: DataFrame, dimensions=None) -> list[tuple[str, str]]:
    cells = []
    for d in dimensions or cfg.enabled_dimensions():
        entries = ", ".join(f"CASE WHEN {d}_{s} IS NOT NULL THEN struct('{s}' AS k, {d}_{s} AS v) END" for s in _subs(d))
        entries = f"array_compact(array({entries}))"
        if f"{d}_merged" in scores.columns:  # blended with a judge's
            entries = f"CASE WHEN {d}_judged THEN {d}_merged ELSE {entries} END"
        cells.append((d, (
            f"CASE WHEN {d}_failed THEN 'error' ELSE '{cat.DIMENSION_NAMES[d]}' END AS name, "
            f"{d} AS score, {weight(cfg, d)} AS weight, map_from_entries({entries}) AS sub_scores")))
    return cells


def dimension_scores(scores: DataFrame, cfg: AuditConfig, dimensions=None) -> DataFrame:
    """(project_id, dimension, name, score, weight, sub_scores)."""
    cells = ", ".join(f"struct('{d}' AS dimension, {fields})" for d, fields in _dimension_cells(cfg, scores, dimensions))
    return scores.selectExpr("project_id", f"inline(array({cells}))")


def errors(scores: DataFrame, cfg: AuditConfig) -> DataFrame:
    """One critical finding for each dimension that failed.  It belongs to the
    dimension only; the audit's own counts leave it out."""
    cells = ", ".join(
        f"CASE WHEN {d}_failed THEN struct('{d}' AS dimension, 'critical' AS severity, 'engine_error' AS category, "
        "'engine' AS location, 'a file could not be read' AS message) END" for d in cfg.enabled_dimensions())
    return scores.selectExpr("project_id", f"inline(array_compact(array({cells})))")


def severity_counts(cfg: AuditConfig, dimension: str | None = None, switch: Callable[[str], str] | None = None,
                    severity: Callable[[str, str], str] | None = None) -> dict[str, str]:
    """Findings per severity, of one dimension's rules or all, from the signals
    alone: nothing is exploded.  ``switch`` and ``severity`` give a rule's switch
    and severity as SQL."""
    totals = {s: ["0"] for s in cat.SEVERITIES}

    def add(rule, own, expr):
        if switch is None:
            totals[cfg.severity(rule.rule_id, own)].append(f"({expr})")
            return
        for s in cat.SEVERITIES:
            totals[s].append(f"CASE WHEN {switch(rule.rule_id)} AND {severity(rule.rule_id, own)} = '{s}' THEN ({expr}) ELSE 0 END")

    readme_ok = "NOT X_failed"
    for rule in cat.RULES:
        r = rule.rule_id
        if not cfg.runs(r) or dimension not in (None, rule.dimension):
            continue
        if r in cat.MATCH_RULES or r == "prompt_injection":
            for own in dict.fromkeys(p.severity for p in rule.patterns):
                n = f"n_{r}_{own}"
                add(rule, own, f"CASE WHEN {fd.PROMPT_EVALUATED} THEN {n} ELSE 0 END" if r == "prompt_injection" else n)
        elif r == "compat_vendor_lock":
            add(rule, rule.severity, "n_vendor")
        elif r == "maint_complexity":
            add(rule, rule.severity, f"CASE WHEN {readme_ok} THEN n_{r} ELSE 0 END")
        elif r in cat.FILE_RULES:
            add(rule, rule.severity, f"n_{r}")
        elif r == "sec_dependencies":
            add(rule, rule.severity, _DEPENDENCY_HITS)
        elif r == "sec_mcp_permissions":
            add(rule, rule.severity, f"CASE WHEN {IS_MCP} THEN n_{r} ELSE 0 END")
        elif r in cat.PROJECT_RULES:
            add(rule, rule.severity, _if(fd.project_conditions(cfg)[r], 1))
    return {s: f"CAST({' + '.join(parts)} AS BIGINT)" for s, parts in totals.items()}


def with_counts(scores: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``more_<severity>``: findings that the signals know nothing of."""
    counts = found.groupBy("project_id").agg(*[F.expr(f"count_if(severity = '{s}') AS more_{s}") for s in cat.SEVERITIES])
    more = [f"coalesce(more_{s}, 0L) AS more_{s}" for s in cat.SEVERITIES]
    return scores.join(counts, "project_id", "left").selectExpr(*[f"`{c}`" for c in scores.columns], *more)


def audits(scores: DataFrame, cfg: AuditConfig, nested: bool = False) -> DataFrame:
    """One row per project: scores, finding counts, band, summary and gate;
    ``nested`` adds the dimension scores as one struct."""
    dims = cfg.enabled_dimensions()
    inner = ", ".join(f"struct({fields}) AS {d}" for d, fields in _dimension_cells(cfg, scores))
    rows = scores.selectExpr(
        "project_id", "skill_type", "n_files AS files_scanned", "overall", *dims,
        *[f"{c}{f' + more_{s}' if f'more_{s}' in scores.columns else ''} AS n_{s}" for s, c in severity_counts(cfg).items()],
        *([f"struct({inner}) AS dimension_scores"] if nested else []))
    return with_summary(rows, cfg)


def with_summary(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Adds band, passed and summary to scores and counts."""
    dims = cfg.enabled_dimensions()
    return rows.selectExpr(
        "*", f"{score_band('overall')} AS band", f"{gate('overall', cfg.fail_threshold)} AS passed"
    ).selectExpr("*", f"{summary(dims)} AS summary")


def score_band(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {n} THEN '{b}'" for n, b in cat.SCORE_BANDS) + f" ELSE '{cat.LOWEST_BAND}' END"


def gate(score: str, threshold: int | None) -> str:
    """False only if there is a threshold and the score is below it."""
    return "true" if threshold is None else f"({score} >= {threshold})"


def summary(dims) -> str:
    counts = ", ".join(f"n_{s}, ' {s}, '" for s in cat.SEVERITIES)
    return (
        "concat(" + tx.q("Project '") + ", CAST(project_id AS STRING), " + tx.q("' (") + ", skill_type, '): ', overall, "
        f"'/100 (', band, '). Findings: ', {counts}, 'scores: ', "
        + "concat_ws(', '" + "".join(f", concat('{d}=', {d})" for d in dims) + "))")


def dimension_gate(scores: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Each dimension against its own pass mark."""
    cells = ", ".join(
        f"struct('{d}' AS dimension, {d} AS score, {cfg.dimensions[d].threshold} AS threshold, "
        f"{d} >= {cfg.dimensions[d].threshold} AS passed)" for d in cfg.enabled_dimensions())
    return scores.selectExpr("project_id", f"inline(array({cells}))")
