"""Why a score is what it is: one row per remark, in order of ``seq`` and path.

Remarks about single files stay rows, since a project may have any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioscan.functions import text as tx
from folioscan.operators import classify as cl, findings as fd, scores as sc, signals as sg
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat


def _remarks() -> list[tuple[str, str, str, str]]:
    """(rule, code, condition, value) in the order they are made."""
    out = [
        ("compat_vendor_lock", "vendor_apis", "true", "CAST(n_vendor AS STRING)"),
        ("compat_platform", "no_platform_code", "n_platform = 0", "NULL"),
        ("corr_error_handling", "handled_files", "n_py > 0", "concat(n_handled, '/', n_py)"),
        ("corr_error_handling", "few_handled_files", sc._low_ratio("n_handled", "n_py", cat.MIN_RATIO), "NULL"),
        ("corr_hallucination_risk", "no_prompt_files", "n_prompt = 0", "NULL"),
        ("maint_documentation", "has_readme", "readme_exists", "NULL"),
        ("maint_documentation", "readme_short", "readme_short", "NULL"),
        *[("maint_documentation", f"readme_{c}", f"readme_{c}", "NULL") for c, _, _ in cat.README_WORDS],
        ("maint_tests", "has_tests", "has_tests", "NULL"),
        ("maint_tests", "test_ratio", "has_tests AND code_lines > 0", "concat(test_lines, '/', code_lines)"),
        ("maint_tests", "low_test_ratio", f"has_tests AND {sc._low_ratio('test_lines', 'code_lines', cat.MIN_TEST_RATIO)}", "NULL"),
        ("maint_tests", "good_test_ratio", "has_tests AND coalesce(test_lines / nullif(code_lines, 0) >= 0.5D, false)", "NULL"),
        ("maint_versioning", "has_changelog", "has_changelog", "NULL"),
        ("maint_versioning", "no_changelog", "NOT has_changelog", "NULL"),
        ("maint_versioning", "has_gitignore", "gitignore_exists", "NULL"),
        ("maint_versioning", "no_gitignore", "NOT gitignore_exists", "NULL"),
        ("maint_versioning", "no_version_file", "NOT has_version_file", "NULL"),
        ("maint_comments", "docstrings", "n_defs > 0", "concat(n_docstrings, '/', n_defs)"),
        ("maint_comments", "few_docstrings", sc._low_ratio("n_docstrings", "n_defs", cat.MIN_RATIO), "NULL"),
        ("maint_comments", "no_functions", "n_defs = 0", "NULL"),
        ("perf_token_cost", "no_tokens", "estimated_total_tokens = 0", "NULL"),
        ("perf_token_cost", "total_tokens", "estimated_total_tokens > 0", "CAST(estimated_total_tokens AS STRING)"),
        ("perf_token_cost", "cost_usd", "estimated_total_tokens > 0",
         "format_number(CAST(estimated_total_tokens AS DOUBLE) / 1000D * 0.03D, '0.0000')"),
        ("perf_token_cost", "token_band", "estimated_total_tokens > 0",
         f"CAST({sc._bands('estimated_total_tokens', cat.PROJECT_TOKEN_BANDS)} AS STRING)"),
        ("prompt_missing", "no_prompt", fd.PROMPT_MISSING, "NULL"),
        ("prompt_token_efficiency", "prompt_tokens", fd.PROMPT_EVALUATED, f"CAST({sc.PROMPT_TOKENS} AS STRING)"),
        ("prompt_token_efficiency", "token_band", f"{fd.PROMPT_EVALUATED} AND {sc.PROMPT_TOKENS} > {cat.PROMPT_TOKEN_BANDS[-1][0]}",
         f"CAST({sc._bands(sc.PROMPT_TOKENS, cat.PROMPT_TOKEN_BANDS)} AS STRING)"),
        ("prompt_token_efficiency", "duplicate_lines", f"{fd.PROMPT_EVALUATED} AND coalesce(n_duplicates, 0) > 3",
         "CAST(n_duplicates AS STRING)"),
        ("prompt_clarity", "no_role", f"{fd.PROMPT_EVALUATED} AND NOT has_role", "NULL"),
        ("prompt_clarity", "no_format", f"{fd.PROMPT_EVALUATED} AND NOT has_format", "NULL"),
        ("prompt_clarity", "has_steps", f"{fd.PROMPT_EVALUATED} AND has_steps", "NULL"),
        ("prompt_clarity", "no_steps", f"{fd.PROMPT_EVALUATED} AND NOT has_steps", "NULL"),
        ("prompt_specificity", "generic", f"{fd.PROMPT_EVALUATED} AND generic_request AND generic_pointer", "NULL"),
        ("prompt_specificity", "specific", f"{fd.PROMPT_EVALUATED} AND NOT (generic_request AND generic_pointer)", "NULL"),
        ("sec_dependencies", "no_dependency_file", "dependency_file IS NULL", "NULL"),
        ("sec_dependencies", "unreadable_dependency_file", "dependency_file IS NOT NULL AND NOT dependency_readable", "NULL"),
        ("sec_dependencies", "dependency_file", "coalesce(dependency_readable, false)", "dependency_file"),
        ("sec_dependencies", "no_risky_dependency", f"coalesce(dependency_readable, false) AND {sc._DEPENDENCY_HITS} = 0", "NULL"),
    ]
    return out


FILE_REMARKS = (
    ("compat_platform", "platform_code", f"is_py AND {tx.contains_any('text', cat.PLATFORM_WORDS)}"),
    ("corr_hallucination_risk", "invites_invention", sg.invites_hallucination()),
    ("corr_hallucination_risk", "no_invitation", f"is_prompt AND NOT ({sg.invites_hallucination()})"),
    ("perf_api_efficiency", "no_cache", sg.lacks_cache()),
)


def evidence(files: DataFrame, cfg: AuditConfig) -> DataFrame:
    """(project_id, dimension, rule_id, code, path, value, seq)."""
    classified = cl.classify(files)
    scores = sc.score_table(sg.project_signals(files, cfg, classified=classified), cfg)
    cells = ", ".join(
        f"CASE WHEN NOT {cat.RULE[r].dimension}_failed AND {c} THEN struct('{cat.RULE[r].dimension}' AS dimension, "
        f"'{r}' AS rule_id, '{code}' AS code, {v} AS value, {100 * cat.rank(r) + i} AS seq) END"
        for i, (r, code, c, v) in enumerate(_remarks()) if cfg.runs(r))
    project = scores.selectExpr("project_id", "CAST(NULL AS STRING) AS path", f"inline(array_compact(array({cells})))")
    cells = ", ".join(
        f"CASE WHEN {c} THEN struct('{cat.RULE[r].dimension}' AS dimension, '{r}' AS rule_id, '{code}' AS code, "
        f"CAST(NULL AS STRING) AS value, {100 * cat.rank(r) + 90} AS seq) END"
        for r, code, c in FILE_REMARKS if cfg.runs(r))
    remarks = sg.readable(classified).selectExpr("project_id", "path", f"array_compact(array({cells})) AS remarks")
    per_file = remarks.selectExpr("project_id", "path", "explode_outer(remarks) AS r").filter("r IS NOT NULL")
    columns = ["project_id", "dimension", "rule_id", "code", "path", "value", "seq"]
    return project.select(*columns).unionByName(per_file.select("project_id", "path", "r.*").select(*columns))
