"""The registered queries as plain SQL for an independent engine.

Written apart from the Spark code: patterns in their plain form, line numbers
from the pieces between matches, line rules over exploded lines, state machines
as windows.  Only the catalog's fixed values are shared.
"""

from __future__ import annotations

from folioscan.functions.text import BREAK_CLASS, SPACE_CHARS, re2
from folioscan.operators import fixes as fx, judges as jd
from folioscan.plans.config import AuditConfig, layered_config
from folioscan.rules import catalog as cat
from folioscan.workloads import corpus, queries as qs


def q(value: str) -> str:
    """A standard SQL string literal; control characters by code."""
    parts, plain = [], ""
    for ch in value:
        if ord(ch) < 32 or ord(ch) == 127:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
            parts.append(f"chr({ord(ch)})")
            plain = ""
        else:
            plain += ch
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def rx(pattern: str) -> str:
    return q(re2(pattern))


# Plain forms of the patterns that the Spark side writes without rescanning.
DEF = r"(?m)^\s*def\s+\w+\s*\("
SIGNATURE = r"(?m)^\s*def\s+\w+\s*\([^)]*\)"
TYPED = r"(?m)^\s*def\s+\w+\s*\(([^)]*)\)(\s*->\s*[^:#]+)?"
DOCSTRING = r'\n\s*"""'


def has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def has_all(text: str, words) -> str:
    return "(" + " AND ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def has_ci(text: str, words) -> str:
    special = r"\.+*?()|[]{}^$"
    pattern = "(?i)(" + "|".join("".join("\\" + c if c in special else c for c in w) for w in words) + ")"
    return f"regexp_matches({text}, {q(pattern)})"


def match(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {rx(pattern)})"


def n_matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {rx(pattern)}))"


def one_of(value: str, options) -> str:
    return f"{value} IN ({', '.join(q(o) for o in options)})"


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def lines(text: str) -> str:
    """The lines of a text without an empty last one."""
    parts = f"string_split_regex({text}, {q('[' + BREAK_CLASS + ']')})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


SPACES = q(SPACE_CHARS)
SEEDED, TALK = "seeded", "talk"

SOURCES = {
    "seeded": f"seeded_files AS ({corpus.SEEDED_FILES_SQL})",
    "talk": f"files AS ({corpus.CONVERSATION_FILES_SQL})",
    "unreadable": f"seeded_files AS ({corpus.SEEDED_FILES_SQL}), files AS ({corpus.UNREADABLE_FILES_SQL})",
    "earlier": f"seeded_files AS ({corpus.SEEDED_FILES_SQL}), files AS ({corpus.EARLIER_FILES_SQL})",
    "single": "files AS (SELECT 'doc_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS project_id, "
              "'doc_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path, text AS content FROM documents)",
    # Two projects with the same paths.
    "shared": f"files AS (SELECT project_id || '/' || path AS project_id, path, content FROM ({corpus.SHARED_PATHS_SQL}))",
}


def classified(source: str = "seeded") -> str:
    """WITH ... up to ``k``, the classified files."""
    table = "seeded_files" if source == "seeded" else "files"
    marked = has_ci("text", cat.PROMPT_MARKERS)
    kind = (
        f"CASE WHEN {one_of('ext', cat.CODE_SUFFIXES)} THEN 'code' WHEN {one_of('ext', cat.PROMPT_SUFFIXES)} THEN 'prompt' "
        f"WHEN coalesce({marked}, false) THEN 'prompt' WHEN {one_of('ext', cat.CONFIG_SUFFIXES)} THEN 'config' ELSE 'other' END")
    if source in ("single", "shared"):
        kind = f"CASE WHEN {one_of('ext', cat.PROMPT_SUFFIXES)} THEN 'prompt' ELSE 'single' END"
    ext = q(r"[^/](\.[^./]+)$")
    return f"""WITH {SOURCES[source]},
f0 AS (SELECT project_id, path, content, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text,
  split_part(path, '/', -1) AS name, lower(regexp_extract(path, {ext}, 1)) AS ext FROM {table}),
f1 AS (SELECT *, {kind} AS kind, lower(text) AS ltext FROM f0),
k AS MATERIALIZED (SELECT *, kind = 'code' AND path LIKE '%.py' AS is_py, kind = 'prompt' AS is_prompt FROM f1),
ln AS MATERIALIZED (SELECT project_id, path, kind, is_py, is_prompt, CAST(i AS BIGINT) AS line_no, ls[i] AS line FROM
  (SELECT *, {lines('text')} AS ls FROM k WHERE is_py OR is_prompt) s, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u)"""


def loop_ctes() -> str:
    """``loops``: files with a model call below a loop header.

    Each header opens a group of lines; a line of the group is inside as long as
    every line from the header on is indented deeper than the header."""
    return f""",
lb AS (SELECT project_id, path, line_no, line, trim(line, {SPACES}) AS body,
  length(line) - length(ltrim(line, {SPACES})) AS indent FROM ln WHERE is_py),
lc AS (SELECT *, regexp_matches(body, {rx(cat.LOOP_HEADER_REGEX)}) AS header FROM lb WHERE body <> '' AND body NOT LIKE '#%'),
lg AS (SELECT *, sum(CAST(header AS INT)) OVER w AS g FROM lc WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no)),
lh AS (SELECT *, max(CASE WHEN header THEN indent END) OVER (PARTITION BY project_id, path, g) AS head,
  min(CASE WHEN NOT header THEN indent END) OVER (PARTITION BY project_id, path, g ORDER BY line_no) AS low FROM lg WHERE g > 0),
loops AS (SELECT DISTINCT project_id, path FROM lh WHERE NOT header AND low > head AND {has('line', *cat.LOOP_API_WORDS)})"""


WORDS_SPLIT = r"[^\p{L}\p{N}_]+"
BRANCHES = (f"len(list_filter(regexp_split_to_array(text, {q(WORDS_SPLIT)}), "
            f"lambda x: {one_of('x', cat.BRANCH_WORDS)}))")

FEW_TYPES = (
    f"coalesce(len(list_filter(list_zip(regexp_extract_all(text, {rx(TYPED)}, 1), regexp_extract_all(text, {rx(TYPED)}, 2)), "
    f"lambda z: coalesce(z[2], '') <> '' OR contains(z[1], ':'))) / nullif({n_matches('text', SIGNATURE)}, 0) < 0.3, false)")

CONDITIONS = {
    "compat_encoding": f"is_py AND {has('text', '.read()')} AND NOT {has('text', 'encoding=')}",
    "corr_error_handling": f"is_py AND {match('text', cat.BARE_EXCEPT_REGEX)}",
    "corr_type_safety": f"is_py AND {FEW_TYPES}",
    "corr_validation": f"is_py AND {has('text', 'openai')} AND NOT {has('text', *cat.VALIDATION_WORDS)}",
    "corr_resource_cleanup": f"is_py AND {match('text', cat.OPEN_REGEX)} AND NOT {has('text', 'with ')}",
    "corr_input_sanitization": f"is_py AND {has('text', *cat.USER_INPUT_WORDS)} AND NOT {has('text', *cat.SANITIZER_WORDS)}",
    "maint_complexity": f"is_py AND {BRANCHES} > 30",
    "perf_api_efficiency": "is_py AND (project_id, path) IN (SELECT project_id, path FROM loops)",
    "perf_latency": f"is_py AND {has('text', *cat.BLOCKING_API_WORDS)} AND NOT {has('text', *cat.ASYNC_WORDS)}",
    "perf_streaming": f"is_py AND {has('text', *cat.STREAM_API_WORDS)} AND NOT {match('text', cat.STREAM_ON_REGEX)}",
}

HALLUCINATION = (f"is_prompt AND ({has_ci('text', cat.INVENT_WORDS)} OR {has_ci('text', cat.GUESS_WORDS)} "
                 f"OR {match('text', cat.ASSUME_REGEX)})")
UNCACHED = f"is_py AND {has('text', *cat.API_WORDS)} AND NOT contains(ltext, 'cache')"
MCP_WIDE = f"kind = 'config' AND path LIKE '%.json' AND {has_all('ltext', cat.MCP_PERMISSION_WORDS)}"


def match_rows() -> str:
    """One row per match of the match rules."""
    parts = []
    for rule_id in cat.MATCH_RULES:
        scope = "kind IN ('code', 'config')" if rule_id == "sec_secrets" else "is_py"
        for p in cat.RULE[rule_id].patterns:
            parts.append(
                f"SELECT '{rule_id}/{p.key}' AS key, project_id, path, kind, regexp_extract_all(text, {rx(p.regex)}) AS m, "
                f"string_split_regex(text, {rx(p.regex)}) AS b FROM k WHERE {scope} AND {match('text', p.regex)}")
    at = f"1 + {newlines(chr(39) * 2 + ' || array_to_string(b[1:i], ' + chr(39) * 2 + ')')} + " \
         f"{newlines(chr(39) * 2 + ' || array_to_string(m[1:i-1], ' + chr(39) * 2 + ')')}"
    detail = ("CASE WHEN key LIKE 'sec_secrets/%' THEN substr(m[i], 1, 20) || '...' "
              "WHEN key LIKE 'sec_hardcoded_config/%' THEN substr(m[i], 1, 40) END")
    return (f"SELECT key, project_id, path, {at} AS line, i AS pos, CASE WHEN key LIKE 'sec_secrets/%' AND kind = 'config' "
            f"THEN 1 ELSE 0 END AS grp, {detail} AS detail FROM ({' UNION ALL '.join(parts)}) t, "
            "LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) u")


def injection_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT 'prompt_injection/{p.key}' AS key, project_id, path, line_no AS line, line_no AS pos, "
        f"{2 * i} + CAST(is_prompt AS INT) AS grp, NULL AS detail FROM ln WHERE {match('line', p.regex)}"
        for i, p in enumerate(cat.INJECTION_PATTERNS))


def catalog_values(cfg: AuditConfig = qs.DEFAULT) -> str:
    rows = ", ".join(
        f"({q(r['key'])}, {q(r['rule_id'])}, {q(r['pattern_id'])}, {r['pattern_rank']}, {r['rule_rank']}, {q(r['dimension'])}, "
        f"{q(cfg.severity(r['rule_id'], r['severity']))}, {q(r['category'])}, {q(r['message'])}, {q(r['fix_hint'])}, "
        f"{str(r['auto_fixable']).lower()}, {q(r['fix_safety'])})" for r in cat.rows())
    return ("catalog(key, rule_id, pattern_id, pattern_rank, rule_rank, dimension, severity, category, message, fix_hint, "
            f"auto_fixable, fix_safety) AS (VALUES {rows})")


def features(source: str = "seeded") -> str:
    """WITH ... up to ``feat``, one row per project."""
    ps = "(is_py OR is_prompt)"
    sums = {
        "n_files": "1", "n_code": "kind = 'code'", "n_prompt": "kind = 'prompt'", "n_config": "kind = 'config'",
        "estimated_total_tokens": "CASE WHEN kind <> 'other' THEN floor(length(text) / 3.5::DOUBLE) END",
        "n_py": "is_py AND text IS NOT NULL",
        "prompt_chars": f"CASE WHEN {ps} THEN length(text) + 1 END",
        "test_lines": f"CASE WHEN path LIKE '%.py' AND contains(lower(path), 'test') THEN len({lines('text')}) END",
        "code_lines": f"CASE WHEN path LIKE '%.py' AND NOT contains(lower(path), 'test') THEN len({lines('text')}) END",
        "n_defs": f"CASE WHEN is_py THEN {n_matches('text', DEF)} END",
        "n_docstrings": f"CASE WHEN is_py THEN {n_matches('text', DOCSTRING)} END",
        "n_uncached": UNCACHED, "n_handled": f"is_py AND {has_all('text', ('try:', 'except'))}",
        "n_hallucination": HALLUCINATION, "n_platform": f"is_py AND {has('text', *cat.PLATFORM_WORDS)}",
        "n_mcp_wide": MCP_WIDE,
        "n_vendor": "CASE WHEN is_py THEN " + " + ".join(f"CAST({match('text', p.regex)} AS INT)" for p in cat.VENDOR_PATTERNS) + " END",
        **{f"n_{r}": c for r, c in CONDITIONS.items()},
    }
    flags = {
        "has_prompt_text": f"{ps} AND trim(text, {SPACES}) <> ''", "prompt_unreadable": f"{ps} AND text IS NULL",
        "readme_exists": "lower(name) = 'readme.md'", "gitignore_exists": "name = '.gitignore'",
        "path_mcp": has("lower(path)", *cat.MCP_PATH_WORDS), "path_rag": has("lower(path)", *cat.RAG_PATH_WORDS),
        "path_tool": has("lower(path)", "tool"), "path_agent": has("lower(path)", *cat.AGENT_PATH_WORDS),
        "has_role": f"{ps} AND {has_ci('text', cat.ROLE_WORDS)}", "has_format": f"{ps} AND {has_ci('text', cat.FORMAT_WORDS)}",
        "has_steps": f"{ps} AND {has_ci('text', cat.STEP_WORDS)}",
        "generic_request": f"{ps} AND {has_ci('text', cat.GENERIC_REQUEST_WORDS)}",
        "generic_pointer": f"{ps} AND {has_ci('text', cat.GENERIC_POINTER_WORDS)}",
        **{f"fuzzy_{i}": f"{ps} AND {has('text', w)}" for i, w in enumerate(cat.FUZZY_WORDS)},
        "readme_unreadable": "path = 'README.md' AND text IS NULL",
        "readme_short": "path = 'README.md' AND length(text) < 200",
        **{f"readme_{c}": f"path = 'README.md' AND NOT ({has('ltext', w)} OR {has('text', o)})" for c, w, o in cat.README_WORDS},
        "has_tests": "contains(lower(path), 'test')", "has_changelog": "contains(lower(path), 'change')",
        "has_version_file": one_of("path", cat.VERSION_FILES),
        "declares_version": f"kind = 'config' AND path LIKE '%.json' AND {has('text', *cat.VERSION_KEYS)}",
    }
    columns = [f"CAST(coalesce(sum(CAST({e} AS BIGINT)), 0) AS BIGINT) AS {n}" for n, e in sums.items()]
    columns += [f"coalesce(bool_or({e}), false) AS {n}" for n, e in flags.items()]
    deps = ", ".join(f"contains(lower(text), '{p}') AS dep_{p}" for p, _ in cat.RISKY_PACKAGES)
    depflags = ", ".join(f"coalesce(dep_{p}, false) AS dep_{p}" for p, _ in cat.RISKY_PACKAGES)
    skill = (
        "CASE WHEN path_mcp OR coalesce(config_mcp, false) THEN 'mcp' WHEN path_rag THEN 'rag' WHEN path_tool AND n_code > 0 THEN 'tool' "
        "WHEN path_agent THEN 'agent_workflow' WHEN n_prompt > 0 AND n_code = 0 THEN 'prompt' "
        "WHEN n_prompt > 0 THEN 'hybrid' ELSE 'unknown' END")
    lone = ""
    if source in ("single", "shared"):  # nothing is told from the name of a lone file
        skill = "CASE WHEN n_prompt > 0 THEN 'prompt' ELSE 'unknown' END"
        lone = " REPLACE (" + ", ".join(f"false AS {n}" for n in (
            "readme_exists", "gitignore_exists", "readme_unreadable", "readme_short", "dependency_readable",
            *(f"readme_{c}" for c, _, _ in cat.README_WORDS))) + ")"
    return classified(source) + loop_ctes() + f""",
sums AS (SELECT project_id, {', '.join(columns)} FROM k GROUP BY project_id),
dep AS (SELECT project_id, path AS dependency_file, text IS NOT NULL AS dependency_readable, {deps} FROM
  (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path DESC) AS rn FROM k WHERE {one_of('name', cat.DEPENDENCY_FILES)}) d
  WHERE rn = 1),
cfg AS (SELECT project_id, bool_or(contains(ltext, 'mcp')) AS config_mcp FROM k WHERE kind = 'config' GROUP BY project_id),
dup AS (SELECT project_id, count(*) AS n_lines, count(*) - count(DISTINCT trim(line, {SPACES})) AS n_duplicates FROM ln
  WHERE trim(line, {SPACES}) <> '' GROUP BY project_id),
hits AS MATERIALIZED ({match_rows()} UNION ALL {injection_rows()}),
hitn AS (SELECT project_id, {', '.join(f"count(*) FILTER (WHERE split_part(key, '/', 1) = '{r}' AND severity = '{s}') AS n_{r}_{s}"
         for r in (*cat.MATCH_RULES, 'prompt_injection') for s in cat.SEVERITIES)} FROM hits
  JOIN (VALUES {', '.join(f"('{r['key']}', '{r['severity']}')" for r in cat.rows())}) sev(key, severity) USING (key) GROUP BY project_id),
j AS (SELECT sums.*, dependency_file, coalesce(dependency_readable, false) AS dependency_readable, {depflags}, config_mcp,
  coalesce(n_duplicates, 0) AS n_duplicates,
  {', '.join(f"coalesce(n_{r}_{s}, 0) AS n_{r}_{s}" for r in (*cat.MATCH_RULES, 'prompt_injection') for s in cat.SEVERITIES)}
  FROM sums LEFT JOIN dep USING (project_id) LEFT JOIN cfg USING (project_id) LEFT JOIN dup USING (project_id) LEFT JOIN hitn USING (project_id)),
feat AS MATERIALIZED (SELECT *{lone}, {skill} AS skill_type, has_prompt_text AND NOT prompt_unreadable AS p_ok,
  NOT has_prompt_text AND NOT prompt_unreadable AS p_missing FROM j)"""


FUZZY_N = "(" + " + ".join(f"CAST(fuzzy_{i} AS INT)" for i in range(len(cat.FUZZY_WORDS))) + ")"
FUZZY_LIST = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN fuzzy_{i} THEN {q(w)} END" for i, w in enumerate(cat.FUZZY_WORDS)) + "], lambda x: x IS NOT NULL), ', ')"
DEP_N = "(" + " + ".join(f"CAST(dependency_readable AND dep_{p} AS INT)" for p, _ in cat.RISKY_PACKAGES) + ")"

PROJECT_CONDITIONS = {
    "compat_protocol": "skill_type = 'mcp' AND NOT declares_version",
    "maint_documentation": "NOT readme_exists",
    "maint_tests": "NOT has_tests AND NOT readme_unreadable",
    "maint_versioning": "NOT gitignore_exists AND NOT readme_unreadable",
    "prompt_missing": "p_missing",
    "prompt_clarity": f"p_ok AND {FUZZY_N} > 0",
}


def findings(source: str = "seeded", cfg: AuditConfig = qs.DEFAULT) -> str:
    """WITH ... up to ``found``, all findings."""
    parts = ["SELECT key, project_id, path, line, pos, grp, detail, NULL AS place FROM hits"]
    for r, c in CONDITIONS.items():
        detail = f"'about ' || {BRANCHES}" if r == "maint_complexity" else "NULL"
        parts.append(f"SELECT '{r}/', project_id, path, NULL, 0, 0, {detail}, NULL FROM k WHERE {c}")
    for p in cat.VENDOR_PATTERNS:
        parts.append(f"SELECT 'compat_vendor_lock/{p.key}', project_id, path, NULL, 0, 0, NULL, NULL FROM k WHERE is_py AND {match('text', p.regex)}")
    for p, _ in cat.RISKY_PACKAGES:
        parts.append(f"SELECT 'sec_dependencies/{p}', project_id, dependency_file, NULL, 0, 0, NULL, NULL FROM feat WHERE dependency_readable AND dep_{p}")
    parts.append("SELECT 'sec_mcp_permissions/', project_id, path, NULL, 0, 0, NULL, NULL FROM k "
                 f"WHERE {MCP_WIDE} AND project_id IN (SELECT project_id FROM feat WHERE skill_type = 'mcp')")
    for r, c in PROJECT_CONDITIONS.items():
        detail, place = (FUZZY_LIST, "'prompt'") if r == "prompt_clarity" else ("NULL", "'.'")
        parts.append(f"SELECT '{r}/', project_id, NULL, NULL, 0, 0, {detail}, {place} FROM feat WHERE {c}")
    return features(source) + f""",
{catalog_values(cfg)},
allhits AS ({' UNION ALL '.join(parts)}),
found AS MATERIALIZED (SELECT project_id, dimension, rule_id, pattern_id, severity, category, path, CAST(line AS BIGINT) AS line,
  coalesce(path, place) || coalesce(':' || line, '') AS location, message || coalesce(': ' || detail, '') AS message,
  fix_hint, auto_fixable, fix_safety, rule_rank, grp AS group_rank, pattern_rank, pos
  FROM allhits JOIN catalog USING (key)
  WHERE NOT (dimension = 'P' AND rule_id <> 'prompt_missing' AND project_id IN (SELECT project_id FROM feat WHERE prompt_unreadable))
    AND NOT (dimension = 'X' AND project_id IN (SELECT project_id FROM feat WHERE readme_unreadable)))"""


def _low(part: str, whole: str, limit: float) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0) < {limit}, false)"


def _off(condition: str, points: int) -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE 0 END"


SUBS = {
    "M_vendor_lock": "100 - least(15 * n_vendor, 60)",
    "M_protocol": f"100 - {_off(PROJECT_CONDITIONS['compat_protocol'], 25)}",
    "M_platform": "100 - 10 * n_platform",
    "M_encoding": "100 - 10 * n_compat_encoding",
    "C_error_handling": f"100 - 15 * n_corr_error_handling - {_off(_low('n_handled', 'n_py', 0.3), 20)}",
    "C_type_safety": "100 - 15 * n_corr_type_safety",
    "C_hallucination_risk": "100 - 25 * n_hallucination",
    "C_validation": "100 - 20 * n_corr_validation",
    "C_resource_cleanup": "100 - 15 * n_corr_resource_cleanup",
    "C_input_sanitization": "100 - 15 * n_corr_input_sanitization",
    "X_documentation": (f"100 - {_off('NOT readme_exists', 40)} - {_off('readme_short', 15)} - {_off('readme_no_install', 10)} "
                        f"- {_off('readme_no_example', 10)} - {_off('readme_no_license', 5)}"),
    "X_tests": f"100 - CASE WHEN NOT has_tests THEN 50 WHEN {_low('test_lines', 'code_lines', 0.1)} THEN 20 ELSE 0 END",
    "X_versioning": (f"100 - {_off('NOT has_changelog', 20)} - {_off('NOT gitignore_exists', 15)} - {_off('NOT has_version_file', 10)}"),
    "X_comments": f"100 - {_off(_low('n_docstrings', 'n_defs', 0.3), 25)}",
    "X_complexity": "100 - least(10 * n_maint_complexity, 40)",
    "F_token_cost": ("CASE WHEN estimated_total_tokens = 0 THEN 70 WHEN estimated_total_tokens > 16000 THEN 30 "
                     "WHEN estimated_total_tokens > 8000 THEN 50 WHEN estimated_total_tokens > 4000 THEN 75 ELSE 100 END"),
    "F_api_efficiency": "100 - 30 * n_perf_api_efficiency - 10 * n_uncached",
    "F_latency": "100 - 15 * n_perf_latency",
    "F_streaming": "100 - 10 * n_perf_streaming",
    "P_injection": "CASE WHEN n_prompt_injection_critical + n_prompt_injection_warning > 0 THEN 30 ELSE 100 END",
    "P_token": ("CASE WHEN floor(prompt_chars / 3.5::DOUBLE) > 8000 THEN 20 WHEN floor(prompt_chars / 3.5::DOUBLE) > 4000 THEN 40 "
                f"WHEN floor(prompt_chars / 3.5::DOUBLE) > 2000 THEN 70 ELSE 100 END - {_off('n_duplicates > 3', 15)}"),
    "P_clarity": (f"100 - {_off('NOT has_role', 20)} - {_off('NOT has_format', 15)} - {_off('NOT has_steps', 10)} "
                  f"- least(5 * {FUZZY_N}, 25)"),
    "P_specificity": f"100 - {_off('generic_request AND generic_pointer', 30)}",
    "S_secrets": "100 - 30 * n_sec_secrets_critical - 15 * n_sec_secrets_warning",
    "S_dangerous": "100 - 20 * n_sec_dangerous_functions_warning",
    "S_dependencies": f"CASE WHEN dependency_readable THEN 100 - 15 * {DEP_N} ELSE 70 END",
    "S_mcp": "100 - CASE WHEN skill_type = 'mcp' THEN 25 * n_mcp_wide ELSE 0 END",
    "S_hardcoded_config": "100 - 10 * n_sec_hardcoded_config_info",
    "S_insecure_network": "100 - 20 * n_sec_insecure_network_warning",
    "S_logging_sensitive": "100 - 20 * n_sec_logging_sensitive_warning",
}


def scores(source: str = "seeded", cfg: AuditConfig = qs.DEFAULT, base: str | None = None) -> str:
    """WITH ... up to ``score``: sub-scores, dimension scores, overall."""
    dims = cfg.enabled_dimensions()
    failed = {"P": "prompt_unreadable", "X": "readme_unreadable"}
    subs = []
    for name, e in SUBS.items():
        d, s = name.split("_", 1)
        if d not in dims:
            continue
        value = f"greatest({e}, 0)" if cfg.runs(cat.SUB_RULE[d, s]) else "NULL"
        if d == "P":
            value = f"CASE WHEN p_missing THEN 0 ELSE {value} END"
        if d in failed:
            value = f"CASE WHEN NOT {failed[d]} THEN {value} END"
        subs.append(f"CAST({value} AS BIGINT) AS {name}")
    totals = []
    for d in dims:
        total = " + ".join(f"{w}::DOUBLE * coalesce({d}_{s}, 100)" for s, w in cat.SUB_WEIGHTS[d])
        totals.append(f"CASE WHEN {failed.get(d, 'false')} THEN 0 ELSE CAST(trunc({total}) AS BIGINT) END AS {d}")
    return (base or features(source)) + f""",
sub AS (SELECT *, {', '.join(subs)} FROM feat),
dims AS (SELECT *, {', '.join(totals)} FROM sub),
score AS MATERIALIZED (SELECT *, {overall(cfg)} AS overall FROM dims)"""


def overall(cfg: AuditConfig = qs.DEFAULT) -> str:
    failed = {"P": "prompt_unreadable", "X": "readme_unreadable"}
    dims = cfg.enabled_dimensions()
    w = {d: f"(CASE WHEN {failed.get(d, 'false')} THEN 1::DOUBLE ELSE {cfg.weight(d)}::DOUBLE END)" for d in dims}
    return f"CAST(trunc(({' + '.join(f'{d} * {w[d]}' for d in dims)}) / ({' + '.join(w.values())})) AS BIGINT)"


def severity_counts(cfg: AuditConfig = qs.DEFAULT) -> str:
    on = ", ".join(f"'{r.rule_id}'" for r in cat.RULES if cfg.runs(r.rule_id))
    cols = ", ".join(f"coalesce(n_{s}, 0) AS n_{s}" for s in cat.SEVERITIES)
    counted = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s}" for s in cat.SEVERITIES)
    return (f", sev AS (SELECT project_id, {counted} FROM found WHERE rule_id IN ({on}) GROUP BY project_id), "
            f"full_ AS (SELECT score.*, {cols} FROM score LEFT JOIN sev USING (project_id))")


def full(source: str = "seeded", cfg: AuditConfig = qs.DEFAULT) -> str:
    return scores(source, cfg, findings(source, cfg)) + severity_counts(cfg)


BAND = "CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 70 THEN 'good' WHEN overall >= 50 THEN 'needs_work' ELSE 'poor' END"
SUMMARY = (
    "'Project ''' || project_id || ''' (' || skill_type || '): ' || overall || '/100 (' || " + BAND + " || '). Findings: ' || n_critical "
    "|| ' critical, ' || n_warning || ' warning, ' || n_info || ' info, scores: ' || "
    + " || ', ' || ".join(f"'{d}=' || {d}" for d in cat.DIMENSIONS))

DIMS = ", ".join(cat.DIMENSIONS)
FOUND = ", ".join(qs.FINDING_COLUMNS)
LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'info' THEN 'note' ELSE 'warning' END"
SARIF_MESSAGE = "message || CASE WHEN fix_hint <> '' THEN chr(10) || 'Fix: ' || fix_hint ELSE '' END"
ORDERED = "rule_rank, group_rank, path, pattern_rank, pos"


def patches(level: str, source: str = "seeded") -> str:
    """WITH ... up to ``patch``: ordered, deduplicated patches."""
    assign = cat.SECRET_ASSIGNMENT_REGEX
    ends = " OR ".join(f"n LIKE '%{e.replace('_', '!_')}' ESCAPE '!'" for e in cat.SECRET_NAME_ENDINGS)
    secret = (
        f"array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i > len(w) THEN '' "
        f"WHEN {ends.replace('n LIKE', 'upper(v[i]) LIKE')} THEN v[i] || ' = os.environ.get(\"' || upper(v[i]) || '\", \"\")' "
        "ELSE w[i] END), '')")
    arg = f"regexp_extract(original, {rx(r'os\.system\((.+)\)')}, 1)"
    danger = (
        "CASE WHEN contains(original, 'eval(') AND NOT contains(original, 'ast.literal_eval') "
        "THEN replace(original, 'eval(', 'ast.literal_eval(') "
        f"WHEN contains(original, 'os.system(') AND {arg} <> '' THEN replace(original, 'os.system(' || {arg} || ')', "
        f"'subprocess.run(' || {arg} || ', shell=True, check=True)') ELSE original END")
    rules = "('sec_secrets', 'sec_dangerous_functions')" if level == "suggested" else "('sec_secrets')"
    return findings(source) + f""",
byline AS (SELECT f.*, ({lines('k.text')})[f.line] AS original FROM found f JOIN k USING (project_id, path) WHERE rule_id IN {rules}),
pieces AS (SELECT *, string_split_regex(original, {rx(assign)}) AS b, regexp_extract_all(original, {rx(assign)}) AS w,
  regexp_extract_all(original, {rx(assign)}, 1) AS v FROM byline WHERE original IS NOT NULL),
fixed AS (SELECT *, CASE WHEN rule_id = 'sec_secrets' THEN {secret} ELSE {danger} END AS replacement FROM pieces),
firsts AS (SELECT *, row_number() OVER (PARTITION BY project_id, path, original ORDER BY {ORDERED}) AS rn FROM fixed
  WHERE replacement <> original),
patch AS MATERIALIZED (SELECT project_id, path AS file_path, original, replacement, fix_safety AS safety, rule_id AS issue_rule_id,
  {ORDERED} FROM firsts WHERE rn = 1
  UNION ALL SELECT project_id, '.gitignore', '', {q(cat.GITIGNORE_BODY)}, 'safe', 'maint_versioning', 0, 0, NULL, 0, 0 FROM feat
  WHERE {PROJECT_CONDITIONS['maint_versioning']})"""


SWAP = ("CASE WHEN instr(a.t, x.o) > 0 AND x.o <> '' THEN substr(a.t, 1, instr(a.t, x.o) - 1) || x.r || "
        "substr(a.t, instr(a.t, x.o) + length(x.o)) ELSE a.t END")


def patched(source: str = "seeded") -> str:
    """WITH ... up to ``pf``: files with patches applied one after the other."""
    return patches("suggested", source) + f""",
pl AS (SELECT project_id, file_path AS path, list({{'t': '', 'o': original, 'r': replacement}} ORDER BY {ORDERED}) AS ps FROM patch
  WHERE original <> '' GROUP BY ALL),
pf AS MATERIALIZED (SELECT k.project_id, k.path, CASE WHEN ps IS NULL THEN content ELSE
    list_reduce(list_prepend({{'t': k.text, 'o': '', 'r': ''}}, ps), lambda a, x: {{'t': {SWAP}, 'o': '', 'r': ''}}).t END AS content,
    CAST(coalesce(len(ps), 0) AS BIGINT) AS n_patches FROM k LEFT JOIN pl USING (project_id, path)
  UNION ALL SELECT project_id, file_path, replacement, 1 FROM patch WHERE original = '')"""


HASH_WORDS = ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS w{i}" for i in range(8))


def project_hashes(table: str, name: str) -> str:
    skipped = r"(^|/)(__pycache__|\.git)(/|$)"
    joined = " || ',' || ".join(["n", *(f"CAST(w{i} AS VARCHAR)" for i in range(8))])
    return (
        f"{name} AS (SELECT project_id, n AS n_files, substr(sha256({joined}), 1, 16) AS project_hash FROM "
        f"(SELECT project_id, count(*) AS n, {HASH_WORDS} FROM (SELECT project_id, sha256(path || chr(10) || coalesce(sha256(content), 'unreadable')) AS h "
        f"FROM {table} WHERE NOT regexp_matches(path, {q(skipped)})) GROUP BY project_id))")


def _fenced(title: str, column: str) -> str:
    return f"'## {title}' || chr(10) || '```' || chr(10) || {column} || chr(10) || '```'"


def judge_requests() -> str:
    """Every prompt and code file, part by part."""
    n = jd.REQUEST_CHARS
    return classified() + f""",
seen AS (SELECT * FROM k WHERE (is_prompt OR kind = 'code') AND length(text) > 0),
parts AS (SELECT *, unnest(range(0, (length(text) - 1) // {n} + 1)) AS part FROM seen),
asked AS (SELECT project_id, path, part, CASE WHEN kind = 'code' THEN {_fenced('Code', f'substr(text, part * {n} + 1, {n})')}
    ELSE {_fenced('Prompt', f'substr(text, part * {n} + 1, {n})')} END AS user_prompt FROM parts
  UNION ALL SELECT DISTINCT project_id, NULL, 0, {q(jd.NOTHING)} FROM k WHERE project_id NOT IN (SELECT project_id FROM seen))
SELECT project_id, judge, path, CAST(part AS BIGINT) AS part, user_prompt FROM asked, (VALUES ('P'), ('C')) j(judge)"""


def limited_requests() -> str:
    limits = jd.Limits()
    both = f"concat_ws(chr(10) || chr(10), CASE WHEN pc <> '' THEN {_fenced('Prompt', 'pc')} END, CASE WHEN cc <> '' THEN {_fenced('Code', 'cc')} END)"
    return classified() + f""",
pc AS (SELECT project_id, substr(string_agg(text, chr(10) ORDER BY path), 1, {limits.prompt}) AS pc,
  length(string_agg(text, chr(10) ORDER BY path)) > {limits.prompt} AS pt FROM k WHERE is_prompt GROUP BY project_id),
cw AS (SELECT project_id, length(string_agg(text, chr(10))) AS n FROM k WHERE kind = 'code' GROUP BY project_id),
cc AS (SELECT project_id, substr(string_agg(substr(text, 1, {limits.code_file}), chr(10) ORDER BY path), 1, {limits.code}) AS cc FROM
  (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path) AS rn FROM k WHERE kind = 'code') c WHERE rn <= {limits.code_files} GROUP BY project_id),
body AS (SELECT project_id, {both} AS body, coalesce(pt, false) OR coalesce(length(cc) < n, false) AS truncated
  FROM (SELECT DISTINCT project_id FROM k) LEFT JOIN pc USING (project_id) LEFT JOIN cc USING (project_id) LEFT JOIN cw USING (project_id))
SELECT project_id, judge, CASE WHEN body = '' THEN {q(jd.NOTHING)} ELSE body END AS user_prompt, truncated
FROM body, (VALUES ('P'), ('C')) j(judge)"""


def parsed_ctes() -> str:
    """``parsed``: what the recorded answers say."""
    def number(key):
        path = f"'$.{key}.score'"
        return (f"CASE WHEN json_type(a, {path}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(a, {path}) AS DOUBLE) END AS {key}_score, "
                f"json_extract_string(a, '$.{key}.reason') AS {key}_reason")
    keys = ", ".join(number(k) for k in (*jd.PROMPT_KEYS, *jd.CORRECTNESS_KEYS))
    body = r"regexp_extract(raw, '(?s)\{.*\}')"
    return f""",
responses AS ({corpus.RESPONSES_SQL}),
answers AS (SELECT *, CASE WHEN json_valid({body}) THEN {body} END AS a FROM responses),
parsed AS MATERIALIZED (SELECT project_id, judge, coalesce(len(json_keys(a)) > 0, false) AS parsed, {keys},
  CAST(json_extract(a, '$.injection_risk.vulnerable_lines') AS VARCHAR[]) AS vulnerable_lines,
  CAST(json_extract(a, '$.risk_patterns') AS VARCHAR[]) AS risk_patterns FROM answers)"""


def blended() -> str:
    ctes, dims = "", {"P": jd.PROMPT_KEYS, "C": jd.CORRECTNESS_KEYS}
    prev = "score"
    for d, keys in dims.items():
        subs = [s for s, _ in cat.SUB_WEIGHTS[d]]
        names = subs + [k for k in keys if k not in subs]
        values = []
        for s in names:
            old = f"{d}_{s}" if s in subs else "NULL"
            values.append((s, f"CASE WHEN {s}_score IS NULL THEN {old} ELSE CAST(trunc(0.6::DOUBLE * coalesce({old}, 100) + 0.4::DOUBLE * {s}_score) AS BIGINT) END"
                           if s in keys else old))
        values += [(f"{k}_ai", f"CAST(trunc({k}_score) AS BIGINT)") for k in keys]
        cells = ", ".join(f"{{'k': '{n}', 'v': CAST({e} AS BIGINT)}}" for n, e in values)
        ctes += f""",
m{d} AS (SELECT s.*, p.parsed, list_filter([{cells}], lambda e: e.v IS NOT NULL) AS {d}_merged FROM {prev} s
  LEFT JOIN (SELECT * FROM parsed WHERE judge = '{d}' AND parsed) p USING (project_id)),
b{d} AS (SELECT * EXCLUDE (parsed) REPLACE (CASE WHEN parsed THEN
  CAST(trunc(list_sum(list_transform({d}_merged, lambda e: e.v)) / len({d}_merged)) AS BIGINT) ELSE {d} END AS {d}) FROM m{d})"""
        prev = f"b{d}"
    text = ", ".join(f"array_to_string(list_transform({d}_merged, lambda e: e.k || '=' || e.v), ',') AS {d}_subs" for d in dims)
    return scores() + parsed_ctes() + ctes + f"""
SELECT project_id, P, C, {text}, {overall()} AS overall FROM {prev}"""


def judge_findings() -> str:
    parts = []
    for d, keys in (("P", jd.PROMPT_KEYS), ("C", jd.CORRECTNESS_KEYS)):
        for k in keys:
            parts.append(f"SELECT project_id, '{d}' AS dimension, 'info' AS severity, 'judged_{k}' AS category, 'judge: ' || {k}_reason AS message "
                         f"FROM parsed WHERE judge = '{d}' AND parsed AND {k}_reason <> ''")
    for d, column, category in (("P", "vulnerable_lines", "judged_injection"), ("C", "risk_patterns", "judged_hallucination")):
        parts.append(f"SELECT project_id, '{d}', 'warning', '{category}', 'judge: ' || unnest({column}) FROM parsed WHERE judge = '{d}' AND parsed")
    return (f"WITH {SOURCES['seeded']}" + parsed_ctes() + " SELECT *, 'ai_judge' AS source FROM (" + " UNION ALL ".join(parts) + ")")


def judged_audit() -> str:
    """The audit with its judges: blended scores, and counts of rules' and judges' findings."""
    rules = severity_counts()
    body = blended().rsplit("\nSELECT ", 1)[0].replace(scores(), full(), 1)
    own = judge_findings().split(parsed_ctes(), 1)[1]
    more = ", ".join(f"count(*) FILTER (severity = '{s}') AS more_{s}" for s in cat.SEVERITIES)
    counts = ", ".join(f"full_.n_{s} + coalesce(more_{s}, 0) AS n_{s}" for s in cat.SEVERITIES)
    assert rules in body
    return body + f""",
own AS ({own}),
more AS (SELECT project_id, {more} FROM own GROUP BY project_id),
final AS (SELECT bC.* EXCLUDE (overall), {overall()} AS overall FROM bC)
SELECT final.project_id, final.overall, {', '.join(f'final.{d}' for d in cat.DIMENSIONS)}, {counts},
  {BAND.replace('overall', 'final.overall')} AS band, final.overall >= 80 AS passed
FROM final JOIN full_ USING (project_id) LEFT JOIN more USING (project_id)"""


# The stub of the registered query answers by the request alone.
STUB = """
, scored AS (SELECT *, CAST(('0x' || substr(sha256(user_prompt), 1, 4)) AS INT) % 101 AS score FROM requests)
SELECT CAST(project_id AS VARCHAR) AS project_id, judge, '{"' || CASE judge WHEN 'P' THEN 'clarity' ELSE 'hallucination_risk' END || '": {"score": ' || score || ', "reason": "stub"}}' AS raw, path, part,
  'success' AS status, CAST(length(user_prompt) AS BIGINT) AS input_tokens, CAST(10 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS retries FROM scored"""


def evidence(ordered: bool = False) -> str:
    low = "coalesce(CAST({} AS DOUBLE) / nullif({}, 0) < {}, false)"
    tokens = "CAST(floor(prompt_chars / 3.5::DOUBLE) AS BIGINT)"
    def band(v, bands):
        return "CASE " + " ".join(f"WHEN {v} > {a} THEN '{b}'" for a, b in bands) + " ELSE '100' END"
    rows = [
        ("compat_vendor_lock", "vendor_apis", "true", "n_vendor::VARCHAR"),
        ("compat_platform", "no_platform_code", "n_platform = 0", "NULL"),
        ("corr_error_handling", "handled_files", "n_py > 0", "n_handled || '/' || n_py"),
        ("corr_error_handling", "few_handled_files", low.format("n_handled", "n_py", 0.3), "NULL"),
        ("corr_hallucination_risk", "no_prompt_files", "n_prompt = 0", "NULL"),
        ("maint_documentation", "has_readme", "readme_exists", "NULL"),
        ("maint_documentation", "readme_short", "readme_short", "NULL"),
        ("maint_documentation", "readme_no_install", "readme_no_install", "NULL"),
        ("maint_documentation", "readme_no_example", "readme_no_example", "NULL"),
        ("maint_documentation", "readme_no_license", "readme_no_license", "NULL"),
        ("maint_tests", "has_tests", "has_tests", "NULL"),
        ("maint_tests", "test_ratio", "has_tests AND code_lines > 0", "test_lines || '/' || code_lines"),
        ("maint_tests", "low_test_ratio", "has_tests AND code_lines > 0 AND CAST(test_lines AS DOUBLE) / code_lines < 0.1", "NULL"),
        ("maint_tests", "good_test_ratio", "has_tests AND code_lines > 0 AND CAST(test_lines AS DOUBLE) / code_lines >= 0.5", "NULL"),
        ("maint_versioning", "has_changelog", "has_changelog", "NULL"), ("maint_versioning", "no_changelog", "NOT has_changelog", "NULL"),
        ("maint_versioning", "has_gitignore", "gitignore_exists", "NULL"), ("maint_versioning", "no_gitignore", "NOT gitignore_exists", "NULL"),
        ("maint_versioning", "no_version_file", "NOT has_version_file", "NULL"),
        ("maint_comments", "docstrings", "n_defs > 0", "n_docstrings || '/' || n_defs"),
        ("maint_comments", "few_docstrings", low.format("n_docstrings", "n_defs", 0.3), "NULL"),
        ("maint_comments", "no_functions", "n_defs = 0", "NULL"),
        ("perf_token_cost", "no_tokens", "estimated_total_tokens = 0", "NULL"),
        ("perf_token_cost", "total_tokens", "estimated_total_tokens > 0", "estimated_total_tokens::VARCHAR"),
        ("perf_token_cost", "cost_usd", "estimated_total_tokens > 0", "printf('%.4f', estimated_total_tokens::DOUBLE / 1000::DOUBLE * 0.03::DOUBLE)"),
        ("perf_token_cost", "token_band", "estimated_total_tokens > 0", band("estimated_total_tokens", cat.PROJECT_TOKEN_BANDS)),
        ("prompt_missing", "no_prompt", "p_missing", "NULL"),
        ("prompt_token_efficiency", "prompt_tokens", "p_ok", f"{tokens}::VARCHAR"),
        ("prompt_token_efficiency", "token_band", f"p_ok AND {tokens} > 2000", band(tokens, cat.PROMPT_TOKEN_BANDS)),
        ("prompt_token_efficiency", "duplicate_lines", "p_ok AND n_duplicates > 3", "n_duplicates::VARCHAR"),
        ("prompt_clarity", "no_role", "p_ok AND NOT has_role", "NULL"), ("prompt_clarity", "no_format", "p_ok AND NOT has_format", "NULL"),
        ("prompt_clarity", "has_steps", "p_ok AND has_steps", "NULL"), ("prompt_clarity", "no_steps", "p_ok AND NOT has_steps", "NULL"),
        ("prompt_specificity", "generic", "p_ok AND generic_request AND generic_pointer", "NULL"),
        ("prompt_specificity", "specific", "p_ok AND NOT (generic_request AND generic_pointer)", "NULL"),
        ("sec_dependencies", "no_dependency_file", "dependency_file IS NULL", "NULL"),
        ("sec_dependencies", "dependency_file", "dependency_readable", "dependency_file"),
        ("sec_dependencies", "no_risky_dependency", f"dependency_readable AND {DEP_N} = 0", "NULL"),
    ]
    parts = [f"SELECT project_id, '{cat.RULE[r].dimension}' AS dimension, '{r}' AS rule_id, '{c}' AS code, NULL AS path, {v} AS value FROM feat WHERE {cond}"
             for r, c, cond, v in rows]
    for r, c, cond in (
        ("compat_platform", "platform_code", f"is_py AND {has('text', *cat.PLATFORM_WORDS)}"),
        ("corr_hallucination_risk", "invites_invention", HALLUCINATION),
        ("corr_hallucination_risk", "no_invitation", f"is_prompt AND NOT ({HALLUCINATION})"),
        ("perf_api_efficiency", "no_cache", UNCACHED),
    ):
        parts.append(f"SELECT project_id, '{cat.RULE[r].dimension}', '{r}', '{c}', path, NULL FROM k WHERE {cond}")
    if ordered:  # by rule, then as listed; what is said of a file comes behind what is said of its project
        places = [100 * cat.rank(r) + i for i, (r, *_) in enumerate(rows)] + [100 * cat.rank(r) + 90 for r in (
            "compat_platform", "corr_hallucination_risk", "corr_hallucination_risk", "perf_api_efficiency")]
        parts = [f"SELECT *, {place} AS seq FROM ({part})" for place, part in zip(places, parts)]
    return features() + " " + " UNION ALL ".join(parts)


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    kinds = "SELECT project_id, path, kind, ext, length(text) AS n_chars FROM k"
    manifest = (
        ", lang AS (SELECT project_id, array_to_string(list_sort(list(DISTINCT substr(ext, 2))), '|') AS languages FROM k WHERE kind = 'code' GROUP BY project_id) "
        "SELECT project_id, skill_type, n_files, n_prompt, n_code, n_config, dependency_file, readme_exists, gitignore_exists, "
        "estimated_total_tokens, coalesce(languages, '') AS languages FROM feat LEFT JOIN lang USING (project_id)")
    duplicates = " SELECT project_id, n_lines, n_duplicates FROM dup"
    out["files_from_table"] = (
        "SELECT split_part(split_part(url, '//', 2), '/', 1) AS project_id, 'page_' || page_id || '.html' AS path, length(html) AS n_chars FROM pages")
    for suffix, source in (("", "seeded"), ("_conversations", "talk")):
        out[f"file_kind{suffix}"] = f"{classified(source)} {kinds}"
        out[f"manifest{suffix}"] = features(source) + manifest
        out[f"duplicate_lines{suffix}"] = features(source) + duplicates
        out[f"overall{suffix}"] = scores(source) + f" SELECT project_id, skill_type, n_files AS files_scanned, overall, {DIMS} FROM score"
    out["single_file_scores"] = scores("single") + (
        " SELECT project_id, skill_type, overall, P, F, X, P_injection, P_token, P_clarity, P_specificity FROM score")
    out["numbered_lines"] = classified() + " SELECT project_id, path, kind, line_no, line FROM ln"
    hard = " || ".join(f"regexp_extract_all(text, {rx(p.regex)})" for p in cat.HARDCODED_PATTERNS)
    out["code_metrics"] = classified() + (
        f" SELECT project_id, path, CAST(CASE WHEN path LIKE '%.py' THEN {n_matches('text', DEF)} ELSE 0 END AS BIGINT) AS n_functions, "
        f"{has_all('text', ('try:', 'except'))} AS has_try_except, array_to_string({hard}, '|') AS hardcoded FROM k")

    for r in qs.FOUND_RULES:
        out[f"find_{r}"] = findings() + f" SELECT {FOUND} FROM found WHERE rule_id = '{r}'"
    for r in qs.FIND_RULES_ON_CONVERSATIONS:
        out[f"find_{r}_conversations"] = findings("talk") + f" SELECT {FOUND} FROM found WHERE rule_id = '{r}'"
    out["findings"] = findings() + f" SELECT {FOUND}, dimension, category, fix_hint, auto_fixable, fix_safety FROM found"
    counts = " SELECT project_id, rule_id, severity, count(*) AS n FROM found GROUP BY ALL"
    out["finding_counts"] = findings() + counts
    out["error_finding_counts"] = findings("unreadable") + counts

    for suffix, source in (("", "seeded"), ("_conversations", "talk")):
        for d in cat.DIMENSIONS if source == "seeded" else ("P",):
            cells = " UNION ALL ".join(
                f"SELECT project_id, '{s}' AS sub, {d}_{s} AS score FROM score" for s, _ in cat.SUB_WEIGHTS[d])
            out[f"sub_{d}{suffix}"] = scores(source) + f" SELECT * FROM ({cells})"
    for d in cat.DIMENSIONS:
        text = " || ',' || ".join(f"'{s}=' || {d}_{s}" for s, _ in cat.SUB_WEIGHTS[d])
        out[f"dim_{d}"] = scores() + (
            f" SELECT project_id, '{d}' AS dimension, '{cat.DIMENSION_NAMES[d]}' AS name, {d} AS score, "
            f"{cat.DIMENSION_WEIGHTS[d]}::DOUBLE AS weight, {text} AS sub_scores FROM score")
    out["evidence"] = evidence()
    out["evidence_in_order"] = f"SELECT * EXCLUDE (seq), {qs.EVIDENCE_PLACE} FROM ({evidence(ordered=True)})"
    SOURCES["patched"] = f"files AS ({patched()} SELECT project_id, path, content FROM pf)"
    out["reaudit_all_rules"] = findings("patched") + " SELECT project_id, rule_id, severity, count(*) AS n FROM found GROUP BY ALL"
    subs = ", ".join(f"{d}_{s}" for d in cat.DIMENSIONS for s, _ in cat.SUB_WEIGHTS[d])
    out["json_reports_whole"] = full() + (
        f" SELECT project_id, skill_type, n_files AS files_scanned, overall, {DIMS}, n_critical, n_warning, n_info, {BAND} AS band, true AS passed, {subs} FROM full_")
    out["report_lines"] = full() + patches("suggested")[len(findings()):] + (
        ", lines AS (SELECT project_id, 'audit' AS record, overall::VARCHAR AS name, skill_type AS value FROM full_ "
        "UNION ALL SELECT project_id, 'issue', rule_id, message FROM found UNION ALL SELECT project_id, 'patch', file_path, replacement FROM patch "
        "UNION ALL SELECT project_id, 'file', path, kind FROM k) SELECT * FROM lines")

    out["severity_counts"] = full() + " SELECT project_id, n_critical, n_warning, n_info FROM full_"
    out["summary"] = full() + f" SELECT project_id, {BAND} AS band, {SUMMARY} AS summary FROM full_"
    out["gate"] = scores() + " SELECT project_id, overall, overall >= 80 AS passed FROM score"
    out["dimension_gate"] = scores() + " " + " UNION ALL ".join(
        f"SELECT project_id, '{d}' AS dimension, {d} AS score, CAST({t} AS BIGINT) AS threshold, {d} >= {t} AS passed FROM score"
        for d, t in cat.DIMENSION_THRESHOLDS.items())
    cfg_dims = ", ".join(qs.CONFIGURED.enabled_dimensions())
    out["configured_audit"] = full("seeded", qs.CONFIGURED) + (
        f" SELECT project_id, overall, {cfg_dims}, n_critical, n_warning, n_info, overall >= 85 AS passed FROM full_")
    out["error_findings"] = features("unreadable") + " " + " UNION ALL ".join(
        f"SELECT project_id, '{d}' AS dimension, 'critical' AS severity, 'engine_error' AS category, 'engine' AS location, "
        f"'a file could not be read' AS message FROM feat WHERE {c}" for d, c in (("P", "prompt_unreadable"), ("X", "readme_unreadable")))
    out["error_audits"] = full("unreadable") + f" SELECT project_id, overall, {DIMS}, n_critical, n_warning, n_info FROM full_"

    out["findings_cube"] = findings() + (
        " SELECT dimension, severity, rule_id, count(*) AS n_findings, CAST(grouping(dimension, severity, rule_id) AS BIGINT) AS level "
        "FROM found GROUP BY CUBE (dimension, severity, rule_id)")
    out["rule_coverage"] = findings() + (
        " SELECT c.rule_id, c.pattern_id, c.dimension, c.severity, count(f.project_id) AS n_findings FROM catalog c "
        "LEFT JOIN found f ON f.rule_id = c.rule_id AND f.pattern_id = c.pattern_id GROUP BY ALL")
    out["worst_k"] = scores() + " SELECT project_id, overall FROM score ORDER BY overall, project_id LIMIT 20"
    out["worst_per_type"] = scores() + (
        " SELECT skill_type, place, project_id, overall FROM (SELECT *, row_number() OVER (PARTITION BY skill_type ORDER BY overall, project_id) AS place "
        "FROM score) WHERE place <= 3")
    out["sarif_results"] = findings() + (
        f" SELECT project_id, rule_id, {LEVEL} AS level, {SARIF_MESSAGE} AS message, coalesce(path, location) AS uri, line AS start_line FROM found")
    first_rule = f"SELECT *, row_number() OVER (PARTITION BY project_id, rule_id ORDER BY {ORDERED}) AS rn FROM found"
    out["sarif_rules"] = findings() + (
        f" SELECT project_id, rule_id, category AS name, message, {LEVEL} AS level FROM ({first_rule}) WHERE rn = 1")
    ordered = "ORDER BY rule_rank, group_rank, path NULLS FIRST, pattern_rank, pos"
    out["sarif_documents"] = findings() + (
        f" SELECT project_id, dimension, path, '2.1.0' AS version, string_agg(rule_id, '|' {ordered}) AS result_rules, "
        f"string_agg({SARIF_MESSAGE}, '|' {ordered}) AS messages, string_agg(coalesce(CAST(line AS VARCHAR), '-'), '|' {ordered}) AS lines, "
        f"string_agg(rule_id, '|' ORDER BY rule_rank) FILTER (first) AS described, string_agg(message, '|' ORDER BY rule_rank) FILTER (first) AS about "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dimension, path, rule_id {ordered}) = 1 AS first FROM found) "
        "GROUP BY project_id, dimension, path")
    out["json_reports"] = full() + f" SELECT project_id, overall, {SUMMARY} AS summary, S_secrets AS secrets, 0.2::DOUBLE AS p_weight FROM full_"
    out["finding_lines"] = findings() + (
        f" SELECT project_id, {', '.join(qs.LINE_FIELDS)} FROM found")

    columns = "project_id, file_path, original, replacement, safety, issue_rule_id"
    out["patches_safe"] = patches("safe") + f" SELECT {columns} FROM patch"
    out["patches_suggested"] = patches("suggested") + f" SELECT {columns} FROM patch"
    out["patched_files"] = patched() + " SELECT * FROM pf"
    out["patch_stats"] = patched() + (
        ", turns AS (SELECT safety, issue_rule_id, original, original = '' OR contains(list_reduce(list_prepend({'t': text, 'o': '', 'r': ''}, "
        f"coalesce(ps[1:turn - 1], [])), lambda a, x: {{'t': {SWAP}, 'o': '', 'r': ''}}).t, original) AS applied FROM (SELECT patch.*, k.text, ps, "
        f"row_number() OVER (PARTITION BY patch.project_id, file_path ORDER BY {', '.join(f'patch.{c}' for c in ORDERED.split(', '))}) AS turn FROM patch LEFT JOIN k ON k.project_id = patch.project_id "
        "AND k.path = file_path LEFT JOIN pl ON pl.project_id = patch.project_id AND pl.path = file_path)) "
        "SELECT safety, issue_rule_id, count(*) AS n_patches, count(*) FILTER (WHERE original = '') AS n_new_files, "
        "count(*) FILTER (applied) AS n_applied, count(*) FILTER (NOT applied) AS n_failed FROM turns GROUP BY ALL")
    note = q(fx.FUZZY_NOTE)
    out["fuzzy_prompt_patches"] = classified() + (
        f" SELECT project_id, path AS file_path, text AS original, text || {note} AS replacement FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY project_id ORDER BY path) AS rn FROM k WHERE is_prompt AND {has('text', *cat.FUZZY_WORDS)}) WHERE rn = 1")
    after = []
    for r in ("sec_secrets", "sec_dangerous_functions"):
        for p in cat.RULE[r].patterns:
            scope = "kind IN ('code', 'config')" if r == "sec_secrets" else "is_py"
            after.append(f"SELECT '{r}' AS rule_id, {n_matches('pf.content', p.regex)} AS n FROM pf JOIN k USING (project_id, path) WHERE {scope}")
    out["reaudit_patched"] = patched() + (
        " SELECT rule_id, count(*) AS n_findings, 'before' AS state FROM found WHERE rule_id IN ('sec_secrets', 'sec_dangerous_functions') GROUP BY rule_id "
        f"UNION ALL SELECT rule_id, CAST(sum(n) AS BIGINT), 'after' FROM ({' UNION ALL '.join(after)}) GROUP BY rule_id")

    out["content_hash"] = f"WITH {SOURCES['seeded']} SELECT project_id, path, substr(sha256(content), 1, 16) AS content_hash FROM seeded_files"
    out["project_hash"] = f"WITH {SOURCES['seeded']}, {project_hashes('seeded_files', 'h')} SELECT * FROM h"
    out["incremental"] = scores() + f", files AS ({corpus.EARLIER_FILES_SQL}), {project_hashes('seeded_files', 'h')}, {project_hashes('files', 'e')}" + (
        " SELECT score.project_id, overall, h.project_hash, h.project_hash = e.project_hash AS reused FROM score JOIN h USING (project_id) "
        "JOIN e ON e.project_id = score.project_id")

    own = {k: layered_config(*qs.OWN_LAYERS.get(k, ()), override_severity=True) for k in (0, 1, 2)}
    held = "project_id, skill_type, n_files AS files_scanned, overall, {}, n_critical, n_warning, n_info, {} AS passed FROM full_ WHERE project_id % 3 = {}"
    out["configured_per_project"] = " UNION ALL ".join(
        f"(SELECT * FROM ({full('unreadable', c)} SELECT " + held.format(
            ", ".join(d if d in c.enabled_dimensions() else f"NULL::BIGINT AS {d}" for d in cat.DIMENSIONS),
            "true" if c.fail_threshold is None else f"overall >= {c.fail_threshold}", k) + "))" for k, c in own.items())
    out["findings_per_project"] = " UNION ALL ".join(
        f"(SELECT * FROM ({findings('unreadable', c)} SELECT project_id, rule_id, severity, count(*) AS n FROM found WHERE project_id % 3 = {k} "
        f"AND rule_id IN ({', '.join(repr(r.rule_id) for r in cat.RULES if c.runs(r.rule_id))}) GROUP BY ALL))" for k, c in own.items())
    out["gates_per_project"] = " UNION ALL ".join(
        f"(SELECT * FROM ({scores('unreadable', c)} " + " UNION ALL ".join(
            f"SELECT project_id, '{d}' AS dimension, {d} AS score, {c.dimensions[d].threshold} AS threshold, {d} >= {c.dimensions[d].threshold} AS passed "
            f"FROM score WHERE project_id % 3 = {k}" for d in c.enabled_dimensions()) + "))" for k, c in own.items())
    ranks = ("rank() OVER (w ORDER BY overall DESC) AS rank, dense_rank() OVER (w ORDER BY overall DESC) AS dense_rank, "
             "percent_rank() OVER (w ORDER BY overall DESC) AS percent_rank, count(*) OVER (w) AS n_projects FROM score")
    out["project_ranks"] = scores() + f" SELECT project_id, overall, {ranks}".replace("(w", "(")
    out["project_ranks_per_type"] = scores() + f" SELECT project_id, skill_type, overall, {ranks}".replace("(w", "(PARTITION BY skill_type")

    cells = " UNION ALL ".join(
        f"(SELECT project_id, '{d}' AS dimension, {d} AS score, {qs.REWEIGHTED.weight(d)}::DOUBLE AS weight, n.*, same AND {'false' if d == 'S' else 'true'} AS reused "
        f"FROM full_ JOIN same USING (project_id), LATERAL (SELECT "
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in cat.SEVERITIES)
        + f" FROM found WHERE found.project_id = full_.project_id AND found.dimension = '{d}') n)" for d in cat.DIMENSIONS)
    out["incremental_dimensions"] = full("seeded", qs.REWEIGHTED) + (
        f", files AS ({corpus.EARLIER_FILES_SQL}), {project_hashes('seeded_files', 'h')}, {project_hashes('files', 'e')}, "
        f"same AS (SELECT h.project_id, h.project_hash = e.project_hash AS same FROM h JOIN e USING (project_id)) {cells}")
    audited = "project_id, skill_type, n_files AS files_scanned, overall, " + DIMS + ", n_critical, n_warning, n_info FROM full_"
    out["incremental_dimension_audits"] = full("seeded", qs.REWEIGHTED) + f" SELECT {audited}"
    out["incremental_files"] = full() + f" SELECT {audited}"
    out["incremental_file_findings"] = findings() + f" SELECT {FOUND} FROM found"
    traits = ", ".join(("ext", "path LIKE '%.py'", "path LIKE '%.json'", "path = 'README.md'", "lower(name) = 'readme.md'", "name = '.gitignore'",
                        has("lower(path)", *cat.MCP_PATH_WORDS), has("lower(path)", *cat.RAG_PATH_WORDS), has("lower(path)", "tool"),
                        has("lower(path)", *cat.AGENT_PATH_WORDS), one_of("name", cat.DEPENDENCY_FILES), has("lower(path)", "test"),
                        has("lower(path)", "change"), one_of("path", cat.VERSION_FILES)))
    kinds_of = {i: f"({classified(source)} SELECT DISTINCT content, {traits} FROM k)" for i, source in ((1, "earlier"), (2, "seeded"))}
    out["incremental_contents"] = (
        f"SELECT 1 AS version, count(*) AS n_matched FROM {kinds_of[1]} UNION ALL SELECT 2, count(*) FROM ({kinds_of[2]} EXCEPT {kinds_of[1]})")
    out["stream_audits"] = " UNION ALL ".join(
        f"SELECT {i} AS delivery, * FROM ({full(source)} SELECT {audited})" for i, source in enumerate(("earlier", "seeded", "seeded")))

    out["judge_requests"] = judge_requests()
    listed = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("vulnerable_lines", "risk_patterns"))
    out["judge_parse"] = f"WITH {SOURCES['seeded']}{parsed_ctes()} SELECT * REPLACE ({listed}) FROM parsed".replace(
        f"* REPLACE ({listed})", f"* EXCLUDE (vulnerable_lines, risk_patterns), {listed}")
    out["judge_blend"] = blended()
    out["judge_findings"] = judge_findings()
    out["judged_audit"] = judged_audit()
    head, tail = judge_requests().rsplit("\nSELECT project_id, judge,", 1)
    out["call_judge"] = f"{head},\nrequests AS (SELECT project_id, judge,{tail})" + STUB
    out["judge_requests_limited"] = limited_requests()
    out["judge_usage_merged"] = f"WITH {SOURCES['seeded']}{parsed_ctes()}" + (
        " SELECT judge, status, count(*) AS n_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
        "CAST(sum(retries) AS BIGINT) AS retries, count(DISTINCT project_id) AS n_projects, CAST(min(latency_ms) AS BIGINT) AS min_latency_ms, "
        "CAST(max(latency_ms) AS BIGINT) AS max_latency_ms, CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS median_latency_ms FROM responses GROUP BY judge, status")
    spread = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS score FROM score" for d in cat.DIMENSIONS)
    out["score_distributions"] = scores() + (
        " SELECT dimension, count(*) AS n, " + ", ".join(f"CAST(quantile_disc(score, {p}) AS BIGINT) AS {c}" for c, p in (
            ("least", 0.0), ("lower", 0.25), ("median", 0.5), ("upper", 0.75), ("most", 1.0))) + f" FROM ({spread}) GROUP BY dimension")
    named = ", ".join(f"'{p}'" for p in qs.TREE_PROJECTS)
    out["project_tree"] = (
        "SELECT 'p' || page_id % 5 AS project_id, 'd' || page_id % 3 || '/' || page_id || '.html' AS path, length(html) AS n_chars, sha256(html) AS digest "
        f"FROM pages WHERE page_id % 2 = 0 AND 'p' || page_id % 5 IN ({named})")
    out["judge_usage"] = f"WITH {SOURCES['seeded']}{parsed_ctes()}" + (
        " SELECT judge, status, count(*) AS n_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
        "CAST(max(latency_ms) AS BIGINT) AS max_latency_ms, CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS median_latency_ms, "
        "CAST(sum(retries) AS BIGINT) AS retries FROM responses GROUP BY judge, status")

    from folioscan.streaming.audit import FILE_LEVEL_RULES

    level = ", ".join(f"'{r}'" for r in FILE_LEVEL_RULES)
    out["stream_findings"] = findings() + (
        f" SELECT project_id, rule_id, severity, count(*) AS n FROM found WHERE rule_id IN ({level}) GROUP BY ALL")
    out["stream_windows"] = findings() + (
        " SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_start, rule_id, count(*) AS n_findings FROM found "
        "JOIN events ON event_id = project_id WHERE rule_id IN (" + level + ") GROUP BY 1, 2")
    out["stream_late"] = findings() + (
        ", latest AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events JOIN (SELECT DISTINCT project_id FROM seeded_files) ON event_id = project_id WHERE project_id % 4 <> 1) "
        "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_start, rule_id, count(*) AS n_findings, "
        "count(*) FILTER (project_id % 4 = 1 AND ts < mark) AS n_late FROM found JOIN events ON event_id = project_id, latest WHERE rule_id IN (" + level + ") GROUP BY 1, 2")
    out["stream_signals"] = scores() + f" SELECT project_id, overall, {DIMS} FROM score"
    out["stream_updates"] = out["stream_signals"]
    out["stream_update_findings"] = out["stream_findings"]
    imports, below = n_matches("text", r"\bimport\s+\w+"), "kind = 'code' AND path LIKE 'src/%'"
    out["custom_findings"] = classified() + (
        f" SELECT project_id, path, 'z_import' AS rule_id, 'warning' AS severity, {imports} AS n FROM k WHERE is_py AND {imports} > 0 "
        f"UNION ALL SELECT project_id, path, 'z_source', 'info', 1 FROM k WHERE {below}")
    failed = {"P": "prompt_unreadable", "X": "readme_unreadable"}
    own = {d: f"(CASE WHEN {failed.get(d, 'false')} THEN 1::DOUBLE ELSE {qs.DEFAULT.weight(d)}::DOUBLE END)" for d in cat.DIMENSIONS}
    out["custom_dimension"] = scores() + (
        f", z AS (SELECT project_id, greatest(0, 100 - CAST(sum(CASE WHEN is_py THEN 3 * {imports} ELSE 0 END + CASE WHEN {below} THEN 5 ELSE 0 END) AS BIGINT)) AS Z "
        f"FROM k GROUP BY project_id) SELECT project_id, Z, CAST(trunc(({' + '.join(f'{d} * {own[d]}' for d in cat.DIMENSIONS)} + Z * 0.1::DOUBLE) / "
        f"({' + '.join(own.values())} + 0.1::DOUBLE)) AS BIGINT) AS overall FROM score JOIN z USING (project_id)")
    out["incremental_appended_twice"] = out["incremental"]
    out["stored_other_config"] = findings("seeded", qs.CONFIGURED) + (
        f" SELECT project_id, rule_id, severity, count(*) AS n FROM found WHERE rule_id IN ({', '.join(repr(r.rule_id) for r in cat.RULES if qs.CONFIGURED.runs(r.rule_id))}) GROUP BY ALL")
    out["single_files_shared_paths"] = scores("shared") + (
        " SELECT split_part(project_id, '/', 1) AS project_id, split_part(project_id, '/', 2) AS path, skill_type, n_files, overall, P, F, X FROM score")
    return out
