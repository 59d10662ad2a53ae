"""What the rules see in one file, and the per-project sums of it.

All rules read the text in one scan.  A file becomes a row of counts and flags;
those are summed per project with map-side aggregation, so no text is shuffled
and a project of any size costs one row per task.

The rules are SQL expressions over the columns of :func:`readable`.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from folioscan.functions import text as tx
from folioscan.operators import classify as cl
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat

IN_PROMPT = "(is_py OR is_prompt)"


def readable(classified: DataFrame) -> DataFrame:
    """Adds the helper columns the rule expressions share: the lower-cased text,
    whether it holds characters of special case or of Chinese, and whether code
    names a model API."""
    return classified.selectExpr(
        "*", "lower(text) AS ltext", f"octet_length(text) > length(text) AND {tx.contains_any('text', tx.FOLDING_CHARS)} AS folding",
        f"{tx.has_han('text')} AS han", f"is_py AND {tx.contains_any('text', _ANY_API)} AS calls_api")


# At least one is in every text that one of the API word lists hits.
_ANY_API = ("openai", "anthropic", "completions", "requests.post", "messages.create", ".invoke(")


def _has(*words: str) -> str:
    return tx.contains_any_by_script("text", "han", words)


def _has_ci(words) -> str:
    return tx.contains_any_ci("text", "ltext", "folding", words, "han")


def _json_config() -> str:
    return "kind = 'config' AND endswith(path, '.json')"


def guard(pattern: cat.Pattern) -> str:
    """A cheap test that every text with a match passes."""
    if pattern.needs:
        return _has(*pattern.needs)
    if pattern.key == "generic_api_key":
        return f"({tx.contains_all('ltext', ('api', 'key'))} OR folding)"
    if pattern.key == "password_literal":
        return f"({tx.contains_any('ltext', ('passw', 'pwd'))} OR folding)"
    return "true"


def match_scope(rule_id: str) -> str:
    return "kind IN ('code', 'config')" if rule_id == "sec_secrets" else "is_py"


def count_matches(rule_id: str, severity: str) -> str:
    """Matches of a rule's patterns of one severity; patterns with the same
    guard share its search."""
    groups: dict[str, list[str]] = {}
    for p in cat.RULE[rule_id].patterns:
        if p.severity == severity:
            groups.setdefault(guard(p), []).append(tx.count_matches("text", p.regex))
    counts = [f"CASE WHEN {g} THEN {' + '.join(c)} ELSE 0 END" for g, c in groups.items()]
    return f"CASE WHEN {match_scope(rule_id)} THEN {_sum(counts)} ELSE 0 END"


def injection_lines(pattern: cat.Pattern) -> str:
    """Lines of a file that match, as array<struct<line int, match string>>; else NULL."""
    per_line = pattern.one_pass or pattern.regex
    numbered = f"transform({tx.splitlines('text')}, (l, i) -> struct(i + 1 AS line, l AS match))"
    hit = tx.all_of(IN_PROMPT, guard(pattern), tx.rlike("text", per_line))
    return f"CASE WHEN {hit} THEN filter({numbered}, x -> {tx.rlike('x.match', per_line)}) END"


def count_injections(pattern: cat.Pattern) -> str:
    return f"coalesce(array_size({injection_lines(pattern)}), 0)"


def has_vendor(pattern: cat.Pattern) -> str:
    return tx.all_of("is_py", guard(pattern), tx.rlike("text", pattern.regex))


def calls_api_in_loop() -> str:
    """Whether a line below a loop header, indented deeper, names a model API.

    A header starts (or restarts) the loop and is not searched itself; a line
    indented no deeper than the header ends the loop.  The state is the indent
    of the open loop (-1: none) and whether a call was found.
    """
    lines = (
        f"transform({tx.splitlines('text')}, l -> struct({tx.strip('l')} AS body, "
        f"length(l) - length({tx.lstrip('l')}) AS indent, {tx.contains_any('l', cat.LOOP_API_WORDS)} AS api))"
    )
    state = "named_struct('indent', {}, 'found', {})"
    step = (
        "CASE WHEN s.found OR l.body = '' OR startswith(l.body, '#') THEN s "
        f"WHEN {tx.rlike('l.body', cat.LOOP_HEADER_REGEX)} THEN {state.format('l.indent', 'false')} "
        f"WHEN s.indent >= 0 AND l.indent <= s.indent THEN {state.format('-1', 'false')} "
        f"ELSE {state.format('s.indent', 's.indent >= 0 AND l.api')} END"
    )
    possible = tx.all_of("calls_api", _has(*cat.LOOP_API_WORDS), _has("for", "while"))
    walk = f"aggregate({lines}, {state.format('-1', 'false')}, (s, l) -> {step})"
    return f"CASE WHEN {possible} THEN {walk}.found ELSE false END"


def branch_count() -> str:
    possible = tx.all_of("is_py", _has(*cat.BRANCH_WORDS))
    return f"CASE WHEN {possible} THEN {tx.count_matches('text', cat.BRANCH_REGEX)} ELSE 0 END"


def few_types() -> str:
    """Fewer than three in ten function definitions carry an annotation."""
    typed = (
        f"size(filter(zip_with({tx.find_all('text', cat.TYPED_DEF_REGEX, 1)}, {tx.find_all('text', cat.TYPED_DEF_REGEX, 2)}, "
        "(params, arrow) -> arrow <> '' OR contains(params, ':')), t -> t))"
    )
    n_defs = f"size({tx.find_all('text', cat.DEF_SIGNATURE_REGEX)})"
    return f"CASE WHEN is_py AND contains(text, 'def') THEN coalesce({typed} / nullif({n_defs}, 0) < {cat.MIN_RATIO}D, false) ELSE false END"


def file_conditions() -> dict[str, str]:
    """The condition of each rule with at most one finding per file."""
    return {
        "compat_encoding": f"is_py AND {_has('.read()')} AND NOT {_has('encoding=')}",
        "corr_error_handling": f"is_py AND {_has('except')} AND {tx.rlike('text', cat.BARE_EXCEPT_REGEX)}",
        "corr_type_safety": few_types(),
        "corr_validation": f"calls_api AND {_has('openai')} AND NOT {_has(*cat.VALIDATION_WORDS)}",
        "corr_resource_cleanup": f"is_py AND {_has('open')} AND NOT {_has('with ')} AND {tx.rlike('text', cat.OPEN_REGEX)}",
        "corr_input_sanitization": f"is_py AND {_has(*cat.USER_INPUT_WORDS)} AND NOT {_has(*cat.SANITIZER_WORDS)}",
        "maint_complexity": f"{branch_count()} > {cat.MAX_BRANCHES}",
        "perf_api_efficiency": calls_api_in_loop(),
        "perf_latency": f"calls_api AND {_has(*cat.BLOCKING_API_WORDS)} AND NOT {_has(*cat.ASYNC_WORDS)}",
        "perf_streaming": f"calls_api AND {_has(*cat.STREAM_API_WORDS)} AND NOT {tx.rlike('text', cat.STREAM_ON_REGEX)}",
    }


def lacks_cache() -> str:
    return f"calls_api AND {_has(*cat.API_WORDS)} AND NOT contains(ltext, 'cache')"


def invites_hallucination() -> str:
    assume = f"({tx.contains_all('text', cat.ASSUME_NEEDS)} AND {tx.rlike('text', cat.ASSUME_REGEX)})"
    return f"is_prompt AND ({_has_ci(cat.INVENT_WORDS)} OR {_has_ci(cat.GUESS_WORDS)} OR {assume})"


def broad_mcp_permission() -> str:
    return f"{_json_config()} AND {tx.contains_all('ltext', cat.MCP_PERMISSION_WORDS)}"


def _sum(parts) -> str:
    return " + ".join(f"({p})" for p in parts)


def file_flags(cfg: AuditConfig) -> dict[str, tuple[str, str]]:
    """Per-file expressions and the aggregate that combines them, for enabled rules."""
    flags = dict(cl.manifest_flags())

    def put(name, expr, how="sum"):
        flags[name] = (f"coalesce(CAST({expr} AS INT), 0)", how) if how == "sum" else (f"coalesce({expr}, false)", how)

    put("n_py", "is_py AND text IS NOT NULL")
    put("prompt_unreadable", f"{IN_PROMPT} AND text IS NULL", "any")
    put("has_prompt_text", f"{IN_PROMPT} AND {tx.not_blank('text')}", "any")
    conditions = file_conditions()
    for rule_id in cat.FILE_RULES:
        if cfg.runs(rule_id):
            put(f"n_{rule_id}", conditions[rule_id])

    for rule_id in (*cat.MATCH_RULES, "prompt_injection"):
        if cfg.runs(rule_id):
            for severity in cat.SEVERITIES:
                patterns = [p for p in cat.RULE[rule_id].patterns if p.severity == severity]
                if patterns and rule_id == "prompt_injection":
                    put(f"n_{rule_id}_{severity}", _sum(count_injections(p) for p in patterns))
                elif patterns:
                    put(f"n_{rule_id}_{severity}", count_matches(rule_id, severity))
    if cfg.runs("sec_mcp_permissions"):
        put("n_sec_mcp_permissions", broad_mcp_permission())

    if cfg.runs("prompt_token_efficiency"):
        put("prompt_chars", f"CASE WHEN {IN_PROMPT} THEN length(text) + 1 END")
    if cfg.runs("prompt_clarity"):
        put("has_role", f"{IN_PROMPT} AND {_has_ci(cat.ROLE_WORDS)}", "any")
        put("has_format", f"{IN_PROMPT} AND {_has_ci(cat.FORMAT_WORDS)}", "any")
        put("has_steps", f"{IN_PROMPT} AND {_has_ci(cat.STEP_WORDS)}", "any")
        for i, word in enumerate(cat.FUZZY_WORDS):
            put(f"fuzzy_{i}", f"{IN_PROMPT} AND {_has(word)}", "any")
    if cfg.runs("prompt_specificity"):
        put("generic_request", f"{IN_PROMPT} AND {_has_ci(cat.GENERIC_REQUEST_WORDS)}", "any")
        put("generic_pointer", f"{IN_PROMPT} AND {_has_ci(cat.GENERIC_POINTER_WORDS)}", "any")

    if cfg.runs("maint_documentation"):
        root = "path = 'README.md'"
        put("readme_unreadable", f"{root} AND text IS NULL", "any")
        put("readme_short", f"{root} AND length(text) < {cat.SHORT_README}", "any")
        for code, word, other in cat.README_WORDS:
            put(f"readme_{code}", f"{root} AND NOT ({tx.contains('ltext', word)} OR {_has(other)})", "any")
    if cfg.runs("maint_tests"):
        is_test = "contains(lower(path), 'test')"
        n_lines = tx.count_lines("text")
        put("has_tests", is_test, "any")
        put("test_lines", f"CASE WHEN endswith(path, '.py') AND {is_test} THEN {n_lines} END")
        put("code_lines", f"CASE WHEN endswith(path, '.py') AND NOT {is_test} THEN {n_lines} END")
    if cfg.runs("maint_versioning"):
        put("has_changelog", "contains(lower(path), 'change')", "any")
        put("has_version_file", tx.is_in("path", cat.VERSION_FILES), "any")
    if cfg.runs("maint_comments"):
        put("n_defs", f"CASE WHEN is_py AND contains(text, 'def') THEN {tx.count_matches('text', cat.DEF_REGEX)} END")
        quotes = tx.q('"""')
        put("n_docstrings", f"CASE WHEN is_py AND contains(text, {quotes}) THEN {tx.count_matches('text', cat.DOCSTRING_REGEX)} END")

    if cfg.runs("perf_api_efficiency"):
        put("n_uncached", lacks_cache())
    if cfg.runs("corr_error_handling"):
        put("n_handled", f"is_py AND {tx.contains_all('text', ('try:', 'except'))}")
    if cfg.runs("corr_hallucination_risk"):
        put("n_hallucination", invites_hallucination())
    if cfg.runs("compat_vendor_lock"):
        put("n_vendor", _sum(f"coalesce(CAST({has_vendor(p)} AS INT), 0)" for p in cat.VENDOR_PATTERNS))
    if cfg.runs("compat_platform"):
        put("n_platform", f"is_py AND {_has(*cat.PLATFORM_WORDS)}")
    if cfg.runs("compat_protocol"):
        put("declares_version", f"{_json_config()} AND {_has(*cat.VERSION_KEYS)}", "any")
    return flags


def flag_dimensions(cfg: AuditConfig) -> dict[str, str]:
    """The dimension of each flag that only the rules of one dimension ask for."""
    def of(*dims):
        return set(file_flags(replace(cfg, dimensions={d: c for d, c in cfg.dimensions.items() if d in dims})))

    own = {d: of(d) - of() for d in cfg.enabled_dimensions()}
    return {n: d for d, names in own.items() for n in names if sum(n in other for other in own.values()) == 1}


def file_signals(classified: DataFrame, cfg: AuditConfig, only: str | None = None) -> DataFrame:
    """One row of counts and flags per file; no text.  ``only``: the name of a
    column of ``classified`` with the dimensions that the file's project needs;
    rules of others are not matched."""
    flags = file_flags(cfg)
    exprs = {n: c for n, (c, _) in flags.items()}
    if only is not None:
        nothing = {"sum": "0", "any": "false"}
        exprs |= {n: f"CASE WHEN array_contains({only}, '{d}') THEN {exprs[n]} ELSE {nothing[flags[n][1]]} END" for n, d in flag_dimensions(cfg).items()}
    return readable(classified).selectExpr("project_id", "path", *[f"{c} AS {n}" for n, c in exprs.items()])


def project_signals(files: DataFrame, cfg: AuditConfig, signals: DataFrame | None = None, classified: DataFrame | None = None,
                    repeated_lines: bool = True, configs: int | None = None) -> DataFrame:
    """Sums of the file signals per project, with skill type, dependency file
    and repeated lines.  Pass ``signals`` to start from a stored signal table.
    ``configs``: only so many configuration files tell the skill type."""
    classified = cl.classify(files) if classified is None else classified
    signals = file_signals(classified, cfg) if signals is None else signals
    out = signals.groupBy("project_id").agg(*cl.combine(file_flags(cfg)))
    if configs is not None:
        out = out.drop("config_mcp").join(cl.first_configs(classified, configs), "project_id", "left")
    if repeated_lines and cfg.runs("prompt_token_efficiency"):
        out = out.join(cl.duplicate_lines(classified), "project_id", "left")
    return out.selectExpr("*", *cl.DEPENDENCY, f"{cl.SKILL_TYPE} AS skill_type").drop("dependency")


def single_file_signals(classified: DataFrame, cfg: AuditConfig) -> DataFrame:
    """:func:`project_signals` of lone files (:func:`classify.single_files`): a
    prompt or unknown, without README, .gitignore and dependency file, whatever
    the file is called."""
    flags = file_flags(cfg)
    sums = file_signals(classified, cfg).groupBy("project_id").agg(*cl.combine(flags))
    absent = {n: "false" for n in flags if n.startswith("readme_") or n == "gitignore_exists"}
    absent |= {"dependency_file": "CAST(NULL AS STRING)", "dependency_readable": "false", "config_mcp": "false"}
    absent |= {f"dep_{p}": "false" for p in cl.PACKAGES}
    out = sums.drop("dependency").join(cl.duplicate_lines(classified), "project_id", "left")
    return out.selectExpr(
        *[c for c in out.columns if c not in absent], *[f"{e} AS {n}" for n, e in absent.items()],
        "CASE WHEN n_prompt > 0 THEN 'prompt' ELSE 'unknown' END AS skill_type")
