"""From raw files to classified files and per-project manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscan.functions import text as tx
from folioscan.rules import catalog as cat

PACKAGES = tuple(pkg for pkg, _ in cat.RISKY_PACKAGES)


def file_kind(ext: str, text: str) -> str:
    """code, prompt, config or other; the first that fits."""
    marked = tx.contains_any_ci(text, f"lower({text})", tx.contains_any(text, tx.FOLDING_CHARS), cat.PROMPT_MARKERS)
    return (
        f"CASE WHEN {tx.is_in(ext, cat.CODE_SUFFIXES)} THEN 'code' WHEN {tx.is_in(ext, cat.PROMPT_SUFFIXES)} THEN 'prompt' "
        f"WHEN coalesce({marked}, false) THEN 'prompt' WHEN {tx.is_in(ext, cat.CONFIG_SUFFIXES)} THEN 'config' ELSE 'other' END"
    )


def classify(files: DataFrame) -> DataFrame:
    """Adds text, name, ext, kind, is_py and is_prompt to files(project_id, path, content, ...).

    A NULL content stands for a file that could not be read.
    """
    base = files.selectExpr(
        "*", f"{tx.unify_newlines('content')} AS text",
        f"{tx.file_name('path')} AS name", f"{tx.suffix('path')} AS ext",
    )
    kinds = base.selectExpr("*", f"{file_kind('ext', 'text')} AS kind")
    return kinds.selectExpr("*", "kind = 'code' AND endswith(path, '.py') AS is_py", "kind = 'prompt' AS is_prompt")


def single_files(files: DataFrame) -> DataFrame:
    """Each file a project of its own, named by its project and path: prompt text,
    or of the kind ``single`` that no rule but the token count looks at."""
    own = classify(files.selectExpr("struct(project_id, path) AS project_id", "path", "content"))
    prompt = tx.is_in("ext", cat.PROMPT_SUFFIXES)
    return own.drop("kind", "is_py", "is_prompt").selectExpr(
        "*", f"CASE WHEN {prompt} THEN 'prompt' ELSE 'single' END AS kind", "false AS is_py", f"{prompt} AS is_prompt")


def skipped_path(path: str) -> str:
    dirs = "|".join(d.replace(".", r"\.") for d in cat.SKIPPED_DIRS)
    return f"({path} RLIKE {tx.q(f'(^|/)({dirs})(/|$)')})"


LOWERED = "lower(coalesce(text, ''))"


def special_flags() -> dict[str, tuple[str, str]]:
    """What the dependency file (the last by path) and any configuration file
    say, as per-file columns with the aggregate that combines them."""
    says = ", ".join(f"{tx.contains(LOWERED, p)} AS dep_{p}" for p in PACKAGES)
    return {
        "dependency": (f"CASE WHEN {tx.is_in('name', cat.DEPENDENCY_FILES)} THEN struct(path, text IS NOT NULL AS readable, {says}) END", "last"),
        "config_mcp": (f"kind = 'config' AND {tx.contains(LOWERED, 'mcp')}", "any"),
    }


# Columns out of the combined ``dependency``.
DEPENDENCY = (
    "dependency.path AS dependency_file", "coalesce(dependency.readable, false) AS dependency_readable",
    *(f"coalesce(dependency.dep_{p}, false) AS dep_{p}" for p in PACKAGES))


def first_configs(classified: DataFrame, n: int) -> DataFrame:
    """(project_id, config_mcp) by the first ``n`` configuration files only,
    searched as one text, in which the word may straddle a border.  The rank
    limit prunes on the map side."""
    edge = (f"CASE WHEN length({LOWERED}) <= 4 THEN {LOWERED} "
            f"ELSE concat(substring({LOWERED}, 1, 2), '\\0', substring({LOWERED}, -2, 2)) END")
    order = Window.partitionBy("project_id").orderBy("path")
    first = classified.filter("kind = 'config'").selectExpr(
        "project_id", "path", f"{tx.contains(LOWERED, 'mcp')} AS has_mcp", f"{edge} AS edge")
    first = first.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    edges = "array_join(transform(sort_array(collect_list(struct(rn, edge))), x -> x.edge), '')"
    return first.groupBy("project_id").agg(F.expr(f"bool_or(has_mcp) OR contains({edges}, 'mcp') AS config_mcp"))


SKILL_TYPE = (
    "CASE WHEN path_mcp OR coalesce(config_mcp, false) THEN 'mcp' WHEN path_rag THEN 'rag' "
    "WHEN path_tool AND n_code > 0 THEN 'tool' WHEN path_agent THEN 'agent_workflow' "
    "WHEN n_prompt > 0 AND n_code = 0 THEN 'prompt' WHEN n_prompt > 0 AND n_code > 0 THEN 'hybrid' ELSE 'unknown' END"
)


def manifest_flags() -> dict[str, tuple[str, str]]:
    """Per-file columns of the manifest with the aggregate that combines them."""
    return {
        "n_files": ("1", "sum"),
        "n_code": ("CAST(kind = 'code' AS INT)", "sum"),
        "n_prompt": ("CAST(kind = 'prompt' AS INT)", "sum"),
        "n_config": ("CAST(kind = 'config' AS INT)", "sum"),
        "estimated_total_tokens": (
            f"CASE WHEN kind = 'other' THEN 0L ELSE coalesce({tx.token_estimate('text')}, 0L) END", "sum"),
        "readme_exists": ("lower(name) = 'readme.md'", "any"),
        "gitignore_exists": ("name = '.gitignore'", "any"),
        "path_mcp": (tx.contains_any("lower(path)", cat.MCP_PATH_WORDS), "any"),
        "path_rag": (tx.contains_any("lower(path)", cat.RAG_PATH_WORDS), "any"),
        "path_tool": (tx.contains("lower(path)", "tool"), "any"),
        "path_agent": (tx.contains_any("lower(path)", cat.AGENT_PATH_WORDS), "any"),
        **special_flags(),
    }


def combine(flags: dict[str, tuple[str, str]]) -> list[Column]:
    how = {"sum": "sum({0})", "any": "bool_or({0})", "last": "max_by({0}, {0}.path)"}
    return [F.expr(f"{how[kind].format(name)} AS {name}") for name, (_, kind) in flags.items()]


def manifests(files: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """One row per project.  File lists stay in :func:`project_files` (one row
    per file), since a project may hold any number of files."""
    classified = classify(files) if classified is None else classified
    flags = manifest_flags()
    per_project = (
        classified.selectExpr(
            "project_id", "CASE WHEN kind = 'code' THEN substring(ext, 2) END AS language",
            *[f"{c} AS {n}" for n, (c, _) in flags.items()])
        .groupBy("project_id")
        # At most one language per code suffix, so the set stays tiny.
        .agg(*combine(flags), F.expr("sort_array(collect_set(language)) AS languages"))
    )
    return per_project.selectExpr(
        "project_id", f"{SKILL_TYPE} AS skill_type", "n_files", "n_prompt", "n_code", "n_config",
        "dependency.path AS dependency_file", "readme_exists", "gitignore_exists", "estimated_total_tokens", "languages")


def project_files(files: DataFrame) -> DataFrame:
    """The manifest's file lists in long form."""
    return classify(files).selectExpr("project_id", "path", "kind", "ext", "length(text) AS n_chars")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(line_no, line) of every Python and prompt file."""
    lines = f"CASE WHEN is_py OR is_prompt THEN {tx.splitlines('text')} END"
    return (
        classify(files).selectExpr("project_id", "path", "kind", f"posexplode({lines}) AS (i, line)")
        .selectExpr("project_id", "path", "kind", "i + 1 AS line_no", "line"))


def code_metrics(files: DataFrame) -> DataFrame:
    """Functions, exception handling and hard-coded settings of each file."""
    hard = ", ".join(tx.find_all("text", p.regex) for p in cat.HARDCODED_PATTERNS)
    return classify(files).filter("text IS NOT NULL").selectExpr(
        "project_id", "path",
        f"CASE WHEN endswith(path, '.py') THEN {tx.count_matches('text', cat.DEF_REGEX)} ELSE 0 END AS n_functions",
        f"{tx.contains_all('text', ('try:', 'except'))} AS has_try_except", f"concat({hard}) AS hardcoded")


def duplicate_lines(classified: DataFrame) -> DataFrame:
    """Non-blank stripped lines of prompt text, and how many repeat another.

    Lines travel as 128-bit digests, already counted within each map task, so a
    line that makes up a third of the corpus is one row per task.
    """
    # Not a filter on the files: Spark would repeat the classification for it.
    lines = f"CASE WHEN is_py OR is_prompt THEN {tx.split_lines_loosely('text')} END"
    return (
        classified.selectExpr("project_id", f"explode({lines}) AS line")
        .selectExpr("project_id", f"{tx.strip('line')} AS line").filter("line <> ''")
        .selectExpr("project_id", "unhex(substring(sha2(line, 256), 1, 32)) AS digest")
        .groupBy("project_id", "digest").agg(F.expr("count(1) AS n"))
        .groupBy("project_id").agg(F.expr("sum(n) AS n_lines"), F.expr("sum(n) - count(1) AS n_duplicates")))


def exact_token_counts(files: DataFrame, make_encoder) -> DataFrame:
    """Tokens of each file by a real tokenizer instead of the estimate.

    ``make_encoder()`` runs once per task and returns ``encode(text) -> tokens``.
    """

    def count(batches):
        encode = make_encoder()
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield batch[["project_id", "path"]].assign(tokens=tokens)

    texts = classify(files).filter("kind <> 'other'").selectExpr("CAST(project_id AS STRING) AS project_id", "path", "text")
    return texts.mapInPandas(count, "project_id string, path string, tokens bigint")
