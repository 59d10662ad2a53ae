"""Text patches for findings, and files with the patches applied.

A patch depends on one file only, so patches are computed and applied within
the row of the file: no text is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from folioscan.functions import text as tx
from folioscan.operators import classify as cl, findings as fd, signals as sg
from folioscan.operators.splice import splice
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat

LEVELS = ("none", "safe", "suggested", "all")
PATCH = "struct<original string, replacement string, description string, safety string, issue_rule_id string>"
COLUMNS = ("project_id", "file_path", "original", "replacement", "description", "safety", "issue_rule_id", "seq", "applied")

FUZZY_NOTE = "\n<!-- audit note: replace fuzzy words by measurable limits -->\n"


def fix_secret(line: str) -> str:
    """``name = "value"`` becomes a read of the environment, for names that end
    like a secret; every assignment on the line is looked at."""
    names, whole = tx.find_all(line, cat.SECRET_ASSIGNMENT_REGEX, 1), tx.find_all(line, cat.SECRET_ASSIGNMENT_REGEX)
    is_secret = tx.any_of(*[f"endswith(upper(n), {tx.q(e)})" for e in cat.SECRET_NAME_ENDINGS])
    new = f"CASE WHEN {is_secret} THEN concat(n, ' = os.environ.get(\"', upper(n), '\", \"\")') ELSE w END"
    between = f"split({line}, {tx.q(tx.jregex(cat.SECRET_ASSIGNMENT_REGEX))}, -1)"
    pieces = f"zip_with({between}, zip_with({whole}, {names}, (w, n) -> {new}), (b, r) -> concat(b, coalesce(r, '')))"
    return f"array_join({pieces}, '')"


def fix_dangerous(line: str) -> str:
    """eval to literal_eval, or else os.system to subprocess.run."""
    arg = f"regexp_extract({line}, {tx.q(tx.jregex(r'os\.system\((.+)\)'))}, 1)"
    return (
        f"CASE WHEN contains({line}, 'eval(') AND NOT contains({line}, 'ast.literal_eval') "
        f"THEN replace({line}, 'eval(', 'ast.literal_eval(') WHEN {arg} <> '' "
        f"THEN replace({line}, concat('os.system(', {arg}, ')'), concat('subprocess.run(', {arg}, ', shell=True, check=True)')) "
        f"ELSE {line} END"
    )


# rule, fixer of a line, description, safety; in the order findings arise.
# A fixer takes and returns the SQL of a line; own ones can be passed along.
LINE_FIXERS = (
    ("sec_secrets", fix_secret, "read the secret from the environment", "safe"),
    ("sec_dangerous_functions", fix_dangerous, "replace the dangerous call", "suggested"),
)


def allowed(level: str) -> tuple[str, ...]:
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return cat.SAFETIES[:LEVELS.index(level)]


def with_patches(classified: DataFrame, level: str, cfg: AuditConfig, line_fixers=LINE_FIXERS) -> DataFrame:
    """Adds ``patches``, an array in finding order, one patch per original line."""
    fixers = [f for f in line_fixers if f[3] in allowed(level) and cfg.runs(f[0])]
    df = sg.readable(classified)
    hits = {rule: f"transform(concat({', '.join(fd.file_hits(rule))}), h -> h.line)" for rule, *_ in fixers}
    df = df.selectExpr("*", *[f"{e} AS at_{rule}" for rule, e in hits.items()])
    touched = tx.any_of(*[f"size(at_{rule}) > 0" for rule in hits]) if hits else "false"
    df = df.selectExpr("*", f"CASE WHEN {touched} THEN {tx.splitlines('text')} END AS lines")
    taken = "CAST(array() AS array<string>)"
    done = []
    for rule, fixer, description, safety in fixers:
        # Findings count lines by \n only, so a line may not exist.
        # The outer lambda holds the lines: Spark would split the text anew for each of them.
        lines = f"transform(array(lines), held -> array_distinct(array_compact(transform(at_{rule}, n -> get(held, n - 1)))))[0]"
        patch = f"named_struct('original', o, 'replacement', {fixer('o')}, 'description', {tx.q(description)}, 'safety', '{safety}', 'issue_rule_id', '{rule}')"
        df = df.selectExpr("*", f"coalesce(filter(transform(array_except({lines}, {taken}), o -> {patch}), "
                                f"p -> p.replacement <> p.original), CAST(array() AS array<{PATCH}>)) AS fix_{rule}")
        done.append(f"fix_{rule}")
        taken = f"transform(concat({', '.join(done)}), p -> p.original)"
    patches = f"concat({', '.join(done)})" if done else f"CAST(array() AS array<{PATCH}>)"
    return df.selectExpr("project_id", "path", "content", "text", f"{patches} AS patches")


def gitignore_patches(classified: DataFrame, cfg: AuditConfig) -> DataFrame:
    """A new-file patch for each project without a .gitignore."""
    broken = "path = 'README.md' AND text IS NULL" if cfg.runs("maint_documentation") else "false"
    lacking = classified.groupBy("project_id").agg(
        F.expr("bool_or(name = '.gitignore') AS has"), F.expr(f"bool_or({broken}) AS broken")
    ).filter("NOT has AND NOT broken")
    return lacking.selectExpr(
        "project_id", "'.gitignore' AS file_path", "'' AS original", f"{tx.q(cat.GITIGNORE_BODY)} AS replacement",
        "'add a standard .gitignore' AS description", "'safe' AS safety", "'maint_versioning' AS issue_rule_id", "0 AS seq", "true AS applied")


def _adds_gitignore(level: str, cfg: AuditConfig) -> bool:
    return "safe" in allowed(level) and cfg.runs("maint_versioning")


def patches(files: DataFrame, level: str = "safe", cfg: AuditConfig | None = None, line_fixers=LINE_FIXERS) -> DataFrame:
    """One row per patch.  ``applied``: whether the text still holds its original
    when its turn comes."""
    cfg = cfg or AuditConfig()
    classified = cl.classify(files)
    rows = with_applied(with_patches(classified, level, cfg, line_fixers)).selectExpr("project_id", "path", "patches", "result.applied AS done")
    rows = rows.selectExpr("project_id", "path AS file_path", "done", "posexplode_outer(patches) AS (seq, p)")
    rows = rows.filter("p IS NOT NULL").selectExpr(
        "project_id", "file_path", "p.original", "p.replacement", "p.description", "p.safety", "p.issue_rule_id", "seq", "get(done, seq) AS applied")
    if _adds_gitignore(level, cfg):
        rows = rows.unionByName(gitignore_patches(classified, cfg))
    return rows.select(*COLUMNS)


def apply_patches(patches_expr: str, text: str) -> str:
    """struct<t, applied>: each patch in turn replaces the first occurrence of
    its original, if there is one.  See :func:`with_applied` for many patches."""
    at = "instr(s.t, p.original)"
    swap = f"concat(substring(s.t, 1, {at} - 1), p.replacement, substring(s.t, {at} + length(p.original)))"
    step = f"struct(CASE WHEN {at} > 0 THEN {swap} ELSE s.t END AS t, array_append(s.applied, {at} > 0) AS applied)"
    return f"aggregate({patches_expr}, struct({text} AS t, CAST(array() AS array<boolean>) AS applied), (s, p) -> {step})"


# A patch more makes the fold search the text once more; beyond this many the
# originals are sought together.
FOLDED = 64


def _spliced(text: pd.Series, originals: pd.Series, replacements: pd.Series) -> pd.DataFrame:
    def line(t, old, new):
        if t is None:
            return None, None
        pairs = [tuple(x.decode("utf-8", "surrogateescape") for x in pair) for pair in zip(old, new)]
        t, applied = splice(t.decode("utf-8", "surrogateescape"), pairs)
        return t.encode("utf-8", "surrogateescape"), applied

    return pd.DataFrame([line(*row) for row in zip(text, originals, replacements)], columns=["t", "applied"])


def with_applied(rows: DataFrame, folded: int = FOLDED) -> DataFrame:
    """Adds ``result``, struct<t, applied>, to rows with text and patches.  Files
    with few patches stay in the JVM; of the others, each takes one pass."""
    def part(field: str) -> str:
        return f"CASE WHEN size(patches) > {folded} THEN transform(patches, p -> CAST(p.{field} AS BINARY)) END"

    rows = rows.withColumn("spliced", F.pandas_udf(_spliced, "t binary, applied array<boolean>")(
        F.expr(f"CASE WHEN size(patches) > {folded} THEN CAST(text AS BINARY) END"), F.expr(part("original")), F.expr(part("replacement"))))
    few = apply_patches("patches", "text")
    return rows.selectExpr(
        "*", f"CASE WHEN size(patches) > {folded} THEN struct(CAST(spliced.t AS STRING) AS t, spliced.applied AS applied) "
             f"WHEN size(patches) > 0 THEN {few} END AS result").drop("spliced")


def patched_files(files: DataFrame, level: str = "safe", cfg: AuditConfig | None = None, line_fixers=LINE_FIXERS) -> DataFrame:
    """The files with their patches applied, and the new files; files without a
    patch keep their content as it is."""
    cfg = cfg or AuditConfig()
    classified = cl.classify(files)
    rows = with_applied(with_patches(classified, level, cfg, line_fixers)).selectExpr(
        "project_id", "path", "CASE WHEN size(patches) > 0 THEN result.t ELSE content END AS content", "size(patches) AS n_patches")
    if _adds_gitignore(level, cfg):
        rows = rows.unionByName(gitignore_patches(classified, cfg).selectExpr(
            "project_id", "file_path AS path", "replacement AS content", "1 AS n_patches"))
    return rows


def patch_stats(patch_rows: DataFrame) -> DataFrame:
    return patch_rows.groupBy("safety", "issue_rule_id").agg(
        F.expr("count(1) AS n_patches"), F.expr("count_if(original = '') AS n_new_files"), F.expr("count_if(applied) AS n_applied"),
        F.expr("count_if(NOT applied) AS n_failed"))


def fuzzy_prompt_patches(files: DataFrame) -> DataFrame:
    """A note appended to the first prompt file of a project with a fuzzy word.

    No finding asks for it (fuzzy words are not fixable by themselves), so it is
    not part of :func:`patches`.
    """
    hits = cl.classify(files).filter("is_prompt").filter(tx.contains_any("text", cat.FUZZY_WORDS))
    first = Window.partitionBy("project_id").orderBy("path")
    return hits.select("project_id", "path", "text").withColumn("rn", F.row_number().over(first)).filter("rn = 1").selectExpr(
        "project_id", "path AS file_path", "text AS original", f"concat(text, {tx.q(FUZZY_NOTE)}) AS replacement",
        "'note on fuzzy words' AS description", "'suggested' AS safety", "'prompt_clarity' AS issue_rule_id", "0 AS seq", "true AS applied")
