"""Content hashes and audits that reuse stored results, by project or by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscan.operators import classify as cl, scores as sc, signals as sg
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat

_WORDS = range(8)


def file_hashes(files: DataFrame) -> DataFrame:
    """First 16 hex digits of the SHA-256 of each file."""
    return files.selectExpr("project_id", "path", "substring(sha2(content, 256), 1, 16) AS content_hash")


def project_hashes(files: DataFrame) -> DataFrame:
    """One hash per project over its (path, content) pairs.

    The pairs' SHA-256 values are added up in 32-bit words and the sums hashed:
    a sum needs no order, so the files of a project are never brought together.
    """
    pair = files.filter(f"NOT {cl.skipped_path('path')}").selectExpr(
        "project_id", "sha2(concat(path, '\\n', coalesce(sha2(content, 256), 'unreadable')), 256) AS h")
    words = [f"sum(CAST(conv(substring(h, {8 * i + 1}, 8), 16, 10) AS BIGINT)) AS w{i}" for i in _WORDS]
    sums = pair.groupBy("project_id").agg(F.expr("count(1) AS n"), *[F.expr(w) for w in words])
    joined = ", ".join(f"CAST(w{i} AS STRING)" for i in _WORDS)
    return sums.selectExpr(
        "project_id", "n AS n_files", f"substring(sha2(concat_ws(',', CAST(n AS STRING), {joined}), 256), 1, 16) AS project_hash")


def full_audit(files: DataFrame, cfg: AuditConfig) -> DataFrame:
    """The rows of the result store: audits with their content and config hashes."""
    audits = sc.audits(sc.score_table(sg.project_signals(files, cfg), cfg), cfg)
    return audits.join(project_hashes(files).select("project_id", "project_hash"), "project_id").withColumn(
        "config_hash", F.lit(cfg.digest()))


KEY = ("project_id", "project_hash", "config_hash")


def newest(store: DataFrame, order: str | None = None) -> DataFrame:
    """One row of the store for each project, content and configuration, however
    often it was appended: the last by ``order``, or any (they are equal)."""
    if order is None:
        return store.dropDuplicates(list(KEY))
    rest = [c for c in store.columns if c not in KEY]
    rows = store.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return rows.select(*KEY, "row.*").select(store.columns)


def incremental_audit(files: DataFrame, store: DataFrame, cfg: AuditConfig, order: str | None = None) -> DataFrame:
    """Audits only projects whose content or configuration is not in the store.

    Adds ``reused``; :func:`fresh` gives the rows to append to the store.  If few
    projects changed, Spark broadcasts their ids (it checks the size) or filters
    the files by a Bloom filter before the shuffle.
    """
    current = newest(store.filter(F.col("config_hash") == cfg.digest()), order)
    rest = [c for c in store.columns if c not in KEY]
    stored = current.select("project_id", "project_hash", F.struct(*rest).alias("row"))
    state = project_hashes(files).select("project_id", "project_hash").join(stored, ["project_id", "project_hash"], "left")
    known = state.filter("row IS NOT NULL").withColumn("config_hash", F.lit(cfg.digest())).select(*KEY, "row.*").select(store.columns)
    changed = state.filter("row IS NULL").select("project_id", "project_hash")
    audits = sc.audits(sc.score_table(sg.project_signals(files.join(changed.select("project_id"), "project_id", "left_semi"), cfg), cfg), cfg)
    fresh_rows = audits.join(changed, "project_id").withColumn("config_hash", F.lit(cfg.digest()))
    return known.withColumn("reused", F.lit(True)).unionByName(fresh_rows.withColumn("reused", F.lit(False)), allowMissingColumns=True)


def fresh(audited: DataFrame) -> DataFrame:
    """The rows of an incremental audit that the store does not hold yet."""
    return audited.filter("NOT reused").drop("reused")


# Reuse by dimension: a row of the store is what one dimension says of one content
# of a project under that dimension's own configuration.

DIMENSION_KEY = ("project_id", "project_hash", "dimension", "dimension_hash")


def dimension_hashes(cfg: AuditConfig) -> dict[str, str]:
    """The digest of each enabled dimension's own configuration."""
    return {d: AuditConfig({d: cfg.dimensions[d]}, None, cfg.override_severity).digest() for d in cfg.enabled_dimensions()}


def dimension_results(scores: DataFrame, cfg: AuditConfig) -> DataFrame:
    """A row for each project and dimension: its score, and what its findings
    count; with the project's kind and number of files."""
    hashes = dimension_hashes(cfg)
    cells = []
    for d in cfg.enabled_dimensions():
        subs = ", ".join(f"'{s}', {d}_{s}" for s, _ in cat.SUB_WEIGHTS[d])
        counts = ", ".join(f"{e} AS n_{s}" for s, e in sc.severity_counts(cfg, d).items())
        cells.append(f"struct('{d}' AS dimension, '{hashes[d]}' AS dimension_hash, CAST({d} AS INT) AS score, {sc.weight(cfg, d)} AS weight, "
                     f"{d}_failed AS failed, map({subs}) AS sub_scores, {counts})")
    return scores.selectExpr("project_id", "skill_type", "n_files AS files_scanned", f"inline(array({', '.join(cells)}))")


def full_dimensions(files: DataFrame, cfg: AuditConfig) -> DataFrame:
    """The rows of a store of dimensions."""
    rows = dimension_results(sc.score_table(sg.project_signals(files, cfg), cfg), cfg)
    return rows.join(project_hashes(files).select("project_id", "project_hash"), "project_id")


def incremental_dimensions(files: DataFrame, store: DataFrame, cfg: AuditConfig, hashes: DataFrame | None = None) -> DataFrame:
    """A row for each project and enabled dimension, with ``reused``.

    What the store holds of a project's content and a dimension's configuration
    is reused, whatever became of the other dimensions.  Of the other projects'
    files only the rules of the dimensions they lack are matched, in one read.
    ``hashes`` may be a stored table of :func:`project_hashes`.
    """
    own = dimension_hashes(cfg)
    wanted = " OR ".join(f"(dimension = '{d}' AND dimension_hash = '{h}')" for d, h in own.items()) or "false"
    held = store.filter(wanted).dropDuplicates(list(DIMENSION_KEY))
    rest = [c for c in store.columns if c not in ("project_id", "project_hash")]
    # Six rows at most for a project and content.
    rows = held.groupBy("project_id", "project_hash").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    hashes = project_hashes(files) if hashes is None else hashes
    state = hashes.select("project_id", "project_hash").join(rows, ["project_id", "project_hash"], "left")
    known = state.selectExpr("project_id", "project_hash", "inline(rows)").select(store.columns)
    every = ", ".join(f"'{d}'" for d in own)
    lacking = state.selectExpr("project_id", "project_hash", f"array_except(array({every}), coalesce(rows.dimension, array())) AS lacks").filter("size(lacks) > 0")
    due = files.join(lacking, "project_id")
    classified = cl.classify(due)
    signals = sg.file_signals(classified, cfg, "lacks")
    project = sg.project_signals(due, cfg, signals, cl.classify(due.filter("array_contains(lacks, 'P')")))
    results = dimension_results(sc.score_table(project, cfg), cfg)
    made = results.join(lacking, "project_id").filter("array_contains(lacks, dimension)").select(store.columns)
    return known.withColumn("reused", F.lit(True)).unionByName(made.withColumn("reused", F.lit(False)))


def assembled_audits(results: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Audits put together out of dimensions' results."""
    dims = cfg.enabled_dimensions()
    cells = [F.expr(f"max(CASE WHEN dimension = '{d}' THEN {c} END) AS {n}") for d in dims for c, n in (("score", d), ("failed", f"{d}_failed"))]
    counts = [F.sum(f"n_{s}").alias(f"n_{s}") for s in cat.SEVERITIES]
    wide = results.groupBy("project_id").agg(F.first("skill_type").alias("skill_type"), F.first("files_scanned").alias("files_scanned"), *cells, *counts)
    rows = wide.selectExpr("project_id", "skill_type", "files_scanned", f"{sc.overall_score(cfg)} AS overall", *dims, *[f"n_{s}" for s in cat.SEVERITIES])
    return sc.with_summary(rows, cfg)
