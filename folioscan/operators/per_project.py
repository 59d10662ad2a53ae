"""Configuration as rows: every project may have its own.

``settings(project_id, layer, dimension, rule_id, key, value)`` holds one line for
each thing that is set: ``enabled`` of a dimension or a rule, ``weight`` and
``threshold`` of a dimension, ``severity`` of a rule, ``fail_threshold`` (without a
dimension).  Of several lines for one thing the one of the highest layer holds;
what is not set is as in the base configuration.  Lines that name nothing known
or hold no valid value are ignored; :func:`refused` lists them.

All rules are matched, once; switches, weights and severities are columns of
the projects, looked up when scores and findings are made.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from folioscan.functions import text as tx
from folioscan.operators import findings as fd, scores as sc, signals as sg
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat

SETTINGS = "project_id {}, layer int, dimension string, rule_id string, key string, value string"


def _rows(layer: dict, number: int) -> list[tuple]:
    """The lines of one layer, as (layer, dimension, rule_id, key, value)."""
    out = []

    def put(dimension, rule, key, value):
        out.append((number, dimension, rule, key, json.dumps(value) if isinstance(value, bool) else str(value)))

    if layer.get("fail_threshold") is not None:
        put(None, None, "fail_threshold", layer["fail_threshold"])
    for d, body in layer.get("dimensions", {}).items():
        for key in ("enabled", "weight", "threshold"):
            if key in body:
                put(d, None, key, body[key])
        for rule, own in body.get("rules", {}).items():
            for key in ("enabled", "severity"):
                if own.get(key) is not None:
                    put(d, rule, key, own[key])
    return out


def settings_of(projects: DataFrame, *layers: dict) -> DataFrame:
    """The lines of ``layers``, later ones above, for each of ``projects(project_id)``."""
    lines = [row for i, layer in enumerate(layers) for row in _rows(layer, i)]
    kind = "array<struct<layer int, dimension string, rule_id string, key string, value string>>"
    rows = json.dumps([dict(zip(("layer", "dimension", "rule_id", "key", "value"), line)) for line in lines])
    return projects.select("project_id", F.inline(F.from_json(F.lit(rows), kind)))


def _valid() -> str:
    rule_of = " OR ".join(
        f"(dimension = '{d}' AND {tx.is_in('rule_id', [r.rule_id for r in cat.RULES if r.dimension == d])})" for d in cat.DIMENSIONS)
    dimension = f"{tx.is_in('dimension', cat.DIMENSIONS)} AND rule_id IS NULL"
    return (
        f"coalesce(CASE key WHEN 'enabled' THEN (({dimension}) OR {rule_of}) AND try_cast(value AS BOOLEAN) IS NOT NULL "
        f"WHEN 'weight' THEN {dimension} AND try_cast(value AS DOUBLE) BETWEEN 0 AND 1 "
        f"WHEN 'threshold' THEN {dimension} AND try_cast(value AS INT) IS NOT NULL "
        f"WHEN 'severity' THEN ({rule_of}) AND {tx.is_in('value', cat.SEVERITIES)} "
        "WHEN 'fail_threshold' THEN dimension IS NULL AND rule_id IS NULL AND try_cast(value AS INT) IS NOT NULL END, false)")


def refused(settings: DataFrame) -> DataFrame:
    """Lines that are ignored."""
    return settings.filter(f"NOT {_valid()}")


def resolved(settings: DataFrame) -> DataFrame:
    """(project_id, conf): what holds for each project, by name.  A project has as
    many names as there are things to set."""
    name = "concat_ws('/', key, dimension, rule_id)"
    held = settings.filter(_valid()).selectExpr("project_id", f"{name} AS name", "layer", "value")
    held = held.groupBy("project_id", "name").agg(F.max_by("value", F.struct("layer", "value")).alias("value"))
    return held.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("conf"))


def _of(name: str, kind: str, default: str) -> str:
    return f"coalesce(CAST(conf['{name}'] AS {kind}), {default})"


class Switches:
    """What holds for a row's project, as SQL over its ``conf``."""

    def __init__(self, base: AuditConfig):
        self.base = base

    def dimension(self, d: str) -> str:
        return _of(f"enabled/{d}", "BOOLEAN", "true" if d in self.base.enabled_dimensions() else "false")

    def rule(self, rule_id: str) -> str:
        d = cat.RULE[rule_id].dimension
        if rule_id == "prompt_missing":
            return self.dimension(d)
        return f"({self.dimension(d)} AND {_of(f'enabled/{d}/{rule_id}', 'BOOLEAN', 'true' if self.base.rule(rule_id).enabled else 'false')})"

    def weight(self, d: str) -> str:
        return _of(f"weight/{d}", "DOUBLE", f"{float(self.base.weight(d) if d in self.base.dimensions else cat.DIMENSION_WEIGHTS[d])!r}D")

    def severity(self, rule_id: str, own: str) -> str:
        d = cat.RULE[rule_id].dimension
        return _of(f"severity/{d}/{rule_id}", "STRING", f"'{self.base.severity(rule_id, own)}'")


def _everything() -> AuditConfig:
    """All dimensions and rules on."""
    return AuditConfig()


def project_signals(files: DataFrame, settings: DataFrame, base: AuditConfig | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Signals of each project with its ``conf``.  An unreadable README matters
    only where the documentation rule is on."""
    rows = sg.project_signals(files, _everything(), signals).join(resolved(settings), "project_id", "left")
    documented = Switches(base or AuditConfig()).rule("maint_documentation")
    return rows.withColumn("readme_unreadable", F.expr(f"readme_unreadable AND {documented}"))


def score_table(signals: DataFrame, base: AuditConfig | None = None) -> DataFrame:
    """As :func:`scores.score_table`; what a project has switched off is NULL."""
    on, every = Switches(base or AuditConfig()), _everything()
    wide = signals.selectExpr("*", *[f"{sc.failed(every, d)} AND {on.dimension(d)} AS {d}_failed" for d in cat.DIMENSIONS])
    subs = sc.sub_score_expressions(every, on.rule)
    wide = wide.selectExpr("*", *[f"CASE WHEN {on.dimension(d)} THEN {e} END AS {d}_{s}" for (d, s), e in subs.items()])
    wide = wide.selectExpr("*", *[f"CASE WHEN {on.dimension(d)} THEN {sc.weighted_score(d)} END AS {d}" for d in cat.DIMENSIONS])
    weights = {d: f"CASE WHEN NOT {on.dimension(d)} THEN 0.0D WHEN {d}_failed THEN 1.0D ELSE {on.weight(d)} END" for d in cat.DIMENSIONS}
    wide = wide.selectExpr("*", *[f"{w} AS weight_{d}" for d, w in weights.items()])
    total = " + ".join(f"coalesce({d}, 0) * weight_{d}" for d in cat.DIMENSIONS)
    return wide.selectExpr("*", f"coalesce(CAST(({total}) / nullif({' + '.join(f'weight_{d}' for d in cat.DIMENSIONS)}, 0.0D) AS INT), 0) AS overall")


def audits(scores: DataFrame, base: AuditConfig | None = None) -> DataFrame:
    base = base or AuditConfig()
    on = Switches(base)
    counts = sc.severity_counts(_everything(), switch=on.rule, severity=on.severity)
    threshold = _of("fail_threshold", "INT", "NULL" if base.fail_threshold is None else str(base.fail_threshold))
    rows = scores.selectExpr(
        "project_id", "skill_type", "n_files AS files_scanned", "overall", *cat.DIMENSIONS, *[f"{c} AS n_{s}" for s, c in counts.items()],
        f"coalesce(overall >= {threshold}, true) AS passes")
    out = sc.with_summary(rows, replace(_everything(), fail_threshold=None))
    return out.withColumn("passed", F.col("passes")).drop("passes")


def findings(files: DataFrame, settings: DataFrame, base: AuditConfig | None = None, signals: DataFrame | None = None) -> DataFrame:
    """The findings that count in their projects, with the severities these give."""
    on = Switches(base or AuditConfig())
    projects = project_signals(files, settings, base, signals)
    hits = signals.select("project_id", "path", "hits") if signals is not None else None
    found = fd.findings(files, _everything(), project_signals=projects, hits=hits).join(resolved(settings), "project_id", "left")
    runs = "CASE rule_id " + " ".join(f"WHEN '{r.rule_id}' THEN {on.rule(r.rule_id)}" for r in cat.RULES) + " END"
    said = "element_at(conf, concat_ws('/', 'severity', dimension, rule_id))"
    own = {(r.rule_id, s): on.base.severity(r.rule_id, s) for r in cat.RULES for s in cat.SEVERITIES}
    usual = "CASE " + " ".join(f"WHEN rule_id = '{r}' AND severity = '{s}' THEN '{n}'" for (r, s), n in own.items() if n != s) + " ELSE severity END"
    usual = usual if "WHEN" in usual else "severity"
    return found.filter(runs).withColumn("severity", F.expr(f"coalesce({said}, {usual})")).select(*fd.COLUMNS)


def dimension_gate(scores: DataFrame, base: AuditConfig | None = None) -> DataFrame:
    """Each dimension that is on against its project's own pass mark."""
    base = base or AuditConfig()
    on = Switches(base)
    marks = {d: _of(f"threshold/{d}", "INT", str(base.dimensions[d].threshold if d in base.dimensions else cat.DIMENSION_THRESHOLDS[d])) for d in cat.DIMENSIONS}
    cells = ", ".join(f"CASE WHEN {on.dimension(d)} THEN struct('{d}' AS dimension, {d} AS score, {marks[d]} AS threshold, {d} >= {marks[d]} AS passed) END"
                      for d in cat.DIMENSIONS)
    return scores.selectExpr("project_id", f"inline(array_compact(array({cells})))")
