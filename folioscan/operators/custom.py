"""Rules, dimensions and scores of one's own, next to the built-in ones.

A rule is a pattern or a condition: SQL over the columns of
:func:`folioscan.operators.signals.readable` (path, kind, text, ltext, is_py,
is_prompt, ...).  It is matched in the row of the file, like the built-in rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from folioscan.functions import text as tx
from folioscan.operators import classify as cl, findings as fd, scores as sc, signals as sg
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat


@dataclass(frozen=True)
class CustomRule:
    rule_id: str
    message: str
    severity: str = "warning"
    category: str = "custom"
    scope: str = "is_py"
    pattern: str | None = None  # one finding per match, with its line
    condition: str | None = None  # one finding per file
    hint: str = ""
    penalty: int = 10  # points of the dimension each finding costs

    def __post_init__(self):
        if (self.pattern is None) == (self.condition is None):
            raise ValueError("give a pattern or a condition")
        if self.severity not in cat.SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r}")

    def hits(self) -> str:
        found = f"transform({tx.matches('text', self.pattern)}, m -> struct(m.line AS line, m.pos AS pos))" if self.pattern else (
            "array(struct(CAST(NULL AS INT) AS line, 0 AS pos))")
        test = tx.rlike("text", self.pattern) if self.pattern else f"({self.condition})"
        return f"CASE WHEN ({self.scope}) AND {test} THEN {found} END"

    def count(self) -> str:
        n = tx.count_matches("text", self.pattern) if self.pattern else f"CAST(({self.condition}) AS INT)"
        return f"coalesce(CASE WHEN ({self.scope}) THEN {n} END, 0)"


@dataclass(frozen=True)
class CustomDimension:
    code: str
    name: str
    rules: tuple[CustomRule, ...]
    weight: float = 0.1

    def __post_init__(self):
        if self.code in cat.DIMENSIONS or not 0.0 <= self.weight <= 1.0:
            raise ValueError("a dimension needs a code of its own and a weight from 0 to 1")


def custom_findings(files: DataFrame, dimensions: tuple[CustomDimension, ...]) -> DataFrame:
    cells = []
    for d_rank, d in enumerate(dimensions):
        for r_rank, r in enumerate(d.rules):
            fixed = (
                f"'{d.code}' AS dimension, {tx.q(r.rule_id)} AS rule_id, '{r.severity}' AS severity, {tx.q(r.category)} AS category, "
                f"{tx.q(r.message)} AS message, {tx.q(r.hint)} AS fix_hint, {1000 + 100 * d_rank + r_rank} AS rule_rank")
            cells.append(f"coalesce(transform({r.hits()}, h -> struct({fixed}, h.line AS line, h.pos AS pos)), array())")
    rows = sg.readable(cl.classify(files)).selectExpr("project_id", "path", f"concat({', '.join(cells)}) AS hits")
    return rows.selectExpr("project_id", "path", "explode_outer(hits) AS h").filter("h IS NOT NULL").selectExpr(
        "project_id", "h.dimension", "h.rule_id", "CAST(NULL AS STRING) AS pattern_id", "h.severity", "h.category", "path", "h.line",
        "concat(path, coalesce(concat(':', h.line), '')) AS location", "h.message", "h.fix_hint", "false AS auto_fixable",
        "'safe' AS fix_safety", "'deterministic' AS source", "h.rule_rank", "0 AS group_rank", "0 AS pattern_rank", "h.pos"
    ).select(*fd.COLUMNS)


def with_custom_dimensions(files: DataFrame, scores: DataFrame, dimensions: tuple[CustomDimension, ...], cfg: AuditConfig) -> DataFrame:
    """The score table with a column per dimension (100 less the penalties of its
    findings) and an overall score that counts them in, after the built-in ones."""
    counts = {f"{d.code}_n{i}": r.count() for d in dimensions for i, r in enumerate(d.rules)}
    sums = (
        sg.readable(cl.classify(files)).selectExpr("project_id", *[f"{e} AS {n}" for n, e in counts.items()])
        .groupBy("project_id").agg(*[F.expr(f"sum({n}) AS {n}") for n in counts]))
    out = scores.join(sums, "project_id")
    for d in dimensions:
        lost = " + ".join(f"{r.penalty} * {d.code}_n{i}" for i, r in enumerate(d.rules))
        out = out.selectExpr("*", f"CAST(greatest(0, 100 - ({lost})) AS INT) AS {d.code}")
    built_in = cfg.enabled_dimensions()
    total = " + ".join([*(f"{d} * {sc.weight(cfg, d)}" for d in built_in), *(f"{d.code} * {float(d.weight)!r}D" for d in dimensions)])
    weights = " + ".join([*(sc.weight(cfg, d) for d in built_in), *(f"{float(d.weight)!r}D" for d in dimensions)])
    return out.drop("overall", *counts).selectExpr("*", f"coalesce(CAST(({total}) / nullif({weights}, 0.0D) AS INT), 0) AS overall")
