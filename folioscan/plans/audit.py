"""Whole audits: one lazy plan, or a job that stores what it computes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from folioscan.functions import text as tx
from folioscan.operators import classify as cl, findings as fd, fixes as fx, judges as jd, scores as sc, signals as sg
from folioscan.plans.config import AuditConfig


@dataclass
class Audit:
    """The tables of an audit over files(project_id, path, content), all lazy.

    ``signals`` may be a stored per-file table (:meth:`store_signals`); scores and
    findings then read that small table instead of matching the text again.
    ``judged`` may be answers of model judges (:func:`judges.call_judge`); scores,
    findings, counts and what follows from them then include theirs.
    """

    files: DataFrame
    config: AuditConfig = None
    signals: DataFrame | None = None
    single: bool = False  # every file is a project of its own
    judged: DataFrame | None = None
    first_configs: int | None = None  # only so many configuration files tell the skill type

    def __post_init__(self):
        self.config = self.config or AuditConfig()
        if self.signals is not None:
            missing = set(sg.file_flags(self.config)) - set(self.signals.columns)
            if missing:
                raise ValueError(f"the stored signals lack {', '.join(sorted(missing))}")

    @cached_property
    def classified(self) -> DataFrame:
        return cl.single_files(self.files) if self.single else cl.classify(self.files)

    @cached_property
    def project_signals(self) -> DataFrame:
        if self.single:
            return sg.single_file_signals(self.classified, self.config)
        return sg.project_signals(self.files, self.config, self.signals, self.classified, configs=self.first_configs)

    @cached_property
    def score_table(self) -> DataFrame:
        scores = sc.score_table(self.project_signals, self.config)
        if self.judged is None:
            return scores
        return sc.with_counts(jd.blend(scores, self.parsed, self.config), self.judge_findings())

    @cached_property
    def parsed(self) -> DataFrame:
        return jd.parse_responses(self.judged)

    def judge_findings(self) -> DataFrame:
        return jd.judge_findings(self.parsed).filter(tx.is_in("dimension", self.config.enabled_dimensions()))

    def manifests(self) -> DataFrame:
        return cl.manifests(self.files, self.classified)

    def findings(self, rules=None) -> DataFrame:
        # Findings need no repeated lines; the scores' signals have them.
        project = self.project_signals if self.single else sg.project_signals(
            self.files, self.config, self.signals, self.classified, repeated_lines=False, configs=self.first_configs)
        hits = self.signals.select("project_id", "path", "hits") if self.signals is not None and "hits" in self.signals.columns else None
        own = rules
        if self.single:  # without a dependency file
            own = [r for r in rules or fd.cat.RULE if r != "sec_dependencies"]
        found = fd.findings(self.files, self.config, own, self.classified, project, hits)
        # Judges' findings belong to no rule.
        return found if self.judged is None or rules is not None else found.unionByName(self.judge_findings())

    def sub_scores(self) -> DataFrame:
        return sc.sub_scores(self.score_table, self.config)

    def dimension_scores(self) -> DataFrame:
        return sc.dimension_scores(self.score_table, self.config)

    def audits(self, nested: bool = False) -> DataFrame:
        return sc.audits(self.score_table, self.config, nested)

    def patches(self, level: str = "safe") -> DataFrame:
        return fx.patches(self.files, level, self.config)

    def patched_files(self, level: str = "safe") -> DataFrame:
        return fx.patched_files(self.files, level, self.config)

    def store_signals(self, path: str) -> Audit:
        """Matches the text once and writes counts, flags and hits of each file;
        the returned audit reads them."""
        flags = sg.file_flags(self.config)
        rows = sg.readable(self.classified).selectExpr(
            "project_id", "path", *[f"{c} AS {n}" for n, (c, _) in flags.items()], f"{fd.hits_column(self.config)} AS hits")
        # The schema carries what was matched, so that a reader need not look into the rows.
        rows = rows.withMetadata("hits", {"rules": sorted(fd.matched_rules(self.config)), "config": self.config.digest()})
        rows.write.mode("overwrite").parquet(path)
        return Audit(self.files, self.config, self.files.sparkSession.read.parquet(path), self.single, self.judged, self.first_configs)


def run(files: DataFrame, out: str, config: AuditConfig | None = None) -> Audit:
    """An audit job: signals first, then findings and scores as tables below ``out``.

    Every step ends in a written table, so a lost executor costs one step at most.
    """
    audit = Audit(files, config).store_signals(f"{out}/signals")
    audit.findings().write.mode("overwrite").partitionBy("dimension").parquet(f"{out}/findings")
    # Repeated lines and special files are looked up once, for both tables of scores.
    audit.score_table.write.mode("overwrite").parquet(f"{out}/scores")
    audit.score_table = files.sparkSession.read.parquet(f"{out}/scores")
    audit.audits().write.mode("overwrite").parquet(f"{out}/audits")
    audit.dimension_scores().write.mode("overwrite").parquet(f"{out}/dimension_scores")
    return audit
