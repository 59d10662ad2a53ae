"""Audits of files that keep arriving.

What a rule finds in one file needs that file only, so it streams.  Rules about a
whole project need sums over its files as they are: :func:`maintain` keeps them
in a :class:`maintained.SignalStore`, from which whole audits are read after
every batch.

A file may arrive again, unchanged or changed.  Every streamed row names the
version of the file it was made from (its arrival and a hash of its content);
:func:`newest` and :func:`current_findings` reduce the streamed tables to the
last version of each file before anything is summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators import classify as cl, findings as fd, signals as sg
from folioscan.operators.maintained import SignalStore, maybe_in
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat
from folioscan.session import shared_dir

FILE_LEVEL_RULES = (*cat.MATCH_RULES, "prompt_injection", "compat_vendor_lock", *cat.FILE_RULES)
FILE = ("project_id", "path")
VERSION = ("arrived", "content_sha")


def _named(arrivals: DataFrame) -> DataFrame:
    return arrivals.withColumn("content_sha", F.sha2(F.coalesce("content", F.lit("unreadable")), 256))


def _seen(arrivals: DataFrame, *columns: str, delay: str = "1 hour") -> DataFrame:
    """``columns`` of the versions in a stream of files(project_id, path,
    content, arrived).  What is delivered again, the same content with the same
    arrival, is dropped within ``delay``; by then texts are done with, so they
    are not shuffled."""
    rows = sg.readable(cl.classify(_named(arrivals.withWatermark("arrived", delay)))).selectExpr(*FILE, *VERSION, *columns)
    return rows.dropDuplicatesWithinWatermark([*FILE, *VERSION])


def store_versions(arrivals: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each version of a file once, with its ``content_sha``, to the table
    ``files`` below ``out``, however often and late it is delivered.  Only texts
    that come twice within a batch, or seem to have come before, are shuffled.  A
    batch that is run again overwrites what it wrote."""
    keys = [*FILE, *VERSION]

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = _named(batch)
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.lit(0).alias("batches"))
        if batch_id:
            known = spark.read.parquet(f"{out}/keys").where(F.col("batch") < batch_id).select(*keys, F.lit(0).alias("n"), F.lit(1).alias("batches"))
            counts = counts.unionByName(known).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("batches").alias("batches")).where("n > 0")
        path = shared_dir(spark, "versions")
        counts.write.parquet(path)
        counts = spark.read.parquet(path)
        new = counts.where("batches = 0").select(*keys)
        marked = maybe_in(maybe_in(rows, new, keys), counts.where("batches > 0 OR n > 1"), keys, "again")
        same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        again = marked.where("again").alias("rows").join(new.alias("new"), same, "left_semi").dropDuplicates(keys)
        marked.where("NOT again").unionByName(again).drop("again").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/files/batch={batch_id}")
        new.write.mode("overwrite").parquet(f"{out}/keys/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def stream_findings(arrivals: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """A stream of file-level findings, each with the version of its file."""
    cfg = cfg or AuditConfig()
    hits = _seen(arrivals, f"{fd.hits_column(cfg, FILE_LEVEL_RULES)} AS hits")
    # The version travels through the operator as part of the path.
    keyed = hits.selectExpr("struct(project_id, arrived, content_sha) AS project_id", "path", "explode_outer(hits) AS hit", "CAST(NULL AS STRING) AS place")
    found = fd.finish(keyed, arrivals.sparkSession, cfg)
    return found.selectExpr("project_id.*", *[c for c in fd.COLUMNS if c != "project_id"])


def stream_signals(arrivals: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """A stream of per-file signals; batch audits sum them per project."""
    cfg = cfg or AuditConfig()
    flags = sg.file_flags(cfg)
    return _seen(arrivals, *[f"{c} AS {n}" for n, (c, _) in flags.items()])


def newest(signals: DataFrame) -> DataFrame:
    """The signals of the last version of each file."""
    rest = [c for c in signals.columns if c not in (*FILE, *VERSION)]
    last = signals.groupBy(*FILE).agg(F.max_by(F.struct(*VERSION, *rest), F.struct(*VERSION)).alias("last"))
    return last.select(*FILE, "last.*")


def current_findings(found: DataFrame, signals: DataFrame) -> DataFrame:
    """The findings of the last version of each file, once each.  ``signals`` has
    a row for every version, also of files without a finding."""
    last = newest(signals.select(*FILE, *VERSION)).select(*FILE, "content_sha")
    rows = found.join(last, [*FILE, "content_sha"], "left_semi")
    return rows.dropDuplicates(list(dict.fromkeys([*FILE, *fd.ORDER, "rule_id"]))).select(*fd.COLUMNS)


def current_files(arrived: DataFrame) -> DataFrame:
    """The last version of each file of a stored table of arrivals.  Texts of
    earlier ones are left out before the others are grouped."""
    rows = _named(arrived.select(*FILE, "content", "arrived"))
    path = shared_dir(arrived.sparkSession, "newest")
    newest(rows.select(*FILE, *VERSION)).write.parquet(path)
    last = maybe_in(rows, arrived.sparkSession.read.schema(rows.select(*FILE, *VERSION).schema).parquet(path), [*FILE, *VERSION])
    return last.groupBy(*FILE).agg(F.max_by("content", F.struct(*VERSION)).alias("content"))


def write_stream(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream to a parquet table, each row exactly once."""
    return (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def maintain(arrivals: DataFrame, store: SignalStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Feeds files(project_id, path, content, arrived) into a store of its own,
    which nothing else updates, a version for each batch.  A batch that is run again after a failure
    overwrites what it left, or is skipped if it was done; files may come
    changed, again, or late."""

    def save(batch: DataFrame, batch_id: int) -> None:
        store.update(batch, version=batch_id + 1)

    return (
        arrivals.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def stream_counts(arrivals: DataFrame, delay: str = "1 hour", cfg: AuditConfig | None = None, rules=FILE_LEVEL_RULES) -> DataFrame:
    """A stream of (project_id, path, arrived, rule_id, n): how often each rule
    found something in a content, once for each content of a file within
    ``delay``.  Counted in the rows of the files."""
    cfg = cfg or AuditConfig()
    sizes = []
    for r in rules:
        if cfg.runs(r):
            total = " + ".join(f"coalesce(array_size({h}), 0)" for h in fd.file_hits(r))
            sizes.append(f"named_struct('rule_id', '{r}', 'n', CAST({total} AS BIGINT))")
    once = (arrivals.withWatermark("arrived", delay).withColumn("content_sha", F.sha2(F.coalesce("content", F.lit("unreadable")), 256))
            .dropDuplicatesWithinWatermark([*FILE, "content_sha"]))
    return sg.readable(cl.classify(once)).selectExpr(*FILE, "arrived", f"inline(array({', '.join(sizes)}))").filter("n > 0")


def windowed_counts(counts: DataFrame, size: str, delay: str = "1 hour") -> DataFrame:
    """Findings per rule and tumbling window of arrival time, from a stream over
    the table that :func:`stream_counts` writes.  (Two streams, as Spark runs
    one aggregation in update mode, and removing repeats is one.)"""
    return (
        counts.withWatermark("arrived", delay).groupBy(F.window("arrived", size), "rule_id")
        .agg(F.sum("n").alias("n_findings")).selectExpr("window.start AS window_start", "rule_id", "n_findings"))


def count_with_late(arrivals: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", cfg: AuditConfig | None = None,
                    rules=FILE_LEVEL_RULES, trigger: dict | None = None) -> StreamingQuery:
    """Counts what each rule finds in each arriving content, in the table
    ``counts`` below ``out``.  Rows that arrived more than ``delay`` before the
    latest arrival of earlier batches are marked ``late``.  Nothing is dropped; a
    batch that is run again overwrites what it wrote."""
    cfg = cfg or AuditConfig()
    sizes = [f"named_struct('rule_id', '{r}', 'n', CAST({' + '.join(f'coalesce(array_size({h}), 0)' for h in fd.file_hits(r))} AS BIGINT))"
             for r in rules if cfg.runs(r)]

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = None
        if batch_id:
            latest = spark.read.schema("latest timestamp, batch int").parquet(f"{out}/marks").where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        keyed = batch.withColumn("content_sha", F.sha2(F.coalesce("content", F.lit("unreadable")), 256))
        found = sg.readable(cl.classify(keyed)).selectExpr(*FILE, "content_sha", "arrived", f"inline(array({', '.join(sizes)}))").where("n > 0")
        late = F.lit(False) if latest is None else F.col("arrived") < F.lit(latest) - F.expr(f"INTERVAL {delay}")
        counted = found.withColumn("late", F.coalesce(late, F.lit(False)))
        counted.write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        batch.agg(F.max("arrived").alias("latest")).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def counted_windows(counts: DataFrame, size: str) -> DataFrame:
    """(window_start, rule_id, n_findings, n_late) from the ``counts`` table of
    :func:`count_with_late`: each content of a file once, in the window of its
    first arrival, also if that came late.  ``n_late``: findings that only late
    rows brought, or brought into this window."""
    first = counts.groupBy(*FILE, "content_sha", "rule_id").agg(
        F.first("n").alias("n"), F.min("arrived").alias("arrived"), F.expr("min(CASE WHEN NOT late THEN arrived END) AS on_time"))
    rows = first.select("rule_id", "n", F.window("arrived", size).alias("window"), "on_time")
    return rows.groupBy(F.col("window.start").alias("window_start"), "rule_id").agg(
        F.sum("n").alias("n_findings"), F.expr("sum(CASE WHEN on_time < window.end THEN 0 ELSE n END) AS n_late"))


def write_updates(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each update of an aggregating stream with its batch number."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def latest_updates(updates: DataFrame, keys) -> DataFrame:
    """The last value written for each key."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id", "batch")]
    return updates.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])
