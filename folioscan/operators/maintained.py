"""Signals by content, and project sums that follow the files as they change.

A rule sees a file's text and some traits of its path.  Files with the same
content and traits are one *content*: it is matched once, however many files in
however many projects hold it and whenever they arrive.  What a project's files
add up to is kept as sums that can be taken back: an update subtracts what the
contents that went held and adds what those that came hold.

A store is a folder of tables that only grow, a folder of each for every
version:

* ``contents``: key, the signals as numbers, the hits, the digests of prompt lines;
* ``changes``: project_id, path, key, sign, at: which contents came (1) and went
  (-1), and when (0: the same content came again, later);
* ``sums``: project_id and what the version added to its signals;
* ``line_sums``: project_id, digest, n: the same of its prompt lines;
* ``done``: written last.  What a version left behind that was not done is
  overwritten by the next attempt, so a repeated update changes nothing.

Sums, repeated lines, dependency files and findings are read from these small
tables; text is only read, in place, to hash what arrives and to match new
contents, which are told by a filter of bounded size and then exactly.  An
update's cost follows what arrives: of the changes before, only those of its
files are summed up.

A content may belong to a third of all files.  Its files are summed up by
project first, and contents that belong to more than a thousandth of the rows
(so a thousand at most) are broadcast instead of joined by key.

Files may come with the time they ``arrived``.  Of several rows of a file the
last counts, by arrival and then by the hash of the content, in whatever order
and in however many updates they come; what was deleted is forgotten with its
time.  Files are named by project_id and path; rows without either are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.functions import text as tx
from folioscan.operators import classify as cl, findings as fd, scores as sc, signals as sg
from folioscan.plans.config import AuditConfig
from folioscan.rules import catalog as cat

FILE = ["project_id", "path"]
TABLES = ("contents", "changes", "sums", "line_sums", "done")
HOT_SHARE = 1000
BITMAP = 1 << 15  # bits of what bitmap_construct_agg makes
FILTER_BITS = 1 << 27  # most bits of a filter

# What the rules ask of a path beside its text.
TRAITS = (
    "ext", "endswith(path, '.py')", "endswith(path, '.json')", "path = 'README.md'", "lower(name) = 'readme.md'", "name = '.gitignore'",
    tx.contains_any("lower(path)", cat.MCP_PATH_WORDS), tx.contains_any("lower(path)", cat.RAG_PATH_WORDS), tx.contains("lower(path)", "tool"),
    tx.contains_any("lower(path)", cat.AGENT_PATH_WORDS), tx.is_in("name", cat.DEPENDENCY_FILES), "contains(lower(path), 'test')",
    "contains(lower(path), 'change')", tx.is_in("path", cat.VERSION_FILES))
IS_DEPENDENCY = tx.is_in(tx.file_name("path"), cat.DEPENDENCY_FILES)


def content_keys(files: DataFrame) -> DataFrame:
    """(project_id, path, key, at): equal keys have equal signals; ``at`` orders
    the versions of a file."""
    named = files.selectExpr(*FILE, "content", f"{tx.file_name('path')} AS name", f"{tx.suffix('path')} AS ext", f"{_at(files)} AS at")
    traits = ", ".join(f"CAST({t} AS STRING)" for t in TRAITS)
    return named.selectExpr(*FILE, f"unhex(substring(sha2(concat_ws('|', {traits}, at.sha), 256), 1, 32)) AS key", "at")


def _at(files: DataFrame) -> str:
    arrived = "CAST(arrived AS TIMESTAMP)" if "arrived" in files.columns else "CAST(NULL AS TIMESTAMP)"
    return f"named_struct('arrived', {arrived}, 'sha', coalesce(sha2(content, 256), 'unreadable'))"


def by_key(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """``rows`` joined with ``contents`` on ``key``, hot keys by a broadcast of
    at most ``HOT_SHARE`` contents."""
    total = rows.count()
    hot = rows.groupBy("key").count().where(F.col("count") * HOT_SHARE > total).select("key")
    held = F.broadcast(contents.join(F.broadcast(hot), "key", "left_semi"))
    return rows.join(held, "key").unionByName(
        rows.join(F.broadcast(hot), "key", "left_anti").join(contents, "key"))


def maybe_in(rows: DataFrame, wanted: DataFrame, keys, found: str | None = None) -> DataFrame:
    """The ``rows`` whose ``keys`` are in the stored table ``wanted``, and a few
    others: a hash is looked up in bitmaps of at most ``FILTER_BITS`` bits, which
    every task gets, so that rows stay where they are.  With ``found``, all rows
    and a column of this name that tells them."""
    bitmaps = max(1, min(FILTER_BITS, 16 * wanted.count()) // BITMAP)
    at = F.pmod(F.xxhash64(*keys), F.lit(bitmaps * BITMAP))
    held = wanted.select(at.alias("_at")).groupBy(F.expr(f"_at div {BITMAP} AS _bitmap")).agg(
        F.bitmap_construct_agg(F.col("_at") % BITMAP).alias("_bits"))
    marked = rows.withColumn("_at", at).withColumn("_bitmap", F.expr(f"_at div {BITMAP}")).join(F.broadcast(held), "_bitmap", "left")
    byte = f"CAST(conv(hex(substring(_bits, CAST(_at % {BITMAP} div 8 + 1 AS INT), 1)), 16, 10) AS INT)"
    tested = marked.withColumn(found or "_found", F.expr(f"coalesce(shiftright({byte}, CAST(_at % 8 AS INT)) & 1, 0) = 1")).drop("_at", "_bitmap", "_bits")
    return tested if found else tested.where("_found").drop("_found")


class SignalStore:
    """The store at ``path``, for one configuration of rules."""

    def __init__(self, spark: SparkSession, path: str, cfg: AuditConfig | None = None):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg or AuditConfig()
        self.flags = sg.file_flags(self.cfg)
        self.counted = [n for n, (_, how) in self.flags.items() if how != "last"]
        self.lines = self.cfg.runs("prompt_token_efficiency")

    @classmethod
    def create(cls, spark: SparkSession, path: str, cfg: AuditConfig | None = None, project_id: str = "string") -> SignalStore:
        """An empty store; ``project_id``: the type of the projects' ids."""
        store = cls(spark, path, cfg)
        nothing = spark.createDataFrame([], f"project_id {project_id}, path string, content string")
        contents = store._matched(cl.classify(nothing).withColumn("key", F.lit(b"")))
        tables = {
            "contents": contents, "changes": content_keys(nothing).withColumn("sign", F.lit(1)),
            "sums": nothing.selectExpr("project_id", *[f"0L AS {n}" for n in store.counted]),
            "line_sums": nothing.selectExpr("project_id", "CAST(NULL AS BINARY) AS digest", "0L AS n"),
            "done": spark.createDataFrame([(store.cfg.digest(),)], "config string")}
        for name, rows in tables.items():
            store._write(name, 0, rows)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, cfg: AuditConfig | None = None) -> SignalStore:
        store = cls(spark, path, cfg)
        made = spark.read.parquet(f"{store.path}/done").where("version = 0").first()["config"]
        if made != store.cfg.digest():
            raise ValueError("the store was made with another configuration")
        return store

    def _write(self, name: str, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def version(self) -> int:
        return self.spark.read.parquet(f"{self.path}/done").agg(F.max("version")).first()[0]

    def table(self, name: str, below: int | None = None) -> DataFrame:
        """A table up to what is done, or the versions below one."""
        below = self.version() + 1 if below is None else below
        schema = self.spark.read.parquet(f"{self.path}/{name}/version=0").schema
        rows = self.spark.read.schema(schema.add("version", "integer")).parquet(f"{self.path}/{name}")
        return rows.where(F.col("version") < below).drop("version")

    def _matched(self, classified: DataFrame, names=("key",)) -> DataFrame:
        """The row of each content, with the columns ``names`` of ``classified``,
        which holds a file for each key."""
        def number(name: str) -> str:
            expr, how = self.flags[name]
            return f"CAST({expr} AS BIGINT) AS {name}"

        # The place of a dependency file is not the content's: its name comes from the changes.
        dependency = f"{self.flags['dependency'][0]} AS dependency"
        digests = f"transform(filter(transform({tx.split_lines_loosely('text')}, l -> {tx.strip('l')}), l -> l <> ''), l -> unhex(substring(sha2(l, 256), 1, 32)))"
        lines = f"CASE WHEN {sg.IN_PROMPT} AND {'true' if self.lines else 'false'} THEN {digests} END AS lines"
        rows = sg.readable(classified).selectExpr(*names, *[number(n) for n in self.counted], dependency, f"{fd.hits_column(self.cfg)} AS hits", lines)
        return rows.withMetadata("hits", {"rules": sorted(fd.matched_rules(self.cfg))})

    def update(self, files: DataFrame, deleted: DataFrame | None = None, version: int | None = None) -> int:
        """Takes in ``files(project_id, path, content)``, new or changed, with
        ``arrived`` or without, and forgets ``deleted(project_id, path)``.  Gives
        the version; one that was done before is not done again."""
        version = self.version() + 1 if version is None else version
        if version <= self.version():
            return version
        files = files.withColumn("path", F.expr("CASE WHEN project_id IS NULL OR path IS NULL THEN raise_error('a file without project or path') ELSE path END"))
        last = content_keys(files).groupBy(*FILE).agg(F.max(F.struct("at", "key")).alias("last")).select(*FILE, "last.*")
        self._write("arrived", version, last)
        arrived = self.spark.read.parquet(f"{self.path}/arrived/version={version}")
        known = self.table("contents", version)

        new = arrived.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct(*FILE, "at")).alias("file"))
        self._write("new", version, new.select("key", "file.project_id", "file.path", F.col("file.at.sha").alias("sha")))
        new = self.spark.read.parquet(f"{self.path}/new/version={version}")
        place = [*FILE, "sha"]  # of a key
        # Texts are matched where they are read; what came of them is moved.
        texts = maybe_in(files.selectExpr(*FILE, "content", f"{_at(files)}.sha AS sha"), new, place)
        matched = self._matched(cl.classify(texts), place).join(new, place)
        # The same content of a file may be delivered twice.
        self._write("contents", version, matched.dropDuplicates(place).select("key", *[c for c in matched.columns if c not in (*place, "key")]))

        gone = arrived.limit(0).select(*FILE) if deleted is None else deleted.select(*FILE).distinct()
        before = self._current(self.table("changes", version).join(arrived.select(*FILE).unionByName(gone).distinct(), FILE, "left_semi"))
        both = arrived.join(before.select(*FILE, F.col("key").alias("old"), F.col("at").alias("since")), FILE, "left").where(
            "since IS NULL OR since.arrived IS NULL OR at.arrived IS NULL OR since < at")
        came = both.selectExpr(*FILE, "key", "at", "CASE WHEN old <=> key THEN 0 ELSE 1 END AS sign").where("sign = 1 OR at.arrived IS NOT NULL")
        went = both.where("old <> key").selectExpr(*FILE, "old AS key", "since AS at", "-1 AS sign").unionByName(
            before.join(gone, FILE, "left_semi").join(arrived.select(*FILE), FILE, "left_anti").withColumn("sign", F.lit(-1)))
        self._write("changes", version, came.unionByName(went))

        changes = self.spark.read.parquet(f"{self.path}/changes/version={version}")
        contents = self.table("contents", version + 1)
        moved = changes.groupBy("project_id", "key").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        sums = by_key(moved, contents.select("key", *self.counted)).groupBy("project_id").agg(
            *[F.expr(f"sum(sign * {n}) AS {n}") for n in self.counted])
        self._write("sums", version, sums)
        lines = by_key(moved, contents.where("lines IS NOT NULL").select("key", "lines")).selectExpr("project_id", "sign", "explode(lines) AS digest")
        self._write("line_sums", version, lines.groupBy("project_id", "digest").agg(F.sum("sign").alias("n")).where("n <> 0"))
        self._write("done", version, self.spark.createDataFrame([(self.cfg.digest(),)], "config string"))
        return version

    @staticmethod
    def _current(changes: DataFrame) -> DataFrame:
        return changes.groupBy(*FILE, "key").agg(F.sum("sign").alias("sign"), F.max("at").alias("at")).where("sign > 0").drop("sign")

    def files(self) -> DataFrame:
        """(project_id, path, key, at) of the files as they are."""
        return self._current(self.table("changes"))

    def project_signals(self) -> DataFrame:
        """What :func:`signals.project_signals` gives for the files as they are."""
        how = {"sum": "sum({0})", "any": "sum({0}) > 0"}
        sums = self.table("sums").groupBy("project_id").agg(
            *[F.expr(f"{how[self.flags[n][1]].format(n)} AS {n}") for n in self.counted]).where("n_files > 0")
        # Only changes of files with such names are summed up.
        special = self._current(self.table("changes").where(IS_DEPENDENCY))
        said = by_key(special.select(*FILE, "key"), self.table("contents").select("key", "dependency")).selectExpr(
            "project_id", "path", "named_struct('path', path, 'readable', dependency.readable, " + ", ".join(
                f"'dep_{p}', dependency.dep_{p}" for p in cl.PACKAGES) + ") AS dependency")
        last = said.groupBy("project_id").agg(F.max_by("dependency", "path").alias("dependency"))
        out = sums.join(last, "project_id", "left")
        if self.lines:
            lines = self.table("line_sums").groupBy("project_id", "digest").agg(F.sum("n").alias("n")).where("n > 0")
            out = out.join(lines.groupBy("project_id").agg(F.sum("n").alias("n_lines"), F.expr("sum(n) - count(1) AS n_duplicates")), "project_id", "left")
        return out.selectExpr("*", *cl.DEPENDENCY, f"{cl.SKILL_TYPE} AS skill_type").drop("dependency")

    def audits(self) -> DataFrame:
        return sc.audits(sc.score_table(self.project_signals(), self.cfg), self.cfg)

    def findings(self, rules=None) -> DataFrame:
        files = self.files()
        hits = by_key(files.select(*FILE, "key"), self.table("contents").select("key", "hits")).select(*FILE, "hits")
        hits = hits.withMetadata("hits", {"rules": sorted(fd.matched_rules(self.cfg))})
        return fd.findings(files, self.cfg, rules, project_signals=self.project_signals(), hits=hits)

    def compact(self, path: str) -> SignalStore:
        """The store as it is, in one version, at another place: contents that no
        file holds any more are left out."""
        rows = {"changes": self.files().withColumn("sign", F.lit(1))}
        rows["contents"] = self.table("contents").join(rows["changes"].select("key").distinct(), "key", "left_semi")
        rows["sums"] = self.table("sums").groupBy("project_id").agg(*[F.sum(n).alias(n) for n in self.counted]).where("n_files > 0")
        rows["line_sums"] = self.table("line_sums").groupBy("project_id", "digest").agg(F.sum("n").alias("n")).where("n > 0")
        rows["done"] = self.table("done", 1)
        for name in TABLES:
            rows[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/version=0")
        return SignalStore(self.spark, path, self.cfg)
