"""Where the files table comes from."""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.functions import text as tx
from folioscan.operators import classify as cl
from folioscan.rules import catalog as cat
from folioscan.session import shared_dir

ROOT_PROJECT = "."


def files_from_table(df: DataFrame, project: str, path: str, text: str, partitions: int | None = None) -> DataFrame:
    """Any table with a text as files(project_id, path, content); the arguments
    are SQL expressions.

    Texts stay in the splits they are read in.  ``partitions`` deals the rows
    out anew, for a table of a few big row groups."""
    files = df.selectExpr(f"{project} AS project_id", f"{path} AS path", f"CAST({text} AS STRING) AS content")
    # By key: a round-robin spread would sort the rows first.
    return files.repartition(partitions, "project_id", "path") if partitions else files


def read_project_tree(spark: SparkSession, root: str, partitions: int | None = None, project: str | None = None) -> DataFrame:
    """Every file below ``root``.  The first folder is the project, files beside
    the projects belong to ``ROOT_PROJECT``; or all are files of ``project``.

    Spark's own readers leave out names that begin with ``.`` or ``_``, and with
    them ``.gitignore`` and ``__init__.py``; so tasks list the folders through
    pyarrow's file systems (local, HDFS, object stores).  The tree is listed at
    once, level by level: the folders of a level are spread over ``partitions``
    tasks, whose entries are written to the shared folder; the driver sees their
    number only.  Reading is lazy and spread by path.  Bytecode caches and
    version-control folders are left out.  A file that cannot be read has a NULL
    content.  Store the result as a table before auditing it.
    """
    n = partitions or 8 * spark.sparkContext.defaultParallelism
    listing = "path string, is_dir boolean"

    def enter(batches):
        fs, top = _file_system(root)
        for batch in batches:
            for folder in batch["path"]:
                yield from _batches(_list(fs, top, folder), listing)

    def read(batches):
        fs, top = _file_system(root)
        for batch in batches:
            for path in batch["path"]:
                try:
                    with fs.open_input_stream(f"{top}/{path}") as stream:
                        data = stream.read()
                except OSError:
                    data = None
                yield pd.DataFrame({"path": [path], "content": [data]})

    level = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        out = shared_dir(spark, "listing")
        level.repartition(n, "path").mapInPandas(enter, listing).write.parquet(out)
        entries = spark.read.schema(listing).parquet(out)
        levels.append(entries.where("NOT is_dir").select("path"))
        level = entries.where("is_dir").select("path")
        if not level.limit(1).count():
            break
    files = levels[0]
    for more in levels[1:]:
        files = files.unionByName(more)
    raw = files.repartition(n, "path").mapInPandas(read, "path string, content binary")
    content = f"{tx.decode_utf8('content')} AS content"
    if project is not None:
        return raw.selectExpr(f"{tx.q(project)} AS project_id", "path", content)
    return raw.selectExpr(
        f"CASE WHEN contains(path, '/') THEN substring_index(path, '/', 1) ELSE '{ROOT_PROJECT}' END AS project_id",
        "CASE WHEN contains(path, '/') THEN substring(path, instr(path, '/') + 1) ELSE path END AS path", content)


def _file_system(root: str):
    fs, path = pa_fs.FileSystem.from_uri(root)
    return fs, path.rstrip("/")


def _list(fs, top: str, folder: str):
    """(path, is_dir) of the entries of one folder."""
    for info in fs.get_file_info(pa_fs.FileSelector(f"{top}/{folder}".rstrip("/"), recursive=False)):
        if info.is_file or info.base_name not in cat.SKIPPED_DIRS:
            yield f"{folder}/{info.base_name}".lstrip("/"), not info.is_file


def _batches(rows, ddl: str, size: int = 10_000):
    names = [field.split()[0] for field in ddl.split(", ")]
    rows = iter(rows)
    while chunk := list(islice(rows, size)):
        yield pd.DataFrame(chunk, columns=names)


def read_single_file(spark: SparkSession, path: str) -> DataFrame:
    """One file (or several by a pattern), each a project, classified; see
    :func:`classify.single_files`."""
    raw = spark.read.format("binaryFile").load(path)
    return cl.single_files(raw.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("project_id"), F.substring_index("path", "/", -1).alias("path"),
        F.expr(tx.decode_utf8("content")).alias("content")))
