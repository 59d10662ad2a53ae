"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.session import shared_dir


ROOT = Path(__file__).resolve().parents[2]
ROW = "_stored_row"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package.  They do if it was shipped with
    the job, is on PYTHONPATH or lies in the working folder; else Spark sends
    the executors an archive of it, once."""
    found = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    context = spark.sparkContext
    if ROOT in found or not (ROOT / "folioscan").is_dir() or any("folioscan" in f for f in context.listFiles):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "folioscan"), "zip", ROOT, "folioscan")
    context.addPyFile(archive)


def shipped(function: Callable) -> Callable:
    """A query or stage, whose first argument is the session, after :func:`ship`."""
    @wraps(function)
    def run(spark, *arguments):
        ship(spark)
        return function(spark, *arguments)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here,
    and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_name(df: DataFrame) -> str:
    """A name for a row's key that no column of ``df`` has."""
    name = ROW
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` stored, each row with a key that no other row has, named :func:`row_name`."""
    return stored(df.withColumn(row_name(df), F.monotonically_increasing_id()), purpose)


def crc_class(key: str, classes: int) -> Column:
    """crc32 of a key's text, modulo ``classes``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % classes


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``limit`` in sum, one item at least."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
