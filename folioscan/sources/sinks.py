"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioscan.sources.tree_source import ProjectTree


def write_findings(found: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Findings partitioned by dimension, so a reader of one dimension skips the rest."""
    found.write.format(fmt).mode(mode).partitionBy("dimension").save(path)


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    rows.write.format(fmt).mode(mode).save(path)


def write_tree(rows: DataFrame, root: str, project: str, path: str, content: str, mode: str = "append") -> None:
    """A file for each row, below ``root`` and its project (arguments are SQL
    expressions), in place only when all are written.  SARIF documents by project
    and dimension: ``write_tree(docs, root, "project_id", SARIF_PATH, "sarif")``."""
    rows.sparkSession.dataSource.register(ProjectTree)
    files = rows.selectExpr(f"CAST({project} AS STRING) AS project_id", f"{path} AS path", f"{content} AS content")
    files.write.format(ProjectTree.name()).mode(mode).save(root)


# Documents of one dimension lie in a folder, named by the file that they are about.
SARIF_PATH = "concat(dimension, '/', coalesce(path, 'project'), '.sarif')"


def write_documents(rows: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One JSON document per line."""
    rows.select(column).write.mode(mode).text(path)
