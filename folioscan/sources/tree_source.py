"""Folder trees as a Spark data source: ``spark.read.format("project_tree")``.

    spark.dataSource.register(ProjectTree)
    spark.read.format("project_tree").load("hdfs:///projects").where("project_id = 'a' AND path LIKE '%.py'")
    reports.write.format("project_tree").mode("append").save("hdfs:///reports")

Reading gives files(project_id, path, content): the first folder is the project,
files beside the projects belong to ``ROOT_PROJECT``.  A project and each folder
right below it is a partition, listed and read by its own task, so one large
project is many tasks.  Conditions on ``project_id`` leave out folders before
they are listed, conditions on the ending or the beginning of ``path`` leave out
files before they are read (``spark.sql.python.filterPushdown.enabled``).
Content is text; a file that cannot be read, or is no UTF-8, has none.

Writing takes the same columns, a file for each row.  Tasks write below a hidden
folder; only when all of them are done are their files moved to their places.  A
task that fails leaves nothing there, nor does a job.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pa_fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

from folioscan.rules import catalog as cat
from folioscan.sources.files import ROOT_PROJECT, _file_system

SCHEMA = "project_id string, path string, content string"
STAGING = ".writing-"


@dataclass
class Folder(InputPartition):
    """A folder below a project, with all below it, or (``deep`` is false) the files right in it."""

    project: str
    folder: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.projects: set[str] | None = None  # None: all
        self.starts: list[str] = []
        self.ends: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can tell from names; Spark sees to the rest."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("project_id",) and isinstance(f, (EqualTo, In)):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.projects = named if self.projects is None else self.projects & named
            elif column == ("path",) and isinstance(f, StringEndsWith):
                self.ends.append(f.value)
            elif column == ("path",) and isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif not isinstance(f, IsNotNull) or column not in (("project_id",), ("path",)):
                yield f

    def partitions(self) -> list[Folder]:
        fs, top = _file_system(self.root)
        found = fs.get_file_info(pa_fs.FileSelector(top, allow_not_found=True))
        wanted = [x.base_name for x in found if not x.is_file and self._wants(x.base_name)]
        out = [Folder(ROOT_PROJECT, "", False)] if any(x.is_file for x in found) and (self.projects is None or ROOT_PROJECT in self.projects) else []
        for project in wanted:
            out.append(Folder(project, "", False))
            for x in fs.get_file_info(pa_fs.FileSelector(f"{top}/{project}")):
                if not x.is_file and x.base_name not in cat.SKIPPED_DIRS and self._may_start(f"{x.base_name}/"):
                    out.append(Folder(project, x.base_name, True))
        return out

    def _wants(self, project: str) -> bool:
        if project in cat.SKIPPED_DIRS or project.startswith(STAGING):
            return False
        return self.projects is None or project in self.projects

    def _may_start(self, folder: str) -> bool:
        return all(folder.startswith(s) or s.startswith(folder) for s in self.starts)

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, top = _file_system(self.root)
        base = top if partition.project == ROOT_PROJECT and not partition.deep and not partition.folder else f"{top}/{partition.project}"
        waiting = [partition.folder]
        while waiting:
            folder = waiting.pop()
            for info in fs.get_file_info(pa_fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                path = f"{folder}/{info.base_name}".lstrip("/")
                if not info.is_file:
                    if partition.deep and info.base_name not in cat.SKIPPED_DIRS and self._may_start(f"{path}/"):
                        waiting.append(path)
                elif all(path.startswith(s) for s in self.starts) and all(path.endswith(e) for e in self.ends):
                    try:
                        with fs.open_input_stream(f"{base}/{path}") as stream:
                            content = stream.read().decode()
                    except (OSError, UnicodeDecodeError):
                        content = None
                    yield partition.project, path, content


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, top = _file_system(self.root)
        # Each attempt of a task has a folder of its own; only that of the one that counts is moved.
        own, names = f"{self.staging}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = f"{own}/{row['project_id']}/{row['path']}"
            if ".." in name.split("/"):
                raise ValueError(f"{row['path']} lies outside of its project")
            fs.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{top}/{name}") as stream:
                stream.write((row["content"] or "").encode())
            names.append(name)
        return Written(names)

    def commit(self, messages) -> None:
        fs, top = _file_system(self.root)
        if self.overwrite:
            for info in fs.get_file_info(pa_fs.FileSelector(top, allow_not_found=True)):
                if info.base_name != self.staging:
                    (fs.delete_file if info.is_file else fs.delete_dir)(info.path)
        for name in (n for m in messages if m is not None for n in m.names):
            place = f"{top}/{name.split('/', 2)[2]}"
            fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
            fs.move(f"{top}/{name}", place)
        self._clear(fs, top)

    def abort(self, messages) -> None:
        self._clear(*_file_system(self.root))

    def _clear(self, fs, top: str) -> None:
        if fs.get_file_info(f"{top}/{self.staging}").type != pa_fs.FileType.NotFound:
            fs.delete_dir(f"{top}/{self.staging}")


class ProjectTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(_rooted(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(_rooted(self.options["path"]), overwrite)


def _rooted(path: str) -> str:
    return path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
