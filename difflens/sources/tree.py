"""Source trees as a data source: one partition a repository, and folders outside a review are never entered.

``spark.read.format("source_tree").load(root)`` gives (repo, path, content) of the files below ``root/<repository>/``. The
driver lists the repositories only; each is walked where it is read, folder by folder, and an excluded folder is pruned
when its name is seen, so neither its listing nor its files cost anything. Every file system that Arrow knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import values as V

SCHEMA = "repo string, path string, content binary"


class Repository(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


def wanted(name: str) -> bool:
    """Whether a full scan takes a file of this name; a name that is a suffix alone is hidden, not of that kind."""
    low = name.lower()
    kind = any(low.endswith(s) and len(name) > len(s) for s in V.REVIEWABLE_SUFFIXES)
    return kind and not name.endswith(tuple(V.SCAN_EXCLUDED_NAMES))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, excluded: tuple[str, ...]):
        self.root, self.excluded = root, frozenset(excluded)

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _children(self, system, folder: str):
        from pyarrow import fs

        return sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = self._system()
        return [Repository(f.base_name) for f in self._children(system, base) if f.type == fs.FileType.Directory]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = self._system()
        top = f"{base.rstrip('/')}/{partition.value}"
        folders = [top]
        while folders:
            for child in self._children(system, folders.pop()):
                if child.type == fs.FileType.Directory:
                    if child.base_name not in self.excluded:
                        folders.append(child.path)
                elif child.type == fs.FileType.File and wanted(child.base_name):
                    with system.open_input_stream(child.path) as file:
                        yield partition.value, child.path[len(top) + 1 :], file.read()


class SourceTree(DataSource):
    """Options: ``path``, and ``excluded``, folder names joined by commas (the usual ones by default)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        excluded = self.options.get("excluded")
        return TreeReader(self.options["path"], tuple(V.SCAN_EXCLUDED_FOLDERS if excluded is None else excluded.split(",")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
