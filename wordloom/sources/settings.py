"""Files of sections with ``key=value`` lines, as a Spark data source.

``spark.read.format("settings").load(folder)`` after ``register(spark)``: a
row (``file, line, section, key, value``) for each pair.  Every file is a
partition of its own; the folder may be on any store that Arrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def pairs(lines) -> Iterator[tuple[int, str, str, str]]:
    """(line from 1, section, key, value).  ``//`` starts a comment anywhere;
    blanks around sections, keys and values go; other lines are skipped."""
    section = ""
    for n, line in enumerate(lines, 1):
        text = line.partition("//")[0].strip()
        if text.startswith("["):
            section = text[1:].partition("]")[0].strip()
        elif "=" in text:
            key, _, value = text.partition("=")
            yield n, section, key.strip(), value.strip()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _store(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, inside = self._store(self.path)
        if store.get_file_info(inside).type == fs.FileType.File:
            return [_File(self.path)]
        found = store.get_file_info(fs.FileSelector(inside, recursive=True))
        head = self.path.rstrip("/")[: -len(inside.rstrip("/"))] if self.path.rstrip("/").endswith(inside.rstrip("/")) else ""
        return [_File(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, inside = self._store(partition.path)
        with store.open_input_stream(inside) as stream:
            text = stream.read().decode("utf-8", "replace")
        for n, section, key, value in pairs(text.splitlines()):
            yield partition.path.rsplit("/", 1)[-1], n, section, key, value


class Settings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "settings"

    def schema(self) -> str:
        return "file string, line int, section string, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Settings)
