"""Cleaned copies as files in a folder: a data source to write to, with Spark's commit protocol."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging"


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class FolderWriter(DataSourceWriter):
    """Tasks write under names of their own in a staging folder; only when all are done, the driver moves the files to theirs.

    So a lost or repeated task leaves nothing but staged files, which go with the job, whether it succeeds or not.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return system, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, root = self._folder()
        own, files = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for k, row in enumerate(iterator):
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/") or name.split("/")[0] == STAGING:
                raise ValueError(f"{name!r} is no name of a file in the folder")
            with system.open_output_stream(f"{own}/{k}") as out:
                out.write(bytes(row["content"] or b""))
            files.append((f"{own}/{k}", name))
        return Staged(files)

    def _clear(self) -> None:
        system, root = self._folder()
        if system.get_file_info(f"{root}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{STAGING}/{self.job}")
        if system.get_file_info(f"{root}/{STAGING}").type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            system.delete_dir(f"{root}/{STAGING}")

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._folder()
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self._clear()
            raise ValueError("two copies have one name")
        there = [n for n in names if not self.overwrite and system.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]
        if there:
            self._clear()
            raise ValueError(f"{there[0]} is there already")
        for staged, name in files:
            system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            system.move(staged, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()


class FolderSource(DataSource):
    """df.write.format("files").mode("append").save(folder): rows (name, content) become files; with mode overwrite, in place of those of their names."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        missing = {"name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"a file needs {', '.join(sorted(missing))}")
        return FolderWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
