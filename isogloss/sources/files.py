"""A Spark data source that writes files of given bytes in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: the folder of its attempt and the paths below it."""

    attempt: str
    paths: list[str]


class FileWriter(DataSourceWriter):
    """A task writes below a folder of its own attempt; commit moves what successful attempts have written to its place,
    and abort, like commit at its end, deletes all attempts' folders, those of lost executors included. What a task that is
    only being stopped still writes stays in its own temporary folder, never in place."""

    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = fs.FileSystem.from_uri(self.folder)
        attempt = f"{base}/{self.job}/{uuid.uuid4().hex}"
        paths = []
        for row in iterator:
            if ".." in row["path"].split("/"):
                raise ValueError(f"{row['path']} is not below the folder")
            target = f"{attempt}/{row['path']}"
            store.create_dir(target.rpartition("/")[0], recursive=True)
            with store.open_output_stream(target) as out:
                out.write(bytes(row["content"]))
            paths.append(row["path"])
        return Written(attempt, paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.folder)
        made = set()
        for message in messages:
            for path in message.paths if message else []:
                parent = f"{base}/{path}".rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                store.move(f"{message.attempt}/{path}", f"{base}/{path}")
        self._tidy()

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy()

    def _tidy(self) -> None:
        store, base = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


class FileSink(DataSource):
    """`content` of each row becomes the file `path` below the folder."""

    @classmethod
    def name(cls) -> str:
        return "isogloss_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(made: DataFrame, folder: str) -> None:
    """The files of a table of path and content, below a folder that driver and tasks share (a path or a URI of any store
    that pyarrow knows). Files of the same paths are replaced; nothing but paths reaches the driver. Paths must differ."""
    made.sparkSession.dataSource.register(FileSink)
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    made.select("path", "content").write.format(FileSink.name()).mode("append").save(folder)
