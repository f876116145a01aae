"""A sink of named text files: one file for each name, whole or not at all, with stale files taken away.

Spark's own text sink names its files itself.  Here each task streams the files of its rows into a staging folder, and
the commit moves those of the attempts that counted; an aborted job leaves the target as it was.  Paths are those of
pyarrow.fs (a local or mounted path, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "glossa_files"
STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: tuple[str, ...]
    empty: tuple[str, ...]


def opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Files(DataSource):
    """Options: path; rows: file (a relative name), value (a line, or null for a name without lines)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"].rstrip("/"), overwrite)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, base = opened(self.path)
        folder, files, empty, name, out = f"{base}/{STAGING}-{self.job}/{uuid.uuid4().hex}", [], [], None, None
        try:
            for file, value in rows:
                if file != name:
                    if out is not None:
                        out.close()
                    name, out = file, None
                if value is None:
                    if out is None:
                        empty.append(file)
                    continue
                if out is None:
                    target = f"{folder}/{file}"
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(target)
                    files.append(file)
                out.write(value.encode("utf-8", "replace") + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(folder, tuple(files), tuple(set(empty) - set(files)))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = opened(self.path)
        done = [m for m in messages if m is not None]
        kept, made = {f for m in done for f in m.files}, set()
        for m in done:
            for file in m.files:
                target = f"{base}/{file}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                system.move(f"{m.folder}/{file}", target)
        stale = {f for m in done for f in m.empty} - kept
        if self.overwrite:
            found = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
            stale |= {i.path.removeprefix(f"{base}/") for i in found if i.type == fs.FileType.File and not i.path.removeprefix(f"{base}/").startswith(STAGING)} - kept
        for file in stale:
            if system.get_file_info(f"{base}/{file}").type == fs.FileType.File:
                system.delete_file(f"{base}/{file}")
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        staging = f"{base}/{STAGING}-{self.job}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)


def write(rows: DataFrame, path: str, order: list[str], overwrite: bool = True) -> None:
    """Writes rows(file, value, *order) as files, each with its lines in order.

    overwrite=True leaves only the files of these rows in the folder; else others stay, but for names whose only value is
    null, which are taken away.  A file is written by one task, as a stream.
    """
    register(rows.sparkSession)
    dealt = rows.repartition("file").sortWithinPartitions("file", F.col("value").isNull(), *order).select("file", "value")
    dealt.write.format(NAME).mode("overwrite" if overwrite else "append").option("path", path).save()
