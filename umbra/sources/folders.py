"""Folders of files, kept as they are: a Spark data source whose rows are files.

Reading gives a row for each file, with its path relative to the folder and its bytes, or an error in their place: a file
that can't be read doesn't end the job. Writing puts each row's bytes at its relative path under another folder, so a
tree of files comes out as the same tree. Files are listed once and dealt to tasks by bytes; each task writes its own
files, and writing one again gives the same file, so a lost task leaves nothing wrong behind.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from umbra.operators.anonymize import Operator
from umbra.operators.process import process

#: Bytes of files that one task reads, about.
SHARE = 64 << 20
SCHEMA = "path string, content binary, error string"


def _opened(folder: str):
    """The file system that holds a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.deep, self.share = options.get("recursive", "true").lower() == "true", int(options.get("share", SHARE))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, top = _opened(self.folder)
        files = [x for x in system.get_file_info(fs.FileSelector(top, recursive=self.deep)) if x.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(x.path), self.pattern)]
        out, held = [_Files([])], 0
        for x in sorted(files, key=lambda x: x.path):
            if out[-1].paths and held + (x.size or 0) > self.share:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append(posixpath.relpath(x.path, top))
            held += x.size or 0
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, top = _opened(self.folder)
        for path in partition.paths:
            try:
                with system.open_input_stream(posixpath.join(top, path)) as f:
                    row = (path, f.read(), None)
            except OSError as e:
                row = (path, None, f"{type(e).__name__}: {e}")
            yield row


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, rows: Iterator[Row]) -> _Written:
        system, top = _opened(self.folder)
        n = 0
        for r in rows:
            at = posixpath.normpath(r["path"])
            if at.startswith(("/", "..")):
                raise ValueError(f"not a path inside the folder: {r['path']}")
            if r["content"] is None:
                continue
            to = posixpath.join(top, at)
            system.create_dir(posixpath.dirname(to), recursive=True)
            with system.open_output_stream(to) as f:
                f.write(bytes(r["content"]))
            n += 1
        return _Written(n)


class Folder(DataSource):
    """Format "umbra_folder": options path, pattern (of file names), recursive (true), share (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "umbra_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content, error) of every file: content is null where a file can't be read, and error says why."""
    spark.dataSource.register(Folder)
    return spark.read.format("umbra_folder").option("path", folder).option("pattern", pattern).option("recursive", str(recursive)).load()


def write_folder(files: DataFrame, folder: str) -> None:
    """Writes (path, content) rows as files under a folder; rows without content are left out. Of rows that share a path one is written."""
    files.sparkSession.dataSource.register(Folder)
    files.select("path", F.col("content").cast("binary").alias("content"), F.lit(None).cast("string").alias("error")).write.format("umbra_folder").mode("append").option("path", folder).save()


def process_folder(spark: SparkSession, source: str, target: str | None = None, pattern: str = "*", recursive: bool = True, operators: dict[str, Operator] | None = None, **options: Any) -> DataFrame:
    """process()'s columns for every text file of a folder tree, with path (relative), success and error.

    A file that can't be read or isn't UTF-8 gives a row with success false and an error; the others go on. With a target
    the rewritten texts are written to target/anonymized and the results as JSON to target/analysis, each at its file's
    relative path (with .json after it there). An empty folder gives no rows; an empty file is an empty text."""
    files = read_folder(spark, source, pattern, recursive)
    said = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.select("path", said.alias("text"), F.coalesce("error", F.when(F.col("content").isNotNull() & said.isNull(), F.lit("not UTF-8"))).alias("error"))
    fine = process(rows.where("error is null"), "path", "text", operators, **options).withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    if target:
        fine = fine.persist()
        write_folder(fine.select("path", F.col("anonymized").alias("content")), f"{target}/anonymized")
        said = F.to_json(F.struct("path", "entities", "anonymized", "segments", "structured_data", "entity_count", "type_counts"))
        write_folder(fine.select(F.concat("path", F.lit(".json")).alias("path"), said.alias("content")), f"{target}/analysis")
    lost = rows.where("error is not null").select("path", F.lit(False).alias("success"), "error")
    return fine.unionByName(lost, allowMissingColumns=True)
