"""Folders of stored resources (pages, property files) as a data source that reads, streams and writes them.

    spark.dataSource.register(StoredFiles)
    spark.read.format("stored_files").option("suffix", ".properties").load(path)
    files.write.format("stored_files").mode("append").save(path)

Reading lists a folder and deals its files to partitions by size, so that neither one
partition has all the large files nor a million small ones make a million tasks.  A file
over the limit gives a row with an error and is never opened; one that cannot be read
gives a row with an error too.  As a stream it reads files in the order of their times.

Writing makes one file of each row.  Tasks write into a folder of their own under
``_staging``; only when all have succeeded are the files moved to their places, each of
them in one step.  What a failed or repeated attempt of a task has written is thus never seen.

Paths are local or URIs of the stores that Arrow knows; workers need to reach them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..config import COMPATIBLE

SCHEMA = "path string, filename string, length long, modified timestamp, content string, error string"
PARTITION_BYTES = 64 << 20
#: Beside its bytes a file counts as so many, as opening it takes time.
OPEN_BYTES = 64 << 10
STAGING = "_staging"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    #: (path, bytes, time of the last change in microseconds)
    files: list[tuple[str, int, int]]


def listed(options: dict) -> list[tuple[str, int, int]]:
    """The files of a folder that are wanted, hidden and staged ones left out."""
    system, root = opened(options["path"])
    suffix = options.get("suffix", "").lower()
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        inside = info.path[len(root.rstrip("/")) + 1 :].split("/")
        if info.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in inside) and info.path.lower().endswith(suffix):
            found.append((info.path, info.size, (info.mtime_ns or 0) // 1000))
    return found


def dealt(files: list[tuple[str, int, int]], options: dict) -> list[Files]:
    """Files dealt to partitions of about ``partitionBytes``; those over the limit count as they are not read."""
    most, room = limit(options), int(options.get("partitionBytes", PARTITION_BYTES))
    parts: list[Files] = []
    held: list[tuple[str, int, int]] = []
    size = 0
    for file in sorted(files):
        weight = OPEN_BYTES + (file[1] if file[1] <= most else 0)
        if held and size + weight > room:
            parts.append(Files(held))
            held, size = [], 0
        held.append(file)
        size += weight
    return [*parts, Files(held)] if held else parts


def limit(options: dict) -> int:
    return int(options.get("maxFileBytes", COMPATIBLE.max_file_bytes))


def rows(partition: Files, options: dict) -> Iterator[tuple]:
    """A row for each file, read one at a time."""
    import datetime

    system, _ = opened(options["path"])
    for path, size, changed in partition.files:
        content = error = None
        if size > limit(options):
            error = "File too large"
        else:
            try:
                with system.open_input_stream(path) as file:
                    content = file.read().decode("utf-8", errors="replace")
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
        yield path, path.rsplit("/", 1)[-1], size, datetime.datetime.fromtimestamp(changed / 1e6, datetime.UTC), content, error


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        return dealt(listed(self.options), self.options) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition, self.options)


class StreamReader(DataSourceStreamReader):
    """Files in the order of (time, path); an offset is the last one read."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((changed, path) for path, _, changed in listed(self.options)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        return dealt([f for f in listed(self.options) if after < (f[2], f[0]) <= upto], self.options)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition, self.options)


@dataclass
class Staged(WriterCommitMessage):
    #: (staged path, file name)
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        if not {"filename", "content"} <= set(names):
            raise ValueError("rows need columns filename and content")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        opened(self.path)[0].create_dir(self._staging(), recursive=True)

    def _staging(self) -> str:
        return f"{opened(self.path)[1].rstrip('/')}/{STAGING}/{self.job}"

    def write(self, iterator) -> Staged:
        system, _ = opened(self.path)
        own, staged = f"{self._staging()}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=False)  # not for a job that has been given up
        for k, row in enumerate(iterator):
            name = row.filename
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"not a name for a file: {name!r}")
            with system.open_output_stream(f"{own}/{k}") as out:
                out.write((row.content or "").encode("utf-8", errors="replace"))
            staged.append((f"{own}/{k}", name))
        return Staged(staged)

    def commit(self, messages) -> None:
        system, root = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            again = sorted({n for n in names if names.count(n) > 1})[:5] if len(names) < 10_000 else []
            self.abort(messages)
            raise ValueError(f"several rows have one file name {again}")
        if self.overwrite:
            old = [info.path for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if info.type == fs.FileType.File]
            gone = set(old) - {f"{root.rstrip('/')}/{n}" for n in names}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: system.move(f[0], f"{root.rstrip('/')}/{f[1]}"), files))
            if self.overwrite:
                list(pool.map(system.delete_file, gone))
        self._clean(system)

    def abort(self, messages) -> None:
        self._clean(opened(self.path)[0])

    def _clean(self, system) -> None:
        if system.get_file_info(self._staging()).type == fs.FileType.Directory:
            system.delete_dir(self._staging())
        above = self._staging().rsplit("/", 1)[0]
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


class StoredFiles(DataSource):
    """Options: ``path``; for reading ``suffix``, ``maxFileBytes``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "stored_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema.names, overwrite)


def stored_pages(files: DataFrame) -> DataFrame:
    """(page_id, url, html) of files that hold pages, named by their paths; files with errors have no html."""
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.col("content").alias("html"))


def write_localized(done: DataFrame, path: str, mode: str = "append") -> None:
    """Localized resource files (download_name, content), each under its own name; rows without content have no file."""
    name = F.regexp_replace("download_name", r"/|^[._]+", "_")
    name = F.when(name.startswith("_"), F.concat(F.lit("file"), name)).otherwise(name)
    files = done.where("content is not null").select(name.alias("filename"), "content")
    done.sparkSession.dataSource.register(StoredFiles)
    files.write.format("stored_files").mode(mode).save(path)
