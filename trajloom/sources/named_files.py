"""Files whose names come from the data: tasks stage what they write, and, when all have, others move it into place."""

from __future__ import annotations

import gzip
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import shared

FORMAT = "named_files"
DONE = "_SUCCESS"
#: What follows an attempt's name in that of its list of files, and the list of the attempts that won.
LIST, WON = ".parquet", "won.parquet"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as the installed Arrow knows it, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        found, inner = pafs.FileSystem.from_uri(path)
        return found, inner.rstrip("/")
    return pafs.LocalFileSystem(), os.path.abspath(path)


class Opener:
    """opened() for one file after another: a file system is made once for those of one authority."""

    def __init__(self):
        self.root, self.found = None, None

    def opened(self, path: str) -> tuple[pafs.FileSystem, str]:
        if "://" not in path or path.startswith("file:"):
            return opened(path)
        root = "/".join(path.split("/", 3)[:3])
        if root != self.root:
            self.root, self.found = root, opened(root)
        return self.found[0], self.found[1] + path[len(root) :]


def proper(name: str | None) -> str:
    """A relative file name; one that is empty, absolute or leaves its folder is an error."""
    if not name or name.startswith(("/", "_")) or any(p in ("", ".", "..") for p in name.split("/")) or "\x00" in name:
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: the name of its attempt, and how many files."""

    attempt: str
    files: int


def packed(raw: pa.NativeFile, name: str):
    """The stream that compresses as the name's suffix says: .zst, .gz, else not at all. Equal rows give equal bytes."""
    if name.endswith(".zst"):
        import zstandard

        return zstandard.ZstdCompressor(level=3).stream_writer(raw, closefd=False)
    return gzip.GzipFile(filename="", fileobj=raw, mode="wb", mtime=0) if name.endswith(".gz") else None


class OneFile:
    """A file that is being written, compressed as its name says."""

    def __init__(self, fs: pafs.FileSystem, path: str, name: str):
        self.raw = fs.open_output_stream(path, compression=None)
        self.packer = packed(self.raw, name)

    def write(self, data: bytes) -> None:
        (self.packer or self.raw).write(data)

    def close(self) -> None:
        if self.packer is not None:
            self.packer.close()
        self.raw.close()


class NamedFilesWriter(DataSourceArrowWriter):
    """Rows name, value, sorted by name in each task, all rows of a name in one task.

    A task writes its files as 0, 1, 2, ... into its attempt's folder below the staging folder, and then the list of their names beside it.
    What is there already is not its matter, so either mode does the same.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.staging, self.lines = options["path"], options["staging"], options.get("lines", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = opened(self.path)
        task = TaskContext.get()
        attempt = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}"  # retries and speculative tasks don't meet
        folder = f"{root}/{self.staging}/{attempt}"
        now, names = None, []
        for batch in iterator:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not names or name != names[-1]:
                    if now:
                        now.close()
                    else:
                        fs.create_dir(folder, recursive=False)  # where the job has failed, the staging folder stays away
                    now = OneFile(fs, f"{folder}/{len(names)}", proper(name))
                    names.append(name)
                elif not self.lines:
                    raise ValueError(f"two records have the file name {name!r}")
                now.write(value.as_buffer() if value.is_valid else b"")
                if self.lines:
                    now.write(b"\n")
        if now:
            now.close()
            pq.write_table(pa.table({"name": names}), f"{folder}{LIST}", filesystem=fs)
        return Staged(attempt, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        """Mark the attempts that won; what others left goes with the staging folder."""
        fs, root = opened(self.path)
        won = [m.attempt for m in messages if m is not None and m.files]
        pq.write_table(pa.table({"attempt": pa.array(won, pa.string())}), f"{root}/{self.staging}/{WON}", filesystem=fs)

    def abort(self, messages: list[Staged | None]) -> None:
        """Nothing has been moved yet: what was there before stays."""
        clear(self.path, self.staging)


class NamedFiles(DataSource):
    """The staging half of write(): rows name, value as files below <path>/<staging>, which has the winning attempts' names in WON when the job is done.

    lines: rows are lines of their file, else a row is a whole file and a name that comes twice fails the job. Names that end in .zst or
    .gz are compressed.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options, overwrite)


def clear(path: str, staging: str) -> None:
    """Remove the staging folder. Tasks of a failed job that still write there may put a file into a folder that is being emptied: then again."""
    fs, root = opened(path)
    for left in range(50, -1, -1):
        try:
            fs.delete_dir(f"{root}/{staging}")
        except FileNotFoundError:
            if fs.get_file_info(f"{root}/{staging}").type == pafs.FileType.NotFound:
                return
        except OSError:
            if not left:
                raise
            time.sleep(0.1)
        else:
            return


def moved(path: str, staging: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of rows `attempt` that moves an attempt's files to their names, one rename each, and gives the names. A task that runs twice, or beside itself, finds what is moved in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        made = None
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                folder = f"{root}/{staging}/{attempt}"
                names = pq.read_table(f"{folder}{LIST}", filesystem=fs).column("name").combine_chunks()
                for i, name in enumerate(names.to_pylist()):
                    target = f"{root}/{name}"
                    parent = target.rpartition("/")[0]
                    if parent != made:
                        fs.create_dir(parent, recursive=True)
                        made = parent
                    try:
                        fs.move(f"{folder}/{i}", target)
                    except FileNotFoundError:
                        if fs.get_file_info(target).type != pafs.FileType.File:
                            raise
                for k in range(0, len(names), 10_000):
                    yield pa.RecordBatch.from_arrays([names[k : k + 10_000]], names=["name"])

    return run


def write(rows: DataFrame, path: str, overwrite: bool, **options: str) -> DataFrame:
    """One file for each name of the rows name, value, below `path`; the table of the names, from the shared folder. See sinks.files() and sinks.shards(), which sort rows as it needs them.

    Tasks write below _staging-*; only when all have succeeded, other tasks move the files, and the driver writes _SUCCESS: it sees a
    row for each task, none for a file. A job that fails while it writes leaves what was there before. overwrite empties the folder first; else equal names are replaced.
    """
    spark, staging = rows.sparkSession, f"_staging-{uuid.uuid4().hex}"
    spark.dataSource.register(NamedFiles)
    fs, root = opened(path)
    fs.create_dir(f"{root}/{staging}", recursive=True)
    try:
        rows.write.format(FORMAT).mode("append").options(path=path, staging=staging, **options).save()
        won = pq.read_table(f"{root}/{staging}/{WON}", filesystem=fs)
        with suppress(FileNotFoundError):
            fs.delete_file(f"{root}/{DONE}")
        if overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root)):
                if not x.base_name.startswith("_staging-"):
                    (fs.delete_dir if x.type == pafs.FileType.Directory else fs.delete_file)(x.path)
        attempts = spark.createDataFrame(won).repartition(max(1, min(len(won), 4 * spark.sparkContext.defaultParallelism)))
        names = shared.stored(attempts.mapInArrow(moved(path, staging), "name string"), "names")
    finally:
        clear(path, staging)
    with fs.open_output_stream(f"{root}/{DONE}") as done:
        done.write(b"")
    return names
