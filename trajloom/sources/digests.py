"""Digests of files of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import named_files, readers


def file_digests(spark: SparkSession, path: str, glob: str = "*", algorithm: str = "sha256", chunk: int = 8 << 20, files_per_task: int = 16) -> DataFrame:
    """path, length, digest (hexadecimal) of the files below a folder.

    Spark lists the files, without empty ones, which its readers leave out, and deals their names; a task reads each of its files in chunks, so one may be larger than memory and than 2 GB. The
    files are opened through Arrow, see named_files.opened().
    """
    hashlib.new(algorithm)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                fs, inner = named_files.opened(name)
                sha = hashlib.new(algorithm)
                with fs.open_input_stream(inner, compression=None) as f:
                    while data := f.read(chunk):
                        sha.update(data)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "length", "digest"])

    files = readers.files_under(spark, path, glob).select("path", "length")
    tasks = max(1, -(-files.count() // files_per_task))
    return files.repartition(tasks).mapInArrow(digest, "path string, length long, digest string")
