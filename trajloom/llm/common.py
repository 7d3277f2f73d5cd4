"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; texts of one byte a character take the fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


#: Rows and bytes of an Arrow batch that goes to a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that a worker and its JVM hold a few MB of texts at a time, however long these are.

    A session that asks for smaller ones keeps them.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(name)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def slices(batches: Iterator[pa.RecordBatch] | Iterator[pa.Array], column: int = 0, rows: int = BATCH_ROWS, size: int = 1 << 20) -> Iterator[pa.RecordBatch] | Iterator[pa.Array]:
    """Short runs of the batches' rows, so that a Python worker holds few of them as objects at a time.

    A run has at most `rows` rows, and of the strings in `column` at most `size` bytes, or one row.
    """
    for batch in batches:
        texts = batch if isinstance(batch, pa.Array) else batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < len(batch):
            stop = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right"))
            stop = min(max(stop, k + 1), k + rows)
            yield batch.slice(k, stop - k)
            k = stop


def lean(scan: Callable) -> Callable:
    """The function of batches, after which the Python worker gives its free memory back: idle workers stay, and count as their executor's."""

    @functools.wraps(scan)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from scan(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: A row that stands for many equal ones is parted into rows for so many at most.
CHUNK = 1 << 16


def parted(df: DataFrame, count: str, first: str, size: int = CHUNK) -> DataFrame:
    """df's rows, each of which stands for `count` equal ones from number `first` on, parted into rows for at most `size`.

    Only the numbers of the parts are held as an array, one for every `size` rows. A count below 1 gives none.
    """
    numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {size}")))
    out = df.withColumn("__part", F.explode(numbers)).withColumn("__part", F.col("__part") * size)
    out = out.withColumn(count, F.least(F.lit(size).cast("long"), F.col(count) - F.col("__part")))
    return out.withColumn(first, F.col(first) + F.col("__part")).drop("__part")


def each_row(df: DataFrame, count: str, first: str, by: list[str]) -> DataFrame:
    """A row with its number `first` for each row that df's rows stand for, `count` from `first` on.

    The parts are dealt by the columns `by` and their numbers before they are unfolded, so a common
    row is no task's load; this shuffles df's rows once, not those they stand for.
    """
    dealt = parted(df, count, first).repartition(*by, first)
    return dealt.withColumn(first, F.explode(F.sequence(first, F.col(first) + F.col(count) - 1))).drop(count)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a folder of the warehouse or, on one machine, of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        local = sc.master.split("[")[0] == "local"
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trajloom-") if local else os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "trajloom-shared"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Tables:
    """Tables written in the shared folder to cut lineage; a lost executor costs no recomputation of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.made = spark, [], 0
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.made:03d}-{name}"
        self.made += 1
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        """Delete the tables of these names, which nothing lazy may read any more."""
        for p in [p for p in self.paths if p.rpartition("-")[2] in names]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.paths.remove(p)
