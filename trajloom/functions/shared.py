"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of the warehouse or, with all tasks in this process as in tests, of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        local = sc.master.split("[")[0] == "local"
        sc.setCheckpointDir(found or (tempfile.mkdtemp(prefix="trajloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/trajloom-shared"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again, where several parts of a plan read it; a lost executor costs no recomputation. It stays for lazy readers."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order, start: int = 0) -> DataFrame:
    """df in order with its rows' numbers: sorted by range, numbered in each part, and the parts' counts added up. Ties must be equal rows.

    The sorted rows are checkpointed, so that parts stay what they were when they are read again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    rows = rows.withColumn("__k", F.monotonically_increasing_id())
    part = F.shiftright("__k", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each part
    sizes = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    found = rows.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return found.withColumn(name, F.col("__before") + F.col("__k").bitwiseAND((1 << 33) - 1) + start).drop("__k", "__part", "__before")
