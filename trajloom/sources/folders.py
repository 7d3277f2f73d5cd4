"""Folders of any Hadoop file system, as the driver sees them: list, move, remove. Needs a session with its own JVM (no Spark Connect)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def matching(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of what a glob pattern matches, by path."""
    fs, p = _at(spark, pattern)
    return sorted((f.getPath().toString(), f.getLen()) for f in fs.globStatus(p) or [])


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put a staged folder in a target's place; the folder that was there goes last, and comes back if the staged one can't be moved."""
    old = f"{staged}-old"
    had = exists(spark, target)
    if had:
        move(spark, target, old)
    try:
        move(spark, staged, target)
    except Exception:
        if had:
            move(spark, old, target)
        raise
    if had:
        remove(spark, old)
