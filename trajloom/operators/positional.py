"""Rows by their place in files: two sets of files read side by side, and limits that count the rows seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import folders, readers


def by_place(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl*") -> DataFrame:
    """file_no, row_no (both from 0), src_file, lineno, value: the lines that aren't blank, files by path.

    Files are read in splits. A line's number is its place in its split and the count of the splits before, so no file is sorted or held whole; only a
    row for each split and one for each file are ordered.
    """
    raw = readers.lines(spark, path, glob, whole_files=False, blank=False)
    files = raw.select("src_file").distinct()
    numbers = files.withColumn("file_no", (F.row_number().over(Window.orderBy("src_file")) - 1).cast("int"))  # a row for each file
    return raw.join(numbers, "src_file").select("file_no", (F.col("lineno") - 1).alias("row_no"), "src_file", "lineno", "value")


def side_by_side(left: DataFrame, right: DataFrame, left_id: Column, right_id: Column, strict: bool = True, same_files: bool = False) -> DataFrame:
    """file_no, row_no, left_value, right_value, left_id, right_id: the n-th row of the n-th file of each side, as far as both go.

    left, right: see by_place(). The ids are columns over `value` and must be equal: with strict the first row whose ids differ fails the query and is
    named; else such rows are there to be listed (see mismatches()). same_files: sides with different numbers of files fail.
    """
    own = lambda df, name, id: df.select("file_no", "row_no", F.col("value").alias(f"{name}_value"), id.alias(f"{name}_id"))
    out = own(left, "left", left_id).join(own(right, "right", right_id), ["file_no", "row_no"])
    if same_files:
        n = left.agg(F.count_distinct("file_no").alias("l")).crossJoin(right.agg(F.count_distinct("file_no").alias("r"))).first()  # one row each
        if n["l"] != n["r"]:
            raise ValueError(f"{n['l']} and {n['r']} files")
    if strict:
        differ = ~F.col("left_id").eqNullSafe(F.col("right_id"))
        said = F.concat(F.lit("ids differ: "), F.coalesce("left_id", F.lit("null")), F.lit(" and "), F.coalesce("right_id", F.lit("null")), F.lit(" in file "), F.col("file_no").cast("string"), F.lit(", row "), F.col("row_no").cast("string"))
        out = out.withColumn("left_id", F.when(differ, F.raise_error(said).cast("string")).otherwise(F.col("left_id")))
    return out


def mismatches(left: DataFrame, right: DataFrame, left_id: Column, right_id: Column) -> DataFrame:
    """file_no, row_no, error: rows whose ids differ, and of files of unequal length one row that says the lengths."""
    both = side_by_side(left, right, left_id, right_id, strict=False)
    bad = both.filter(~F.col("left_id").eqNullSafe(F.col("right_id")))
    rows = bad.select("file_no", "row_no", F.concat(F.lit("id mismatch: raw="), F.coalesce("left_id", F.lit("null")), F.lit(" converted="), F.coalesce("right_id", F.lit("null"))).alias("error"))
    count = lambda df, name: df.groupBy("file_no").agg(F.count("*").alias(name))
    sizes = count(left, "l").join(count(right, "r"), "file_no", "full_outer").select("file_no", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r")).filter("l <> r")
    said = F.concat(F.lit("row count mismatch: raw="), F.col("l").cast("string"), F.lit(" converted="), F.col("r").cast("string"))
    return rows.unionByName(sizes.select("file_no", F.least("l", "r").alias("row_no"), said.alias("error")))


@dataclass
class Seen:
    """rows: the first rows of the files, see by_place(); files: those that were read for it, in order."""

    rows: DataFrame
    files: list[str]


def first_seen(spark: SparkSession, pattern: str, limit: int | None) -> Seen:
    """The first `limit` rows of the files that a pattern matches, by path and place, whatever a filter makes of them later; None or 0: all rows.

    Files are counted in groups, each twice the one before, until there are enough rows; the files after those aren't opened. The driver holds
    names and counts of these files.
    """
    files = [p for p, _ in folders.matching(spark, pattern)]
    if not files:
        raise FileNotFoundError(f"nothing matches {pattern}")
    if not limit:
        return Seen(by_place(spark, files, "*"), files)
    if limit < 0:
        raise ValueError("a limit can't be negative")
    need: list[str] = []
    seen, left, step = 0, limit, 1
    while seen < len(files) and left > 0:
        group = files[seen : seen + step]
        found = readers.lines(spark, group, "*", whole_files=False, blank=False).groupBy("src_file").count().collect()  # a row for each file
        n = {r["src_file"]: r["count"] for r in found}
        for f in group:
            if left > 0:
                need.append(f)
                had, left = left, left - n.get(f, 0)
        seen, step = seen + len(group), step * 2
    rows = by_place(spark, need, "*")
    if left < 0:  # the last file has more than are wanted
        rows = rows.filter((F.col("src_file") != need[-1]) | (F.col("row_no") < had))
    return Seen(rows, need)
