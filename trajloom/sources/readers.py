"""Readers: Parquet, JSON lines with line numbers (plain, gzip, zstd), text folders."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import folders, named_files


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file or folder; with a schema only its columns are read."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return (reader.schema(schema) if schema else reader).parquet(path)


def expanded(spark: SparkSession, *patterns: str) -> list[str]:
    """Paths that the patterns match, sorted within each; a pattern that matches nothing stands for itself, so that reading it says what is missing."""
    out = []
    for p in patterns:
        out += [f for f, _ in folders.matching(spark, p)] or [p]
    return out


def texts_at(df: DataFrame, path: str, size: int = 8 << 20) -> DataFrame:
    """df with value: the text of the file that each row's path names, null where there is none.

    Tasks open the files, through Arrow (see named_files.opened()); no folder is listed, and a batch has about `size` bytes of texts, or one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = named_files.Opener()
        for batch in batches:
            first, found, held = 0, [], 0
            for i, name in enumerate(batch.column(path).to_pylist()):
                data = None
                with contextlib.suppress(FileNotFoundError):
                    if name is not None:
                        fs, inner = opener.opened(name)
                        with fs.open_input_file(inner) as f:
                            data = f.read()
                found.append(data)
                held += len(data or b"")
                if held >= size or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(found)).columns, pa.array(found, pa.binary())], names=names)
                    first, found, held = i + 1, [], 0

    names = [*df.columns, "value"]
    schema = StructType([*df.schema.fields, StructField("value", BinaryType())])
    return df.mapInArrow(read, schema).withColumn("value", F.col("value").cast("string"))


def predictions(plan: DataFrame, name: str = "prediction.json") -> DataFrame:
    """folder, pred VARIANT of the file of that name in each run_dir of a plan; null where there is none or it isn't a JSON object."""
    tasks = 4 * plan.sparkSession.sparkContext.defaultParallelism  # the work is in the files, however few bytes the paths have
    at = plan.select(F.col("run_dir").alias("folder")).repartition(tasks, "folder").distinct().withColumn("path", F.concat(F.regexp_replace("folder", "/+$", ""), F.lit(f"/{name}")))
    v = F.try_parse_json("value")
    return texts_at(at, "path").select("folder", F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("pred"))


def files_under(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, length, modified of files below a folder; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def first_file(spark: SparkSession, path: str, glob: str = "*.parquet") -> str:
    """The first file by path; an error if there is none."""
    found = files_under(spark, path, glob).agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {glob} below {path}")
    return found


def pick_file(names: DataFrame, must: list[str], avoid: list[str]) -> DataFrame:
    """Of paths whose lower-cased file names hold all of `must` and none of `avoid`, the shortest, then first."""
    name = F.lower(F.substring_index("path", "/", -1))
    for m in must:
        names = names.filter(name.contains(m.lower()))
    for a in avoid:
        names = names.filter(~name.contains(a.lower()))
    return names.orderBy(F.length("path"), "path").limit(1)


def lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl*", whole_files: bool = True, blank: bool = True) -> DataFrame:
    """src_file, lineno (from 1, blank lines counted), value. blank=False: blank lines are left out before lines are counted.

    whole_files: each file is one row while it is split, right for logs of up to some hundred MB and
    for a lone CR as line end. Without, files are read line by line and may be of any size;
    their lines are numbered split by split, and the splits' counts added up, so no task holds a file.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if whole_files:
        text = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("src_file"), "value")
        split = text.select("src_file", F.posexplode(F.split(F.regexp_replace("value", r"(\r\n?|\n)\z", ""), r"\r\n?|\n")).alias("pos", "value"))
        if not blank:
            nth = F.row_number().over(Window.partitionBy("src_file").orderBy("pos"))
            return split.filter(F.col("value").rlike(r"\S")).select("src_file", nth.alias("lineno"), "value")
        return split.select("src_file", (F.col("pos") + 1).alias("lineno"), "value")
    text = reader.text(path).select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k"), "value")
    text = text if blank else text.filter(F.col("value").rlike(r"\S"))
    sizes = text.groupBy("src_file", "start").agg(F.count("*").alias("n"))  # a row for each split
    before = sizes.select("src_file", "start", (F.sum("n").over(Window.partitionBy("src_file").orderBy("start")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("src_file", "start").orderBy("k"))
    return text.withColumn("nth", nth).join(before, ["src_file", "start"]).select("src_file", (F.col("before") + F.col("nth")).cast("int").alias("lineno"), "value")


def parsed(raw: DataFrame) -> DataFrame:
    """lines() without blank ones, with rec VARIANT and error: 'invalid JSON', 'not an object' or null."""
    rec = F.try_parse_json("value")
    kind = F.schema_of_variant(rec)
    error = F.when(rec.isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "not an object")
    return raw.filter(F.col("value").rlike(r"\S")).withColumn("rec", rec).withColumn("error", error)


def jsonl(spark: SparkSession, path: str, glob: str = "*.jsonl*", strict: bool = True, whole_files: bool = True, output: str | None = None) -> DataFrame:
    """src_file, lineno, rec. strict: the first bad line fails the query, with its file and number; else bad lines are left out (see bad_lines). whole_files: see lines(). output: a file or folder that is being written and isn't read."""
    raw = lines(spark, path, glob, whole_files)
    if output is not None:
        own = output.split(":", 1)[-1].lstrip("/")
        raw = raw.filter(~F.regexp_replace("src_file", r"^[a-z]+:/*", "").startswith(own))
    p = parsed(raw)
    if not strict:
        return p.filter("error is null").select("src_file", "lineno", "rec")
    where = F.concat(F.col("src_file"), F.lit(":"), F.col("lineno").cast("string"), F.lit(": "), F.col("error"))
    return p.select("src_file", "lineno", F.when(F.col("error").isNotNull(), F.raise_error(where).cast("variant")).otherwise(F.col("rec")).alias("rec"))


def bad_lines(raw: DataFrame, preview: int = 200) -> DataFrame:
    """The audit of lines that don't parse: src_file, lineno, error, preview, sha256."""
    return parsed(raw).filter("error is not null").select("src_file", "lineno", "error", F.left("value", F.lit(preview)).alias("preview"), F.sha2("value", 256).alias("sha256"))


def text_folder(spark: SparkSession, path: str, glob: str = "*.txt", most: int | None = None) -> DataFrame:
    """path, value of whole text files, invalid bytes replaced; at most the first `most` characters."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), (F.left("value", F.lit(most)) if most else F.col("value")).alias("value"))


def record_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)
