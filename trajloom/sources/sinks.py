"""Writers: JSON lines in shards, CSV, reports, and one file per record."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shared
from ..functions import text as T
from ..functions.json_udf import canonical_json, indented_json
from . import named_files


def jsonl(df: DataFrame, path: str, rows_per_file: int = 500, codec: str = "gzip", keep_nulls: bool = False) -> None:
    """One JSON object a line, fields in column order, in files of at most rows_per_file rows, named by Spark. For shards with numbers, or zstd, see shards()."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(not keep_nulls).lower()})
    df.select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", codec).text(path)


def parquet(df: DataFrame, path: str, *by: str, rows_per_file: int = 0, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", codec).partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """Each record's text in a folder named by its key, written by Spark so that any file system works and retries are safe."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", 1).partitionBy(key).text(path)


def report(df: DataFrame, path: str) -> dict:
    """A one-row report: returned as a dictionary and written as pretty JSON."""
    found = json.loads(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).first()[0])
    one = df.sparkSession.createDataFrame([(json.dumps(found, indent=2, sort_keys=True, ensure_ascii=False),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(path)
    return found


def lines_report(df: DataFrame, path: str, *columns: str) -> None:
    """Tab-separated lines."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def files(df: DataFrame, path: str, name: Column | str, value: Column | str, mode: str = "overwrite") -> DataFrame:
    """One file per record, its name (which may have folders) and text from the row; a null text is an empty file. Returns the names, as a table.

    Rows meet by name, so a name that comes twice is found and fails the job, which then leaves what was there before. Tasks are as many as
    the session's shuffle partitions: the work is in the files, however few bytes they have.
    """
    spark = df.sparkSession
    name, value = (F.col(c) if isinstance(c, str) else c for c in (name, value))
    rows = df.select(name.cast("string").alias("name"), value.cast("string").alias("value"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return named_files.write(rows.repartition(tasks, "name").sortWithinPartitions("name"), path, mode == "overwrite")


def numbered_texts(df: DataFrame, path: str, id: str, value: Column | str, *order: str, start: int = 1, suffix: str = ".txt", mode: str = "overwrite") -> DataFrame:
    """Files 000001_<id>.txt, numbered in order of the given columns; ids become safe parts of a name, texts end in a line feed. Returns the names, as a table."""
    body = F.col(value) if isinstance(value, str) else value
    rows = shared.numbered(df.withColumn("__body", F.concat(F.coalesce(body, F.lit("")), F.lit("\n"))), "__n", *map(F.col, order), start=start)
    return files(rows, path, F.concat(F.format_string("%06d", "__n"), F.lit("_"), T.safe_file_name(F.col(id).cast("string")), F.lit(suffix)), "__body", mode)


def documents(df: DataFrame, path: str, stem: str, json_text: str, suffix: str = ".adp.json", mode: str = "overwrite") -> None:
    """One indented JSON file per row, keys in their order, named by its stem; a text that isn't JSON fails the job and is named."""
    body = indented_json(F.col(json_text))
    checked = F.when(body.isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.col(stem)))).otherwise(F.concat(body, F.lit("\n")))
    files(df, path, F.concat(F.col(stem), F.lit(suffix)), checked, mode)


def prompt_files(df: DataFrame, path: str, root: str | None = None, mode: str = "overwrite") -> None:
    """Prompts as <target>/<condition>/prompt.txt below `path` and, where root is given and a run has an output_dir, as <output_dir>/prompt.txt below it.

    df: target_instance_id, condition, output_dir, prompt.
    """
    own = F.concat_ws("/", T.safe_path_part(F.col("target_instance_id")), T.safe_path_part(F.col("condition")), F.lit("prompt.txt"))
    files(df, path, own, "prompt", mode)
    if root is not None:
        files(df.filter(F.col("output_dir") != ""), root, F.concat(F.regexp_replace("output_dir", "^/+|/+$", ""), F.lit("/prompt.txt")), "prompt", "append")


def shards(df: DataFrame, path: str, *order: str, rows: int = 500, name: str = "part-%05d.jsonl.zst", line: Column | None = None, mode: str = "overwrite") -> None:
    """JSON lines in files part-00000.jsonl.zst, part-00001.jsonl.zst, ... of `rows` rows each, the last one shorter, in order of the given columns.

    The numbers come from the rows' places: ranges of the order are counted, the counts added up, and a shard's rows meet in the task
    that compresses them. Rows that tie must be equal. line: another line than the JSON of all columns but those of the order named __*.
    """
    if rows < 1:
        raise ValueError("a shard needs a row at least")
    own = [c for c in df.columns if not c.startswith("__")]
    line = F.to_json(F.struct(*own), {"ignoreNullFields": "false"}) if line is None else line
    keyed = df.select(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), line.alias("value"))
    numbered = shared.numbered(keyed, "__n", *(F.col(f"__o{i}") for i in range(len(order))), F.col("value"))
    named = numbered.select(F.format_string(name, F.floor(F.col("__n") / rows)).alias("name"), "value", "__n")
    named_files.write(named.repartition("name").sortWithinPartitions("name", "__n").select("name", "value"), path, mode == "overwrite", lines="true")


def canonical_lines(df: DataFrame, path: str, *order: str, rows: int = 1 << 20, name: str = "part-%05d.jsonl", mode: str = "overwrite") -> None:
    """JSON lines with sorted keys, no blanks and tidy strings, in order, in numbered files."""
    own = [c for c in df.columns if not c.startswith("__")]
    shards(df, path, *order, rows=rows, name=name, line=canonical_json(F.to_json(F.struct(*own), {"ignoreNullFields": "false"})), mode=mode)
