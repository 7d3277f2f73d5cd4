"""Converted trajectories, a JSON object a line, to a table of trajectories and a table of their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_udf, text, variants
from .events import PROVENANCE, as_events


def word(v: Column, name: str) -> Column:
    """A member as text: a string as it is, '' for none, anything else as its JSON."""
    x = variants.field(v, name, "variant")
    return F.when(x.isNull() | (variants.kind(x) == "VOID"), "").when(variants.kind(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))


def trajectories(lines: DataFrame, label: str = "") -> DataFrame:
    """traj_id, schema_version, details VARIANT, content array<variant>, source_sha256, content_sha256, source_file, lineno, error of lines (src_file, lineno, value).

    A line that is no JSON object, or has content that is no list, isn't dropped: error says what is wrong. traj_id is the id, else
    line-<lineno>; a line whose traj_id an earlier line has too gets one with its file before it, and an error if it had none. Blank
    lines are none. source_file: the file's name, or the label. Hashes are those of the canonical JSON of the whole object and of its content.
    """
    t = lines.filter(F.col("value").rlike(r"\S")).withColumn("rec", F.try_parse_json("value"))
    object_ = variants.is_object(F.col("rec"))
    content = variants.field(F.col("rec"), "content", "variant")
    listed = content.isNull() | (variants.kind(content) == "VOID") | variants.kind(content).startswith("ARRAY")
    error = F.when(F.col("rec").isNull(), "invalid JSON").when(~object_, "not an object").when(~listed, "content is no list")
    own = F.nullif(text.normalize(F.when(object_, word(F.col("rec"), "id"))), F.lit(""))
    t = t.withColumn("traj_id", F.coalesce(own, F.concat(F.lit("line-"), F.col("lineno").cast("string"))))
    if "src_file" not in lines.columns:
        t = t.withColumn("src_file", F.lit(label))
    name = F.substring_index("src_file", "/", -1)
    first = t.groupBy("traj_id").agg(F.min(F.struct("src_file", "lineno")).alias("first"))
    t = t.join(first, "traj_id").withColumn("again", F.col("first") != F.struct("src_file", "lineno"))
    error = F.coalesce(error, F.when(F.col("again"), F.lit("the id of an earlier line")))
    return t.select(
        F.when(F.col("again"), F.concat("src_file", F.lit(":line-"), F.col("lineno").cast("string"))).otherwise(F.col("traj_id")).alias("traj_id"),
        F.when(object_, text.normalize(word(F.col("rec"), "schema_version"))).otherwise("").alias("schema_version"),
        F.when(object_, variants.field(F.col("rec"), "details", "variant")).alias("details"),
        F.when(error.isNull(), F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))).alias("content"),
        F.when(object_, json_udf.json_hash(F.col("value"))).alias("source_sha256"),
        F.when(object_, F.sha2(json_udf.canonical_json(json_udf.member_json(F.col("value"), "content", "[]")), 256)).alias("content_sha256"),
        name.alias("source_file"),
        "lineno",
        error.alias("error"),
    )


def provenance(item: Column) -> Column:
    """Where an item comes from: its provenance, if that is an object, else what members of the same names the item itself has; null for neither."""
    nested = variants.field(item, "provenance", "variant")
    flat = [F.try_variant_get(item, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in PROVENANCE.fields]
    own = F.when(F.coalesce(*(c.cast("string") for c in flat)).isNotNull(), F.struct(*flat))
    return F.when(variants.is_object(nested), F.try_variant_get(nested, "$", PROVENANCE.simpleString())).otherwise(own)


#: Members of details that a stripped trajectory doesn't keep (fixed values).
DROPPED_DETAILS = ("raw_tool_inputs_by_id", "raw_tool_results_by_id", "file_history_snapshots", "cwd", "git_branches", "tool_use_id_to_function", "summary")


def without_details(trajs: DataFrame, *names: str) -> DataFrame:
    """trajs whose details (VARIANT) lack some members, by default those that stripped trajectories don't keep; details that are no object stay."""
    d = F.col("details")
    return trajs.withColumn("details", F.when(variants.is_object(d), F.parse_json(variants.without_keys(d, *(names or DROPPED_DETAILS)))).otherwise(d))


def events(trajs: DataFrame) -> DataFrame:
    """The items of good trajectories as events, with original_idx where an item says from which place it was stripped.

    An item that is no object has no class_; an object without one has an empty one. Arguments that are no object are none.
    """
    e = trajs.filter("error is null").select("traj_id", F.posexplode("content").alias("idx", "x"))
    x = F.col("x")
    item = lambda name: F.when(variants.is_object(x) & variants.field(x, name, "variant").isNotNull(), word(x, name))
    kwargs = variants.field(x, "kwargs", "variant")
    place = F.try_variant_get(x, "$.strip_source.original_adp_content_index", "variant")
    e = e.select(
        "traj_id",
        "idx",
        F.when(variants.is_object(x), F.coalesce(item("class_"), F.lit(""))).alias("class_"),
        *(item(n).alias(n) for n in ("source", "name", "content", "language", "function", "description", "reasoning_content")),
        F.when(variants.is_object(kwargs), F.to_json(kwargs)).alias("kwargs_json"),
        provenance(x).alias("provenance"),
        F.when(variants.kind(place).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(place, "$", "int")).alias("original_idx"),
    )
    have = as_events(e)
    return e.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in have.schema.fields), "original_idx")
