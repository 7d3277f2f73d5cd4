"""The ordered event model all trajectory operators share, and windows over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I = T.StringType(), T.IntegerType()
PROVENANCE = T.StructType([T.StructField(n, I if n in ("raw_jsonl_line", "raw_block_index") else S) for n in ("raw_jsonl_line", "raw_uuid", "raw_parent_uuid", "raw_role", "raw_block_type", "raw_block_index", "tool_use_id")])
#: One row per item of a trajectory; idx counts from 0. Arguments of tools are JSON text.
EVENTS = T.StructType(
    [T.StructField("traj_id", S), T.StructField("idx", I)]
    + [T.StructField(n, S) for n in ("class_", "source", "name", "content", "language", "function", "kwargs_json", "description", "reasoning_content")]
    + [T.StructField("provenance", PROVENANCE)]
)
ACTIONS = ("api_action", "code_action")


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENTS)


def as_events(df: DataFrame) -> DataFrame:
    """df with all event columns in order, those it lacks null; others are left out."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS.fields))


def in_order() -> Window:
    return Window.partitionBy("traj_id").orderBy("idx")


def before() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def is_action() -> Column:
    return F.col("class_").isin(*ACTIONS)


def with_previous_action(events: DataFrame, *columns: str, prefix: str = "prev_") -> DataFrame:
    """Add prev_<column> of the nearest action before each event, null if there is none: one window, no join."""
    at = F.last(F.when(is_action(), F.struct(*columns)), ignorenulls=True).over(before())
    out = events.withColumn("__prev", at)
    return out.select(*events.columns, *(F.col(f"__prev.{c}").alias(prefix + c) for c in columns))


def argument(name: str, kwargs: str = "kwargs_json") -> Column:
    """A tool argument that is a JSON string, null if it is missing or of another type."""
    v = F.try_parse_json(F.col(kwargs))
    return F.when(F.schema_of_variant(F.expr(f"try_variant_get(try_parse_json(`{kwargs}`), '$.{name}', 'variant')")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
