"""Chat trajectories with tool calls, as arrays of structs, to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .events import as_events

#: A row of the bulk corpus.
MESSAGE = "struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>"
ROW = f"trajectory_id string, instance_id string, repo string, trajectory array<{MESSAGE}>, tools string, model_patch string, exit_status string, resolved int, gen_tests_correct double, pred_passes_gen_tests double"
#: Fields that each role keeps (fixed values); others keep role and content.
ROLE_FIELDS = {"assistant": ("tool_calls",), "tool": ("name", "tool_call_id")}


def clean_messages(df: DataFrame, column: str = "trajectory") -> DataFrame:
    """Null out the fields that a message's role doesn't have; to_json then leaves them out."""
    only = lambda m, name: F.when(m["role"].isin(*(r for r, f in ROLE_FIELDS.items() if name in f)), m[name]).alias(name)
    return df.withColumn(column, F.transform(column, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), *(only(m, n) for n in ("name", "tool_call_id", "tool_calls")))))


def json_or_text(c: Column) -> Column:
    """VARIANT: the parsed value, or the string itself where it isn't JSON."""
    return F.coalesce(F.try_parse_json(c), c.cast("variant"))


def as_object(c: Column) -> Column:
    """JSON text of an object: objects as they are, null as {}, anything else as {"value": it}."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    wrapped = F.when(v.isNull(), F.to_json(F.struct(c.alias("value")))).otherwise(F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}")))
    return F.when(c.isNull() | (kind == "VOID"), F.lit("{}")).when(kind.startswith("OBJECT"), c).otherwise(wrapped)


def details(df: DataFrame, dataset: str, column: str = "trajectory") -> DataFrame:
    """Add details map<string,string>: every other column as text ('' for null), the data set's name, and six keys that are always there."""
    always = ("trajectory_id", "instance_id", "repo", "model_patch", "exit_status", "resolved")
    names = [c for c in df.columns if c != column]
    have = F.map_from_arrays(F.array(*map(F.lit, [*names, "dataset"])), F.array(*(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names), F.lit(dataset)))
    more = [a for a in always if a not in names]
    missing = F.map_from_arrays(F.array(*map(F.lit, more)), F.array(*(F.lit("") for _ in more))) if more else None
    return df.withColumn("details", F.map_concat(have, missing) if more else have)


def with_errors(df: DataFrame, column: str = "trajectory") -> DataFrame:
    """df with error: why a row can't be converted, null where it can."""
    error = F.when(F.col("trajectory_id").isNull(), "no trajectory_id").when(F.col(column).isNull(), "no trajectory").when(F.exists(column, lambda m: m.isNull()), "a message is null")
    return df.withColumn("error", error)


def convert(df: DataFrame, column: str = "trajectory", errors: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(events of the rows that can be converted, trajectory_id and error of the others); errors='raise' fails where there is one, 'skip' leaves it out."""
    if errors not in ("raise", "skip"):
        raise ValueError(f"errors is 'raise' or 'skip', not {errors!r}")
    rows = with_errors(df, column)
    bad = rows.filter("error is not null").select("trajectory_id", "error")
    if errors == "skip":
        return events(rows.filter("error is null").drop("error"), column), bad
    said = F.raise_error(F.concat(F.coalesce("trajectory_id", F.lit("?")), F.lit(": "), F.col("error")))
    return events(rows.withColumn("trajectory_id", F.when(F.col("error").isNotNull(), said.cast("string")).otherwise(F.col("trajectory_id"))).drop("error"), column), bad


def events(df: DataFrame, column: str = "trajectory") -> DataFrame:
    """Events of each row: system, user and tool messages are observations, each tool call an action, other
    assistant text a message; an empty assistant message gives none and an unknown role is kept as an observation.
    """
    m = df.select(F.col("trajectory_id").cast("string").alias("traj_id"), F.posexplode(column).alias("m_no", "m"))
    m = m.select("traj_id", "m_no", "m", F.posexplode_outer("m.tool_calls").alias("c_no", "call"))
    role, content = F.col("m.role"), F.coalesce("m.content", F.lit(""))
    call = (role == "assistant") & F.col("call").isNotNull()
    said = (role == "assistant") & F.col("call").isNull()
    m = m.filter((F.coalesce("c_no", F.lit(0)) == 0) | call).filter(~F.coalesce(said & (text.strip(content) == ""), F.lit(False)))
    known = role.isin("system", "user", "tool", "assistant")
    args = as_object(F.col("call.function.arguments"))
    label = lambda key, c: F.when(c.isNotNull() & F.get_json_object(args, f"$.{key}").isNull(), F.concat(F.lit(f'"{key}":'), F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)))
    extra = F.concat_ws(",", label("_openhands_tool_call_id", F.col("call.id")), label("_openhands_tool_call_type", F.col("call.type")))
    kwargs = F.when(extra == "", args).when(F.regexp_replace(args, r"\s", "") == "{}", F.concat(F.lit("{"), extra, F.lit("}"))).otherwise(F.concat(F.regexp_replace(args, r"\}\s*\z", ","), extra, F.lit("}")))
    thought = F.get_json_object(args, "$.thought")
    out = m.select(
        "traj_id",
        (F.row_number().over(Window.partitionBy("traj_id").orderBy("m_no", "c_no")) - 1).alias("idx"),
        F.when(call, "api_action").when(said, "message_action").otherwise("text_observation").alias("class_"),
        F.when(call | said, None).when(role == "user", "user").otherwise("environment").alias("source"),
        F.when(call | said, None).when(role.isin("system", "user"), role).when(role == "tool", F.coalesce("m.name", "m.tool_call_id", F.lit("tool"))).otherwise(F.concat(F.lit("unknown_role:"), F.coalesce(role, F.lit("None")))).alias("name"),
        F.when(call, None).when(F.coalesce(known, F.lit(False)), content).otherwise(F.to_json("m")).alias("content"),
        F.when(call, F.coalesce("call.function.name", F.lit("unknown_tool"))).alias("function"),
        F.when(call, kwargs).alias("kwargs_json"),
        F.when(call & (text.strip(content) != ""), text.strip(content)).alias("description"),
        F.when(call & (F.col("call.function.name") == "think") & (text.strip(thought) != ""), thought).alias("reasoning_content"),
    )
    return as_events(out)


def parity(raw: DataFrame, converted: DataFrame, most: int = 20) -> DataFrame:
    """Rows that converted badly, at most `most`: traj_id, error. raw: bulk rows; converted: their events.

    Ids must match both ways; the numbers of calls, messages and observations and the multiset of called functions must be those of the raw row.
    """
    m = raw.select(F.col("trajectory_id").cast("string").alias("traj_id"), F.explode_outer("trajectory").alias("m"))
    calls = F.coalesce(F.size("m.tool_calls"), F.lit(0))
    said = (F.col("m.role") == "assistant") & (calls < 1) & (text.strip(F.coalesce("m.content", F.lit(""))) != "")
    names = F.transform(F.coalesce("m.tool_calls", F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")), lambda c: F.coalesce(c["function"]["name"], F.lit("unknown_tool")))
    want = m.groupBy("traj_id").agg(
        F.sum(F.when(F.col("m.role") == "assistant", F.greatest(calls, F.lit(0))).otherwise(0)).alias("calls"), F.sum(said.cast("int")).alias("said"),
        F.sum(F.when(F.col("m").isNotNull() & (F.coalesce("m.role", F.lit("")) != "assistant"), 1).otherwise(0)).alias("seen"), F.array_sort(F.flatten(F.collect_list(F.when(F.col("m.role") == "assistant", names)))).alias("names"),
    )
    kind = lambda c: F.sum((F.col("class_") == c).cast("int"))
    have = converted.groupBy("traj_id").agg(kind("api_action").alias("h_calls"), kind("message_action").alias("h_said"), kind("text_observation").alias("h_seen"), F.array_sort(F.collect_list("function")).alias("h_names"))
    both = want.withColumn("w", F.lit(1)).join(have.withColumn("h", F.lit(1)), "traj_id", "full_outer")
    error = (
        F.when(F.col("w").isNull(), "not in the raw rows").when(F.col("h").isNull() & (F.col("calls") + F.col("said") + F.col("seen") > 0), "not converted").when(F.col("h").isNull(), None)
        .when(F.col("calls") != F.col("h_calls"), "number of calls").when(F.col("said") != F.col("h_said"), "number of messages").when(F.col("seen") != F.col("h_seen"), "number of observations").when(F.col("names") != F.col("h_names"), "called functions")
    )
    return both.select("traj_id", error.alias("error")).filter("error is not null").orderBy("traj_id", "error").limit(most)
