"""Histograms, audits, ranks and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.json_udf import all_texts, approx_tokens


def most_common(df: DataFrame, column: str, k: int | None = None, order: str | None = None) -> DataFrame:
    """column, n: by count, ties by first place (`order`) or value; nulls count too. A limit becomes a top-k, not a sort."""
    first = F.min(order or column).alias("__first")
    out = df.groupBy(column).agg(F.count("*").alias("n"), first).orderBy(F.desc("n"), "__first")
    return (out.limit(k) if k else out).select(column, "n")


def tool_histogram(bulk: DataFrame, k: int = 50) -> DataFrame:
    """tool, n: called functions and, as tool_msg:<name>, messages of tools."""
    m = bulk.select(F.explode("trajectory").alias("m"))
    named = F.when(F.col("m.role") == "tool", F.array(F.concat(F.lit("tool_msg:"), F.coalesce("m.name", F.lit("None"))))).otherwise(F.array().cast("array<string>"))
    called = F.coalesce(F.transform("m.tool_calls", lambda c: c["function"]["name"]), F.array().cast("array<string>"))
    return most_common(m.select(F.explode(F.concat(called, named)).alias("tool")), "tool", k)


def raw_audit(bulk: DataFrame) -> DataFrame:
    """One row: rows, repos (null counts as one), avg_messages, max_messages, resolved, unresolved."""
    size = F.greatest(F.size("trajectory"), F.lit(0))
    repos = F.count_distinct("repo") + F.max(F.col("repo").isNull().cast("int"))
    return bulk.agg(F.count("*").alias("rows"), repos.alias("repos"), F.avg(size).alias("avg_messages"), F.max(size).alias("max_messages"), F.count_if(F.col("resolved") == 1).alias("resolved"), F.count_if(F.col("resolved") == 0).alias("unresolved"))


def event_counts(events: DataFrame) -> DataFrame:
    """traj_id, n, and how many events of each class and of the common functions."""
    cls = ("text_observation", "api_action", "code_action", "message_action")
    fns = ("execute_bash", "str_replace_editor", "think", "finish", "task_tracker")
    return events.groupBy("traj_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("class_") == c).alias(f"{c}_count") for c in cls), *(F.count_if(F.col("function") == f).alias(f"{f}_count") for f in fns))


def rank_small(bulk: DataFrame, events: DataFrame, only_resolved: bool = True, tokens=approx_tokens) -> DataFrame:
    """Trajectories by tokens, smallest first: sizes, counts and rank. tokens: Column -> Column."""
    size = lambda c: tokens(c).cast("long")
    rows = bulk.filter("resolved = 1") if only_resolved else bulk
    rows = rows.select(F.col("trajectory_id").alias("traj_id"), "instance_id", "repo", "resolved", "exit_status", size(F.to_json("trajectory")).alias("raw_tokens"), size(F.coalesce("model_patch", F.lit(""))).alias("patch_tokens"), F.size("trajectory").alias("raw_message_count"))
    e = events.join(rows.select("traj_id"), "traj_id", "left_semi")
    own = e.groupBy("traj_id").agg(F.sum(size(F.to_json(F.struct("class_", "source", "name", "content", "function", "kwargs_json", "description", "reasoning_content")))).alias("adp_tokens"), F.min_by(F.when((F.col("class_") == "text_observation") & (F.col("source") == "user"), F.col("content")), F.when((F.col("class_") == "text_observation") & (F.col("source") == "user"), F.col("idx"))).alias("issue"))
    out = rows.join(own, "traj_id").join(event_counts(e).withColumnRenamed("n", "adp_content_count"), "traj_id").withColumn("issue_tokens", size(F.coalesce("issue", F.lit("")))).drop("issue")
    return out.orderBy("adp_tokens", "raw_tokens", "traj_id")


def thresholds(df: DataFrame, columns: Sequence[str], limits: Sequence[int]) -> DataFrame:
    """One row: for each column and limit, how many rows are at most the limit."""
    return df.agg(*(F.count_if(F.col(c) <= n).alias(f"{c}_le_{n}") for c in columns for n in limits))


def stratified_head(df: DataFrame, by: str, order: Sequence[str], each: int) -> DataFrame:
    """The first rows of each stratum; Spark keeps `each` rows of a stratum in every task before it shuffles."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__n") <= each).drop("__n")


def length_summary(df: DataFrame, length: str, *by: str) -> DataFrame:
    """count, min, max, mean, median of a length in each group; mean and median aren't rounded."""
    c = F.col(length)
    return df.groupBy(*by).agg(F.count("*").alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.median(c).alias("median"))


def repeats(df: DataFrame, *keys: str, order: Sequence[str]) -> DataFrame:
    """Second and later rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n > 1").drop("__n")


def forbidden_hits(df: DataFrame, key: str, column: str, patterns: Sequence[tuple[str, str]] = rules.PROMPT_FORBIDDEN, excerpt: int = 240) -> DataFrame:
    """key, pattern, line (from 1), excerpt: for each row and pattern the first line it is found in.

    A pattern is looked for in the whole text first, and only texts that have it are cut into lines
    for it. Nothing is shuffled: rows that share a key give rows of their own.
    """
    lines = F.split(column, "\n")

    def first(name: str, pattern: str) -> Column:
        hits = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(pattern), F.struct(F.lit(name).alias("pattern"), (i + 1).alias("line"), text.strip(line).alias("at")))), lambda x: x.isNotNull())
        return F.when(F.col(column).rlike("(?m)" + pattern), F.get(hits, F.lit(0)))

    rows = df.select(key, F.explode(F.array_compact(F.array(*(first(n, p) for n, p in patterns)))).alias("x"))
    at = F.col("x.at")
    return rows.select(key, "x.pattern", "x.line", F.when(F.char_length(at) > excerpt, F.concat(F.left(at, F.lit(excerpt)), F.lit("..."))).otherwise(at).alias("excerpt"))


def leak_hits(texts: DataFrame, key: str, values: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """key, pattern, n: how many of an array's strings each pattern is found in."""
    t = texts.select(key, F.explode(values).alias("v"))
    found = F.array_compact(F.array(*(F.when(F.col("v").rlike(p), F.lit(n)) for n, p in patterns)))
    return t.select(key, F.explode(found).alias("pattern")).groupBy(key, "pattern").agg(F.count("*").alias("n"))


def leaks(records: DataFrame, key: str, json: str) -> DataFrame:
    """key, pattern: which leak patterns the strings and keys of a JSON record hold, without what is under renderer, quality and strip_metadata.

    Strings and keys (as __KEY__:key) are searched together, in one text of lines.
    """
    found = records.select(key, F.array_join(all_texts(F.col(json), rules.LEAK_SKIPPED), "\n").alias("__all"))
    return found.select(key, F.explode(F.array_compact(F.array(*(F.when(F.col("__all").rlike("(?im)" + p), F.lit(n)) for n, p in rules.LEAKS)))).alias("pattern"))


def prompt_checks(prompts: DataFrame, forbidden: Sequence[str] = rules.PROMPT_LITERALS) -> DataFrame:
    """run_id, problem: no prompt, a hash that doesn't fit, no marker of the condition, no instance id, forbidden strings."""
    p = F.col("prompt")
    marker = F.concat(F.lit("Condition: "), F.col("condition"))
    problems = [F.when(p.isNull(), "no prompt"), F.when(text.sha(p) != F.col("prompt_sha256"), "hash differs"), F.when(~p.contains(marker), "no marker"), F.when(~p.contains(F.col("target_instance_id")), "no instance id"), *(F.when(p.contains(f), f"forbidden: {f}") for f in forbidden)]
    return prompts.select("run_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def counted(df: DataFrame, name: str, value: Column, k: int | None = None) -> DataFrame:
    """name, value (as text, null for none), n: by count, then value."""
    out = df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("n"))
    out = out.orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(k) if k else out
    return out.select(F.lit(name).alias("name"), "value", "n")


def raw_histograms(bulk: DataFrame) -> DataFrame:
    """name, value, n: resolved, exit_status (the ten most common) and role, nulls counted."""
    roles = bulk.select(F.explode("trajectory").alias("m"))
    return counted(bulk, "resolved", F.col("resolved")).unionByName(counted(bulk, "exit_status", F.col("exit_status"), 10)).unionByName(counted(roles, "role", F.col("m.role")))


#: What a converted trajectory must have to be valid.
CONVERTED = "struct<schema_version:string,id:string,content:array<variant>,details:map<string,string>>"


def converted_audit(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, value, n over lines of converted trajectories: rows, validation_errors, classes, api_functions (20), resolved, repos (how many).

    A line is valid if it is an object with an id, an array of items that are objects with a class_,
    and details that are an object. Invalid ones only count as rows and errors.
    """
    v = F.try_parse_json(column)
    items = F.try_variant_get("__v", "$.content", "array<variant>")
    object_ = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    cls = lambda x: F.try_variant_get(x, "$.class_", "string")
    good = object_(F.col("__v")) & F.try_variant_get("__v", "$.id", "string").isNotNull() & items.isNotNull() & object_(F.try_variant_get("__v", "$.details", "variant"))
    good = good & F.coalesce(F.forall(items, lambda x: object_(x) & cls(x).isNotNull()), F.lit(False))
    t = lines.filter(F.col(column).rlike(r"\S")).select(v.alias("__v")).withColumn("good", good)
    ok = t.filter("good")
    item = ok.select(F.explode(items).alias("x"))
    of = lambda k: F.coalesce(F.try_variant_get("__v", f"$.details.{k}", "string"), F.lit(""))
    one = lambda name, df: df.select(F.lit(name).alias("name"), F.lit(None).cast("string").alias("value"), F.col("n"))
    out = one("rows", t.agg(F.count("*").alias("n"))).unionByName(one("validation_errors", t.agg(F.count_if(~F.col("good")).alias("n"))))
    out = out.unionByName(counted(item, "classes", cls(F.col("x")))).unionByName(counted(item.filter(cls(F.col("x")) == "api_action"), "api_functions", F.coalesce(F.try_variant_get("x", "$.function", "string"), F.lit("unknown")), 20))
    return out.unionByName(counted(ok, "resolved", of("resolved"))).unionByName(one("repos", ok.agg(F.count_distinct(of("repo")).alias("n"))))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, counted: side ('left' or 'right') and the row."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in both tables, only in the left or only in the right one."""
    both = a.select(key).distinct().withColumn("l", F.lit(1)).join(b.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


