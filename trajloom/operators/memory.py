"""Extractive memory of a trajectory: child tables over its events, no model involved."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, rules, text
from .events import argument, with_previous_action


@dataclass(frozen=True)
class MemoryConfig:
    template: str = "generic"
    max_problem_chars: int = 4000
    max_final_message_chars: int = 2000
    max_edit_excerpt_chars: int = 1200
    max_command_chars: int = 2000
    max_failures: int = 80
    max_observation_excerpt_chars: int = 1200
    max_evidence: int = 20
    max_rendered_commands: int = 12
    max_rendered_command_total_chars: int = 4000
    max_rendered_command_chars: int = 500
    hashes_only: bool = False
    exclude_setup_commands: bool = True
    exclude_destructive_commands: bool = True
    exclude_build_install_commands: bool = True
    max_raw_user_prompt_chars: int = 8000
    max_planning_action_chars: int = 2000
    max_reasoning_chars: int = 2000
    include_todowrite: bool = False
    include_reasoning: bool = False
    keep_excluded_edit_details: bool = True

    def __post_init__(self):
        low = [f.name for f in fields(self) if f.name.startswith("max_") and getattr(self, f.name) < 0]
        if low:
            raise ValueError(f"limits can't be negative: {', '.join(low)}")


#: Buckets by class and category, in the order records have them (fixed values).
COMMAND_BUCKETS = {"test": "test_commands", "diagnostic": "diagnostic_commands", "setup": "setup_commands", "destructive": "destructive_commands", "build_install": "build_install_commands", "other": "other_commands"}
EDIT_BUCKETS = {"source": "source_edits", "test": "test_edits", "scratch": "scratch_edits", "submission_artifact": "submission_artifacts", "other": "other_edits"}


def looked_up(column: str, table: dict[str, str]):
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(column)]


def short_description():
    return F.left(text.scrub("description"), F.lit(240))


def paths(events: DataFrame) -> DataFrame:
    """API actions with their path (memory policy) and raw_path."""
    api = events.filter("class_ = 'api_action'")
    a = {c: argument(c) for c in ("file_path", "path", "notebook_path")}
    filled = [F.when(text.strip(c) != "", c) for c in a.values()]
    raw = F.when(F.col("function") == "Glob", F.lit("")).otherwise(F.coalesce(*filled, F.lit("")))
    return api.withColumns({"path": classify.primary_path(F.col("function"), *a.values(), policy="memory"), "raw_path": text.strip(text.normalize(raw))})


def commands(events: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:  # noqa: B008
    """One row per bash command: traj_id, action_index, command_class, bucket, command (capped), sha256 (uncapped), truncated, contains_heredoc, prior_agent_description."""
    c = events.filter("class_ = 'code_action' and language = 'bash'").withColumn("raw", text.scrub("content"))
    c = c.withColumn("command_class", classify.command_class(F.col("raw"), "memory"))
    cut = text.truncate(F.col("raw"), cfg.max_command_chars)
    return c.select(
        "traj_id", F.col("idx").alias("action_index"), "command_class", looked_up("command_class", COMMAND_BUCKETS).alias("bucket"), cut["text"].alias("command"),
        text.sha(F.col("raw")).alias("sha256"), cut["truncated"].alias("truncated"), F.col("raw").rlike(rules.HEREDOC).alias("contains_heredoc"), short_description().alias("prior_agent_description"),
    )


def _observations(events: DataFrame) -> DataFrame:
    """Environment observations with their preceding action, its class and path."""
    e = events.withColumn("__cls", F.when((F.col("class_") == "code_action") & (F.col("language") == "bash"), classify.command_class(text.scrub("content"), "memory")))
    a = [argument(c) for c in ("file_path", "path", "notebook_path")]
    e = e.withColumn("__path", F.when(F.col("class_") == "api_action", classify.primary_path(F.col("function"), *a, policy="memory")).otherwise(F.lit("")))
    e = with_previous_action(e, "idx", "class_", "function", "language", "__cls", "__path")
    return e.filter("class_ = 'text_observation' and source = 'environment'").withColumn("clean", text.scrub("content"))


def evidence(events: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:  # noqa: B008
    """The first max_evidence observations of a known kind in each trajectory, and how many were skipped.

    traj_id, source_action_index, observation_index, kind, tool_or_command_class, path,
    excluded_from_rendered_text, excerpt, sha256, truncated, skipped.
    """
    o = _observations(events)
    kind = classify.observation_kind(F.col("prev_class_"), F.col("prev_function"), F.col("prev_language"), F.col("prev___cls"))
    o = o.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (text.strip(F.col("clean")) != ""))
    w = Window.partitionBy("traj_id")
    o = o.withColumn("n", F.row_number().over(w.orderBy("idx"))).withColumn("skipped", F.greatest(F.count("*").over(w) - cfg.max_evidence, F.lit(0)))
    api, cut = F.col("prev_class_") == "api_action", text.truncate(F.col("clean"), cfg.max_observation_excerpt_chars)
    hidden = (api & (classify.path_class(F.col("prev___path"), "memory") == "submission_artifact")) | classify.is_noise(F.col("clean"), "memory")
    return o.filter(F.col("n") <= cfg.max_evidence).select(
        "traj_id", F.col("prev_idx").alias("source_action_index"), F.col("idx").alias("observation_index"), "kind",
        F.when(api, F.coalesce("prev_function", F.lit(""))).otherwise(F.coalesce("prev___cls", F.lit("bash"))).alias("tool_or_command_class"), F.col("prev___path").alias("path"),
        hidden.alias("excluded_from_rendered_text"), cut["text"].alias("excerpt"), text.sha(F.col("clean")).alias("sha256"), cut["truncated"].alias("truncated"), "skipped",
    )


def failures(events: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:  # noqa: B008
    """Distinct failure lines by bucket, each where it came first, at most max_failures in a trajectory.

    traj_id, observation_index, line_no, source_action_index (-1 without an action), bucket, line, rule, skipped.
    """
    o = _observations(events).withColumn("bucket", classify.failure_bucket(F.col("prev_class_"), F.col("prev_function"), F.col("prev___cls")))
    lines = o.select("traj_id", "idx", F.coalesce("prev_idx", F.lit(-1)).alias("source_action_index"), "bucket", F.posexplode(F.split("clean", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", text.strip(F.col("line"))).withColumn("rule", text.failure_rule(F.col("line"))).filter("rule is not null")
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("traj_id", "bucket", "line").orderBy("idx", "line_no"))).filter("n = 1")
    w = Window.partitionBy("traj_id")
    first = first.withColumn("n", F.row_number().over(w.orderBy("idx", "line_no"))).withColumn("skipped", F.greatest(F.count("*").over(w) - cfg.max_failures, F.lit(0)))
    return first.filter(F.col("n") <= cfg.max_failures).select("traj_id", F.col("idx").alias("observation_index"), "line_no", "source_action_index", "bucket", "line", "rule", "skipped")


def files(touches: DataFrame) -> DataFrame:
    """Per trajectory and path: its uses, in the order they came first.

    touches: traj_id, path, raw_path, action, action_index. Gives traj_id, path, raw_paths, actions,
    action_counts, count, first_action_index. Empty paths and the workspace's root are left out.
    """
    t = touches.filter((F.col("path") != "") & ~classify.is_root(F.col("path")))
    by_action = t.groupBy("traj_id", "path", "action").agg(F.count("*").alias("n"), F.min("action_index").alias("first"))
    actions = by_action.groupBy("traj_id", "path").agg(F.array_sort(F.collect_list(F.struct("first", "action", "n"))).alias("a"), F.sum("n").alias("count"), F.min("first").alias("first_action_index"))
    raw = t.filter("raw_path <> ''").groupBy("traj_id", "path", "raw_path").agg(F.min("action_index").alias("first"))
    raw = raw.groupBy("traj_id", "path").agg(F.array_sort(F.collect_list(F.struct("first", "raw_path"))).alias("r"))
    out = actions.join(raw, ["traj_id", "path"], "left")
    return out.select(
        "traj_id", "path", F.coalesce(F.transform("r", lambda x: x["raw_path"]), F.array().cast("array<string>")).alias("raw_paths"), F.transform("a", lambda x: x["action"]).alias("actions"),
        F.map_from_entries(F.transform("a", lambda x: F.struct(x["action"], x["n"]))).alias("action_counts"), "count", "first_action_index",
    )


def inspected(events: DataFrame) -> DataFrame:
    p = paths(events).filter(F.col("function").isin(*rules.INSPECT_TOOLS))
    return files(p.select("traj_id", "path", "raw_path", F.col("function").alias("action"), F.col("idx").alias("action_index")))


def edited(events: DataFrame) -> DataFrame:
    p = paths(events).filter(F.col("function").isin(*rules.EDIT_TOOLS))
    out = files(p.select("traj_id", "path", "raw_path", F.col("function").alias("action"), F.col("idx").alias("action_index")))
    return out.withColumn("edit_category", classify.path_class(F.col("path"), "memory"))


def anchors(events: DataFrame) -> DataFrame:
    """Searches: traj_id, action_index, tool, pattern, path, raw_path (of the argument `path`), glob, prior_agent_description; a Glob's pattern is its glob."""
    p = events.filter("class_ = 'api_action' and function in ('Grep', 'Glob')")
    glob = F.col("function") == "Glob"
    pattern, where = (F.coalesce(argument(a), F.lit("")) for a in ("pattern", "path"))
    return p.select(
        "traj_id", F.col("idx").alias("action_index"), F.col("function").alias("tool"), F.when(glob, "").otherwise(text.normalize(pattern)).alias("pattern"),
        F.when(text.strip(where) == "", "").otherwise(classify.normalize_path(where)).alias("path"), text.normalize(where).alias("raw_path"),
        text.normalize(F.when(glob, pattern).otherwise(F.coalesce(argument("glob"), F.lit("")))).alias("glob"), short_description().alias("prior_agent_description"),
    )


def edits(events: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:  # noqa: B008
    """One row per edit, a MultiEdit's with their subedit_index: hashes and excerpts of the old and the new text."""
    p = paths(events).filter(F.col("function").isin(*rules.EDIT_TOOLS))
    pair = "array<struct<old_string:string,new_string:string>>"
    one = F.array(F.struct(F.coalesce(argument("old_string"), F.lit("")).alias("old_string"), F.coalesce(argument("new_string"), F.lit("")).alias("new_string")))
    write = F.array(F.struct(F.lit("").alias("old_string"), F.coalesce(argument("content"), F.lit("")).alias("new_string")))
    many = F.expr(f"try_variant_get(try_parse_json(kwargs_json), '$.edits', '{pair}')")
    p = p.withColumn("subs", F.when(F.col("function") == "Edit", one).when(F.col("function") == "Write", write).otherwise(many))
    p = p.select("*", F.posexplode("subs").alias("sub", "pair")).filter("pair is not null").withColumns({"old": text.scrub("pair.old_string"), "new": text.scrub("pair.new_string")})
    excerpt = lambda c: F.lit("") if cfg.hashes_only else F.left(F.col(c), F.lit(cfg.max_edit_excerpt_chars))
    cut = lambda c: F.lit(False) if cfg.hashes_only else F.char_length(c) > cfg.max_edit_excerpt_chars
    digest = lambda c: F.when(F.col(c) != "", text.sha(F.col(c))).otherwise("")
    p = p.withColumn("edit_category", classify.path_class(F.col("path"), "memory"))
    return p.select(
        "traj_id", F.col("idx").alias("action_index"), F.when(F.col("function") == "MultiEdit", F.col("sub")).alias("subedit_index"), F.col("function").alias("tool"), "path", "raw_path", "edit_category",
        looked_up("edit_category", EDIT_BUCKETS).alias("bucket"), short_description().alias("prior_agent_description"), digest("old").alias("old_text_sha256"), digest("new").alias("new_text_sha256"),
        excerpt("old").alias("old_text_excerpt"), excerpt("new").alias("new_text_excerpt"), (cut("old") | cut("new")).alias("truncated"),
    )


def final_message(events: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:  # noqa: B008
    """traj_id, text, sha256, truncated of the last message, though it be empty once scrubbed."""
    m = events.filter("class_ = 'message_action'").groupBy("traj_id").agg(F.max_by("content", "idx").alias("content")).withColumn("raw", text.scrub("content"))
    cut = text.truncate(F.col("raw"), cfg.max_final_message_chars)
    return m.select("traj_id", cut["text"].alias("text"), text.sha(F.col("raw")).alias("sha256"), cut["truncated"].alias("truncated"))


def budgeted_commands(cmds: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:  # noqa: B008
    """The command lines of the rendered memory: traj_id, action_index, line, cut.

    In order, without noise and left-out buckets: at most max_rendered_commands lines and
    max_rendered_command_total_chars characters, the line that reaches the budget cut to fit. A line
    is in if the lines before it leave room, so a running sum decides.
    """
    labels = {"test_commands": "test", "diagnostic_commands": "diagnostic", "other_commands": "other/reproduction"}
    if not cfg.exclude_build_install_commands:
        labels["build_install_commands"] = "build/install"
    if not cfg.exclude_setup_commands:
        labels["setup_commands"] = "setup"
    if not cfg.exclude_destructive_commands:
        labels["destructive_commands"] = "destructive"
    c = cmds.filter(F.col("bucket").isin(*labels)).filter(~classify.is_git_state(F.col("command"), "memory") & ~classify.is_probe(F.col("command"), "memory"))
    shown = text.truncate(text.scrub("command"), cfg.max_rendered_command_chars)
    c = c.withColumn("shown", shown).withColumn("line", F.concat(F.lit("- ["), looked_up("bucket", labels), F.lit("] "), F.col("shown.text")))
    w = Window.partitionBy("traj_id").orderBy("action_index")
    c = c.withColumns({"n": F.row_number().over(w), "start": F.coalesce(F.sum(F.char_length("line")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    most = cfg.max_rendered_command_total_chars
    c = c.filter((F.col("n") <= cfg.max_rendered_commands) & (F.col("start") < most))
    over = F.col("start") + F.char_length("line") > most
    return c.select("traj_id", "action_index", F.expr(f"left(line, cast({most} - start as int))").alias("line"), (over | F.col("shown.truncated") | F.col("truncated")).alias("cut"))


def problem(events: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:  # noqa: B008
    """traj_id, instance_id, repo, base_commit, problem_statement (capped), truncated: from the first user prompt, the whole of it without a labelled statement."""
    from .strip import first_user_prompt

    p = first_user_prompt(events).withColumn("meta", text.issue_metadata(F.col("prompt")))
    cut = text.truncate(F.coalesce("meta.problem_statement", "prompt"), cfg.max_problem_chars)
    return p.select("traj_id", "meta.instance_id", "meta.repo", "meta.base_commit", cut["text"].alias("problem_statement"), cut["truncated"].alias("truncated"))
