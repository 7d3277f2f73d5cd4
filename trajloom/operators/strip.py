"""Keep or drop each event, with reasons, then clean and re-index what is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, json_udf, rules, shared, text
from .events import argument, in_order, with_previous_action


@dataclass(frozen=True)
class StripConfig:
    include_final_message: bool = False
    include_todowrite: bool = False
    keep_reasoning_content: bool = False
    keep_additional_user_messages: bool = False
    normalize_user_prompt: bool = True
    drop_scratch_reads: bool = True
    drop_destructive_commands: bool = True
    drop_setup_commands: bool = True
    drop_build_install_commands: bool = True
    drop_action_descriptions: bool = True


def decide_alone(events: DataFrame, cfg: StripConfig) -> DataFrame:
    """Add reason, path, path_class and command_class: what each event says by itself.

    A reason starts with keep. or drop. and is the first that holds. __clean, the scrubbed content, stays for decide().
    """
    cls, fn = F.col("class_"), F.coalesce("function", F.lit(""))
    e = events.withColumns({"path": classify.primary_path(fn, argument("file_path"), argument("path"), argument("notebook_path")), "__clean": text.scrub("content")})
    e = e.withColumns({"path_class": classify.path_class(F.col("path")), "command_class": F.when((cls == "code_action") & (F.col("language") == "bash"), classify.command_class(F.col("content")))})
    clean, kw = F.col("__clean"), F.coalesce("kwargs_json", F.lit("{}"))
    env = (cls == "text_observation") & (F.col("source") == "environment")
    seen = F.when(F.col("command_class").isNotNull() & (clean == F.col("content")), F.col("command_class")).otherwise(classify.command_class(clean))
    bash, api = (cls == "code_action") & (F.col("language") == "bash"), cls == "api_action"
    kind = F.col("path_class")
    noisy = [("submission_artifact", True), ("harness", True), ("patch_dump_or_staging", True), ("diagnostic_environment_noise", True), ("destructive", cfg.drop_destructive_commands), ("setup", cfg.drop_setup_commands), ("build_install", cfg.drop_build_install_commands)]
    table = [
        ("drop.empty_environment_observation", env & (text.strip(clean) == "")),
        ("drop.todo_observation", env & (F.coalesce("name", F.lit("")).contains("TodoWrite") | clean.contains("Todos have been modified"))),
        ("drop.hard_forbidden_environment_payload", env & text.forbidden(clean)),
        ("keep.user_issue_prompt", (cls == "text_observation") & (F.col("source") == "user")),
        ("keep.text_observation", cls == "text_observation"),
        ("keep.final_message_explicitly_included" if cfg.include_final_message else "drop.final_message_default_off", cls == "message_action"),
        ("keep.todowrite_explicitly_included" if cfg.include_todowrite else "drop.todowrite", api & fn.isin(*rules.PLANNING_TOOLS)),
        ("drop.submission_payload", api & text.forbidden(kw) & classify.holds_any(kw, rules.ARTIFACT_TEXT)),
        ("drop.harness_payload", api & text.forbidden(kw)),
        ("drop.submission_artifact_path", api & (kind == "submission_artifact")),
        ("drop.harness_path", api & (kind == "harness")),
        ("drop.scratch_file_body", api & (kind == "scratch") & fn.isin(*rules.EDIT_TOOLS)),
        *([("drop.scratch_file_read", api & (kind == "scratch"))] if cfg.drop_scratch_reads else []),
        *((f"keep.{t.lower()}_evidence", api & (fn == t)) for t in rules.INSPECT_TOOLS),
        ("keep.edit_evidence", api & fn.isin(*rules.EDIT_TOOLS)),
        ("keep.api_action", api),
        ("drop.patch_payload_command", bash & classify.is_patch_payload(clean)),
        *((f"drop.{c}_command", bash & (F.col("__seen") == c)) for c, dropped in noisy if dropped),
        ("keep.diagnostic_command", bash & (F.col("__seen") == "diagnostic")),
        ("keep.test_command", bash & (F.col("__seen") == "test")),
        ("keep.other_command", bash),
        ("keep.code_action", cls == "code_action"),
    ]
    e = e.withColumn("__seen", F.when(bash, seen))
    return e.withColumn("reason", classify.chain(table, "keep.unknown_item_class")).drop("__seen")


def decide(events: DataFrame, cfg: StripConfig = StripConfig()) -> DataFrame:  # noqa: B008
    """events with path, path_class, command_class, reason_codes array<string>, decision and new_idx (place among the kept, null if dropped).

    Three passes, in one shuffle by trajectory: each event alone; an environment observation after
    the nearest action before it (dropped with it, or an edit tool's echo, or noise); then of the user's kept
    messages all but the first. The second pass replaces earlier reasons, also that reasoning was removed.
    """
    e = with_previous_action(decide_alone(events, cfg), "idx", "reason", "class_", "function")
    env = (F.col("class_") == "text_observation") & (F.col("source") == "environment")
    over = classify.chain(
        [
            ("drop.observation_after_dropped_action", env & F.col("prev_reason").startswith("drop.")),
            ("drop.edit_tool_result_snippet", env & (F.col("prev_class_") == "api_action") & F.col("prev_function").isin(*rules.EDIT_TOOLS)),
            ("drop.environment_observation_noise", env & classify.is_noise(F.col("__clean"))),
        ],
        None,
    )
    e = e.withColumn("__over", over).withColumn("__now", F.coalesce("__over", "reason"))
    if cfg.normalize_user_prompt and not cfg.keep_additional_user_messages:
        user = (F.col("class_") == "text_observation") & (F.col("source") == "user") & F.col("__now").startswith("keep.")
        nth = F.sum(user.cast("int")).over(in_order())
        e = e.withColumn("__over", F.when(user & (nth > 1), F.lit("drop.additional_user_message_default_off")).otherwise(F.col("__over"))).withColumn("__now", F.coalesce("__over", "reason"))
    gone = (F.col("reasoning_content").isNotNull() & F.col("__over").isNull()) if not cfg.keep_reasoning_content else F.lit(False)
    codes = F.when(gone, F.array(F.lit("strip.reasoning_content_field_removed"), "__now")).otherwise(F.array("__now"))
    keep = F.col("__now").startswith("keep.")
    e = e.withColumn("decision", F.when(keep, "keep").otherwise("drop")).withColumn("reason_codes", codes)
    e = e.withColumn("new_idx", F.when(keep, F.sum(keep.cast("int")).over(in_order()) - 1))
    return e.drop("__clean", "__over", "__now", "reason", "prev_idx", "prev_reason", "prev_class_", "prev_function")


def stripped(decisions: DataFrame, cfg: StripConfig = StripConfig()) -> DataFrame:  # noqa: B008
    """The kept events, cleaned and re-indexed, with original_idx."""
    kept = decisions.filter("decision = 'keep'").withColumn("original_idx", F.col("idx")).withColumn("idx", F.col("new_idx").cast("int"))
    action = F.col("class_").isin("api_action", "code_action", "message_action")
    columns = {c: F.when(F.col(c).isNotNull(), text.scrub(F.col(c))) for c in ("content", "name")}
    columns["description"] = F.when(action & F.lit(cfg.drop_action_descriptions), F.lit(None).cast("string")).otherwise(F.when(F.col("description").isNotNull(), text.scrub("description")))
    # most arguments hold nothing to remove; the others' strings are scrubbed at every depth, keys left alone
    columns["kwargs_json"] = F.coalesce(json_udf.scrub_values(F.when(text.may_scrub(F.col("kwargs_json")), F.col("kwargs_json"))), F.col("kwargs_json"))
    if not cfg.keep_reasoning_content:
        columns["reasoning_content"] = F.lit(None).cast("string")
    return kept.withColumns(columns).drop("decision", "reason_codes", "new_idx", "path", "path_class", "command_class")


def reason_counts(decisions: DataFrame) -> DataFrame:
    """traj_id, decision, reason, n: of each trajectory, and with traj_id null of all together, by one set of grouping sets."""
    d = decisions.select("traj_id", "decision", F.explode("reason_codes").alias("reason"))
    return d.groupingSets([["traj_id", "decision", "reason"], ["decision", "reason"]], "traj_id", "decision", "reason").agg(F.count("*").alias("n"))


def manifest(decisions: DataFrame) -> DataFrame:
    """One row per trajectory: decisions in order, index_map, decision_counts and reason_counts (sorted maps)."""
    d = decisions.withColumn("item_sha256", text.sha(F.to_json(F.struct("class_", "source", "name", "content", "language", "function", "kwargs_json", "description"))))
    rows = d.groupBy("traj_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "class_", "decision", "reason_codes", "item_sha256", "command_class", "path", "path_class", "provenance"))).alias("decisions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("new_idx").isNotNull(), F.struct("idx", "new_idx"))))).alias("index_map"),
    )

    def counted(values: Column) -> Column:
        """The labels' counts, from the collected rows: labels are few, so this takes no shuffle of its own."""
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)))))

    reasons = F.flatten(F.transform("decisions", lambda x: x["reason_codes"]))
    return rows.withColumns({"decision_counts": counted(F.transform("decisions", lambda x: x["decision"])), "reason_counts": counted(reasons)})


def filter_evidence(evidence: DataFrame, decisions: DataFrame, action: str = "source_action_index", observation: str = "observation_index") -> DataFrame:
    """Evidence rows whose action and observation were kept; rows without the indices are dropped."""
    kept = decisions.filter("decision = 'keep'").select("traj_id", "idx")
    out = evidence.join(kept.withColumnRenamed("idx", action), ["traj_id", action], "left_semi")
    return out.join(kept.withColumnRenamed("idx", observation), ["traj_id", observation], "left_semi")


def first_user_prompt(events: DataFrame) -> DataFrame:
    """traj_id, prompt: the first user text that isn't blank once scrubbed."""
    e = events.filter("class_ = 'text_observation' and source = 'user'").withColumn("clean", text.scrub("content")).filter(text.strip(F.col("clean")) != "")
    return e.groupBy("traj_id").agg(F.min_by("clean", "idx").alias("prompt"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add record_index, from 1 in the given order of whole records (their number, not their items)."""
    return shared.numbered(df, "record_index", *order, start=1)
