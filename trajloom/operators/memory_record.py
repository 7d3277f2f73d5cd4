"""Whole memory records: every part of a trajectory's memory, values with the warnings that say where they fell back, and error records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_udf, rules, text, variants
from . import adp, render
from . import memory as M
from .events import argument
from .strip import first_user_prompt

#: Fixed values of a record.
VERSION = "1.2.0"
FAILURE_BUCKETS = ("test_failures", "runtime_failures", "setup_failures", "install_failures", "other_failures")
FALLBACK, NO_PROBLEM = "prior_problem.problem_statement fell back to first user text_observation", "prior_problem.problem_statement is empty"
#: Records' names of settings, and ours, in order (fixed values).
FLAGS = {
    "template": "template", "include_todowrite": "include_todowrite", "include_reasoning": "include_reasoning", "max_problem_chars": "max_problem_chars",
    "max_raw_user_prompt_chars": "max_raw_user_prompt_chars", "max_final_message_chars": "max_final_message_chars", "max_edit_excerpt_chars": "max_edit_excerpt_chars",
    "edit_body_mode": "hashes_only", "max_command_chars": "max_command_chars", "max_observed_failure_lines": "max_failures",
    "max_observation_excerpt_chars": "max_observation_excerpt_chars", "max_observation_evidence_items": "max_evidence", "max_rendered_commands": "max_rendered_commands",
    "max_rendered_command_total_chars": "max_rendered_command_total_chars", "max_rendered_command_chars": "max_rendered_command_chars",
    "exclude_setup_commands": "exclude_setup_commands", "exclude_destructive_commands": "exclude_destructive_commands",
    "exclude_build_install_commands": "exclude_build_install_commands", "keep_excluded_edit_details": "keep_excluded_edit_details",
}


def flags(cfg: M.MemoryConfig) -> Column:
    """The settings that a record names, as a struct."""
    value = lambda ours: {True: "hashes-only", False: "excerpts"}[cfg.hashes_only] if ours == "hashes_only" else getattr(cfg, ours)
    return F.struct(*(F.lit(value(ours)).alias(name) for name, ours in FLAGS.items()))


def source_metadata(trajs: DataFrame, events: DataFrame, cfg: M.MemoryConfig = M.MemoryConfig()) -> DataFrame:  # noqa: B008
    """traj_id, source_metadata, prior_problem and source_warnings of each row of trajs (traj_id, details VARIANT, source_file).

    Each value falls back: the problem is the one that details.issue_metadata states, else the first user prompt, else missing; the
    source file is that of details, else the one read. A value is kept with the warnings about it: source_warnings are those of
    details.warnings, marked [source], then that of the problem.
    """
    d = F.col("details")
    inside = lambda name: F.when(variants.is_object(d), variants.field(d, name, "variant"))
    issue, models, warned = inside("issue_metadata"), inside("models"), inside("warnings")
    issue = F.when(variants.is_object(issue), issue)
    of = lambda name: text.normalize(F.coalesce(adp.word(issue, name), F.lit("")))
    items = lambda v: F.when(variants.kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    as_text = lambda x: F.when(variants.kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(variants.kind(x) == "VOID", "").otherwise(F.to_json(x))
    t = trajs.join(first_user_prompt(events), "traj_id", "left").select(
        "traj_id",
        F.struct(
            of("repo").alias("repo"), of("instance_id").alias("instance_id"), of("base_commit").alias("base_commit"),
            F.coalesce(text.normalize(F.get(F.transform(items(models), as_text), F.lit(0))), F.lit("")).alias("model"),
            text.normalize(F.coalesce(F.nullif(F.when(variants.is_object(d), adp.word(d, "source_file")), F.lit("")), F.col("source_file"))).alias("source_file"),
        ).alias("source_metadata"),
        text.scrub(adp.word(issue, "problem_statement")).alias("stated"),
        F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.coalesce(F.transform(items(warned), lambda x: F.concat(F.lit("[source] "), text.normalize(as_text(x)))), F.array().cast("array<string>")).alias("warned"),
    )
    t = t.withColumn("place", F.when(F.col("stated") != "", "issue_metadata.problem_statement").when(F.col("prompt") != "", "first_user_text_observation").otherwise("missing"))
    t = t.withColumn("whole", F.when(F.col("stated") != "", F.col("stated")).otherwise(F.col("prompt")))
    cut, raw = text.truncate(F.col("whole"), cfg.max_problem_chars), text.truncate(F.col("prompt"), cfg.max_raw_user_prompt_chars)
    about = F.when(F.col("place") == "missing", F.array(F.lit(NO_PROBLEM))).when(F.col("place") == "first_user_text_observation", F.array(F.lit(FALLBACK))).otherwise(F.array().cast("array<string>"))
    problem = F.struct(
        cut["text"].alias("problem_statement"), raw["text"].alias("raw_user_prompt"), F.col("place").alias("source"), text.sha(F.col("whole")).alias("sha256"),
        F.when(F.col("prompt") != "", text.sha(F.col("prompt"))).otherwise("").alias("raw_user_prompt_sha256"), cut["truncated"].alias("truncated"), raw["truncated"].alias("raw_user_prompt_truncated"),
    )
    return t.select("traj_id", "source_metadata", problem.alias("prior_problem"), F.concat("warned", about).alias("source_warnings"))


def event_warnings(events: DataFrame) -> DataFrame:
    """traj_id, warned (texts in order of the events), unknown: what events lack, and how many are of a class or function that no part of a memory takes."""
    p = M.paths(events)
    fn, at = F.coalesce("function", F.lit("")), F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "))
    subs = F.expr("try_variant_get(try_parse_json(kwargs_json), '$.edits', 'array<variant>')")
    none = F.coalesce(F.size(F.filter(subs, variants.is_object)), F.lit(0)) < 1
    plain = fn.isin(*rules.EDIT_TOOLS)
    said = F.array_compact(
        F.array(
            F.when((fn == "Read") & (F.col("path") == ""), F.concat(at, F.lit("Read action has no extractable file path"))),
            F.when(plain & (F.col("path") == ""), F.concat(at, fn, F.lit(" action has no extractable file path"))),
            F.when((fn == "MultiEdit") & none, F.concat(at, F.lit("MultiEdit has no extractable edits"))),
            F.when(fn == "", F.concat(at, F.lit("api_action has empty function"))),
        )
    )
    known = fn.isin("", "TodoWrite", *rules.INSPECT_TOOLS, *rules.EDIT_TOOLS)
    w = p.groupBy("traj_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", said.alias("said")))), lambda x: x["said"])).alias("warned"), F.count_if(~known).alias("functions"))
    cls = F.coalesce("class_", F.lit("?"))
    odd = events.groupBy("traj_id").agg(F.count_if(~cls.isin("", "api_action", "code_action", "text_observation", "message_action")).alias("classes"))
    out = odd.join(w, "traj_id", "left")
    return out.select("traj_id", F.coalesce("warned", F.array().cast("array<string>")).alias("warned"), (F.col("classes") + F.coalesce("functions", F.lit(0))).alias("unknown"))


def listed(df: DataFrame, name: str, fields: Sequence[Column | str], *order: str, bucket: str | None = None) -> DataFrame:
    """traj_id and one array of all rows' fields, in order; with a bucket an array of structs bucket, item. Maps are sorted as their entries, since they have no order."""
    names = {c for c in fields if isinstance(c, str)}
    maps = [n for n, t in df.dtypes if t.startswith("map") and n in names]
    entries = lambda c: F.map_entries(c).alias(c) if isinstance(c, str) and c in maps else c
    rows = df.select("traj_id", *(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), F.struct(*map(entries, fields)).alias("item"), *([F.col(bucket).alias("bucket")] if bucket else []))
    keyed = F.array_sort(F.collect_list(F.struct(*rows.columns[1:])))

    def item(x: Column) -> Column:
        own = reduce(lambda y, c: y.withField(c, F.map_from_entries(y[c])), maps, x["item"])
        return F.struct(x["bucket"].alias("bucket"), own.alias("item")) if bucket else own

    return rows.groupBy("traj_id").agg(F.transform(keyed, item).alias(name))


def bucketed(items: Column | str, buckets: Sequence[str]) -> Column:
    """A struct with an array for every bucket, also for those that have no items."""

    def of(bucket: str) -> Column:
        return F.transform(F.filter(items, lambda x: x["bucket"] == bucket), lambda x: x["item"]).alias(bucket)

    return F.struct(*map(of, buckets))


def records(trajs: DataFrame, events: DataFrame, cfg: M.MemoryConfig = M.MemoryConfig()) -> DataFrame:  # noqa: B008
    """One record for each row of trajs, its columns in the order of a memory's JSON: see record_json().

    trajs: traj_id (unique), schema_version, details VARIANT, source_sha256, content_sha256, source_file, error (see adp.trajectories).
    events: their events; with a column original_idx, entries carry the places that their events had before they were stripped.
    A trajectory with an error has an empty record that says so in its warnings. All parts are grouped by trajectory, so no part of
    the plan grows with more than one trajectory's events; a trajectory without events has empty parts.
    """
    e = events.filter("class_ is not null")
    stripped = "original_idx" in events.columns
    places = events.select("traj_id", "idx", "original_idx").filter("original_idx is not null") if stripped else None

    def part(df: DataFrame, of: dict[str, str]) -> tuple[DataFrame, list[str]]:
        """df with the original places of the events that columns name, and the names of the new columns."""
        if places is None:
            return df, []
        for column, name in of.items():
            df = df.join(places.select("traj_id", F.col("idx").alias(column), F.col("original_idx").alias(name)), ["traj_id", column], "left")
        return df, list(of.values())

    action, seen = {"action_index": "original_action_index"}, {"source_action_index": "original_action_index", "observation_index": "original_observation_index"}
    files = ("path", "raw_paths", "actions", "action_counts", "count", "first_action_index")
    parts = [
        listed(M.inspected(e), "inspected", files, "first_action_index", "path"),
        listed(M.edited(e), "edited", (*files, "edit_category"), "first_action_index", "path"),
    ]
    a, more = part(M.anchors(e), action)
    parts.append(listed(a, "search_anchors", ("action_index", "tool", "pattern", "path", "raw_path", "glob", "prior_agent_description", *more), "action_index"))
    c, more = part(M.commands(e, cfg), action)
    parts.append(listed(c, "__commands", ("action_index", "command_class", "command", "sha256", "truncated", "contains_heredoc", "prior_agent_description", *more), "action_index", bucket="bucket"))
    f, more = part(M.failures(e, cfg), seen)
    parts.append(listed(f, "__failures", ("observation_index", "source_action_index", "line", "rule", *more), "observation_index", "line_no", bucket="bucket"))
    v, more = part(M.evidence(e, cfg), seen)
    fields = ("source_action_index", "observation_index", "kind", "tool_or_command_class", "path", "excluded_from_rendered_text", "excerpt", "sha256", "truncated", *more)
    parts.append(listed(v, "observation_evidence", fields, "observation_index"))
    parts.append(v.groupBy("traj_id").agg(F.max("skipped").alias("__skipped")))
    d, more = part(M.edits(e, cfg).withColumn("sub", F.coalesce("subedit_index", F.lit(0))), action)
    fields = ("action_index", "tool", "path", "raw_path", "edit_category", "prior_agent_description", *more, "subedit_index", "old_text_sha256", "new_text_sha256", "old_text_excerpt", "new_text_excerpt", "truncated")
    parts.append(listed(d, "__edits", fields, "action_index", "sub", bucket="bucket"))
    payload = json_udf.canonical_json(F.coalesce("kwargs_json", F.lit("{}")))
    plans = e.filter("class_ = 'api_action' and function = 'TodoWrite'").select("traj_id", F.col("idx").alias("action_index"), F.col("function").alias("tool"), payload.alias("raw"), M.short_description().alias("prior_agent_description"))
    plans, more = part(plans.filter(F.lit(cfg.include_todowrite)), action)
    cut = text.truncate(F.col("raw"), cfg.max_planning_action_chars)
    parts.append(listed(plans, "planning_actions", ("action_index", "tool", cut["text"].alias("payload"), text.sha(F.col("raw")).alias("sha256"), cut["truncated"].alias("truncated"), "prior_agent_description", *more), "action_index"))
    thoughts = e.filter("reasoning_content is not null").select("traj_id", F.col("idx").alias("action_index"), F.col("class_").alias("item_class"), text.scrub("reasoning_content").alias("raw"))
    thoughts, more = part(thoughts.filter((F.col("raw") != "") & F.lit(cfg.include_reasoning)), action)
    cut = text.truncate(F.col("raw"), cfg.max_reasoning_chars)
    parts.append(listed(thoughts, "reasoning", ("action_index", "item_class", cut["text"].alias("text"), text.sha(F.col("raw")).alias("sha256"), cut["truncated"].alias("truncated"), *more), "action_index"))
    parts.append(M.final_message(e, cfg).select("traj_id", F.struct("text", "sha256", "truncated", (F.col("text") != "").alias("included_in_rendered_text")).alias("__final")))
    parts.append(event_warnings(events).withColumnRenamed("warned", "__warned"))
    parts.append(e.groupBy("traj_id").agg(F.max(F.col("reasoning_content").isNotNull()).alias("__thought"), F.max(F.coalesce((F.col("class_") == "api_action") & (F.col("function") == "TodoWrite"), F.lit(False))).alias("__planned")))
    meta = source_metadata(trajs, e, cfg)
    told = meta.select("traj_id", *(f"source_metadata.{c}" for c in ("repo", "instance_id", "base_commit", "model")), "prior_problem.problem_statement", "prior_problem.truncated")
    parts += [meta, render.memory_text(e, cfg, told)]
    lists = [n for p in parts for n, t in p.dtypes if n != "traj_id" and t.startswith("array")]
    kinds = {n: t for p in parts for n, t in p.dtypes}
    r = reduce(lambda x, y: x.join(y, "traj_id", "left"), parts, trajs.select("traj_id", "schema_version", "source_sha256", "content_sha256", "error"))
    r = r.withColumns({n: F.coalesce(n, F.array().cast(kinds[n])) for n in lists})
    return r.select(*_columns(r, cfg))


def _columns(r: DataFrame, cfg: M.MemoryConfig) -> list[Column]:
    good = F.col("error").isNull()
    number = lambda c: F.coalesce(c, F.lit(0))
    out = lambda bucket: F.size(F.filter("__edits", lambda x: x["bucket"] == bucket)).cast("long")
    unknown, skipped = number(F.col("unknown")), number(F.col("__skipped"))
    capped = (F.size("__failures") >= cfg.max_failures) & F.lit(cfg.max_failures > 0)
    late = F.array_compact(
        F.array(
            F.when(capped, F.lit(f"observed_failures capped at max_observed_failure_lines={cfg.max_failures}")),
            F.when(skipped > 0, F.concat(F.lit(f"observation_evidence capped at max_observation_evidence_items={cfg.max_evidence}; skipped="), skipped.cast("string"))),
            F.when(unknown > 0, F.concat(F.lit("Skipped "), unknown.cast("string"), F.lit(" unhandled item classes/functions"))),
        )
    )
    failed = F.array(F.concat(F.lit("CONVERTER ERROR: "), F.col("error")))
    shown = [b for b in M.EDIT_BUCKETS.values() if cfg.keep_excluded_edit_details or b not in ("scratch_edits", "submission_artifacts")]
    edits = F.filter("__edits", lambda x: x["bucket"].isin(*shown))
    if_good = lambda c, other: F.when(good, c).otherwise(other)
    bare = F.struct(F.lit("").alias("problem_statement"), F.lit("").alias("raw_user_prompt"), F.lit(None).cast("string").alias("source"), F.lit("").alias("sha256"), F.lit(None).cast("string").alias("raw_user_prompt_sha256"), F.lit(False).alias("truncated"), F.lit(None).cast("boolean").alias("raw_user_prompt_truncated"))
    none = F.struct(F.lit("").alias("text"), F.lit("").alias("sha256"), F.lit(False).alias("truncated"), F.lit(False).alias("included_in_rendered_text"))
    return [
        F.lit(VERSION).alias("memory_schema_version"),
        F.col("traj_id").alias("source_trajectory_id"),
        F.coalesce("schema_version", F.lit("")).alias("source_schema_version"),
        F.struct(F.lit("trajloom").alias("name"), F.lit(VERSION).alias("memory_schema_version"), F.lit(cfg.template).alias("template"), flags(cfg).alias("flags"), F.col("source_sha256").alias("source_trajectory_sha256"), F.col("content_sha256").alias("input_content_sha256")).alias("renderer"),
        F.when(good, F.col("source_metadata")).alias("source_metadata"),
        if_good(F.col("prior_problem"), bare).alias("prior_problem"),
        F.struct("inspected", "edited").alias("files"),
        F.col("search_anchors"),
        bucketed("__commands", list(M.COMMAND_BUCKETS.values())).alias("commands"),
        bucketed("__failures", FAILURE_BUCKETS).alias("observed_failures"),
        F.col("observation_evidence"),
        bucketed(edits, list(M.EDIT_BUCKETS.values())).alias("edits"),
        F.col("planning_actions"),
        F.col("reasoning"),
        F.coalesce("__final", none).alias("prior_agent_final_message"),
        if_good(F.coalesce("rendered_text", F.lit("")), F.lit("")).alias("rendered_text"),
        F.struct(
            if_good(F.concat("source_warnings", "__warned", late), failed).alias("warnings"),
            (F.coalesce("__thought", F.lit(False)) & F.lit(not cfg.include_reasoning)).alias("excluded_reasoning_content"),
            (F.coalesce("__planned", F.lit(False)) & F.lit(not cfg.include_todowrite)).alias("excluded_todowrite"),
            out("submission_artifacts").alias("excluded_submission_artifacts_count"),
            out("scratch_edits").alias("excluded_scratch_edits_count"),
            unknown.alias("unknown_type_count"),
        ).alias("quality"),
    ]


def record_json(records: DataFrame) -> DataFrame:
    """source_trajectory_id, json: each record as a line of JSON, members in order, optional ones left out where there are none."""
    return records.select("source_trajectory_id", F.to_json(F.struct(*records.columns)).alias("json"))
