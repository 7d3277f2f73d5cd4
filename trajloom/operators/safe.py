"""Stripped trajectories made safe to put into prompts: capped texts, hashed edits, and the rendered text; memories cut by a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, json_udf, rules, text
from .events import argument
from .render import WARNING, lines_by, quoted

MAX_OBSERVATION, MAX_ACTION = 2000, 2000
POLICY_VERSION = "1.2.0"
#: Opening lines of a rendered trajectory and of a stripped memory (fixed values).
TRAJECTORY_HEAD = "STRIPPED ADP TRAJECTORY\nThis is the capped/rendered ADP representation for injection. Full stripped_adp.audit.jsonl is audit-only."
MEMORY_HEAD = "PRIOR EXPERIENCE MEMORY\nThis is deterministic evidence from a previous stripped trajectory. Use as context only."
#: A memory whose parts name the places of the events they come from.
MEMORY = """source_trajectory_id string, source_metadata struct<repo:string,instance_id:string,base_commit:string>,
prior_problem struct<problem_statement:string,raw_user_prompt:string,sha256:string,raw_user_prompt_sha256:string,raw_user_prompt_truncated:boolean>,
files struct<inspected:array<struct<path:string,first_action_index:int>>,edited:array<struct<path:string,first_action_index:int>>>,
search_anchors array<struct<action_index:int,tool:string,pattern:string,path:string,glob:string>>,
commands map<string,array<struct<action_index:int,command_class:string,command:string>>>,
observed_failures map<string,array<struct<observation_index:int,source_action_index:int,line:string>>>,
observation_evidence array<struct<source_action_index:int,observation_index:int,kind:string,excerpt:string>>,
edits map<string,array<struct<action_index:int,path:string,old_text_sha256:string,new_text_sha256:string,old_text_excerpt:string,new_text_excerpt:string>>>,
planning_actions array<string>, reasoning array<string>, prior_agent_final_message struct<text:string,sha256:string,truncated:boolean,included_in_rendered_text:boolean,stripped:boolean>"""


def hashed_arguments(fn: Column, kwargs: Column) -> Column:
    """Arguments with the bodies of edits as digests; those of other tools as they are."""
    out = kwargs
    for t in rules.EDIT_TOOLS:
        out = F.when(fn == t, json_udf.edit_hashes(F.when(fn == t, kwargs), t)).otherwise(out)
    return out


def injection_safe(events: DataFrame, max_observation: int = MAX_OBSERVATION, max_action: int = MAX_ACTION) -> DataFrame:
    """events with texts cut to their caps and edits hashed; adds content_sha256, content_truncated, kwargs_sha256, kwargs_truncated, edit_body_mode.

    Arguments of other tools whose indented JSON is over the cap are replaced by its digest alone.
    """
    cls, fn = F.col("class_"), F.coalesce("function", F.lit(""))
    whole = text.scrub("content")
    most = F.when(cls == "text_observation", max_observation).otherwise(max_action)
    said = cls.isin("text_observation", "code_action", "message_action")
    edit = (cls == "api_action") & fn.isin(*rules.EDIT_TOOLS)
    other = (cls == "api_action") & ~edit
    e = events.withColumns({"__whole": F.when(said, whole), "__pretty": json_udf.scrub_pretty(F.when(other, F.coalesce("kwargs_json", F.lit("{}"))))})
    long = other & (F.char_length("__pretty") > max_action)
    sha = text.sha(F.col("__pretty"))
    kwargs = F.when(edit, json_udf.scrub_values(hashed_arguments(fn, F.when(edit, F.coalesce("kwargs_json", F.lit("{}")))))).when(long, F.concat(F.lit('{"truncated_payload_sha256":"'), sha, F.lit('"}'))).when(other, json_udf.scrub_values(F.when(other, F.coalesce("kwargs_json", F.lit("{}")))))
    return e.withColumns({
        "content": F.when(said, F.expr("left(__whole, {})".format(f"if(class_ = 'text_observation', {max_observation}, {max_action})"))).otherwise(F.col("content")),
        "content_sha256": F.when(said, text.sha(F.col("__whole"))),
        "content_truncated": F.when(said, F.char_length("__whole") > most),
        "kwargs_json": F.coalesce(kwargs, "kwargs_json"),
        "kwargs_sha256": F.when(long, sha),
        "kwargs_truncated": F.when(other, long),
        "edit_body_mode": F.when(edit, "hashes-only"),
    }).drop("__whole", "__pretty")


def injection_text(events: DataFrame, meta: DataFrame, max_observation: int = MAX_OBSERVATION, max_action: int = MAX_ACTION) -> DataFrame:
    """traj_id, rendered_text of stripped events (idx, original_idx) under a head with repo, instance_id and base_commit.

    meta: traj_id, repo, instance_id, base_commit. An action's digest is of its event's canonical JSON.
    """
    cls, fn = F.col("class_"), F.coalesce("function", F.lit(""))
    api, obs = cls == "api_action", cls == "text_observation"
    action = cls.isin("api_action", "code_action", "message_action")
    item = F.to_json(F.struct("class_", "content", "description", "function", "kwargs_json", "language", "name", "source"))
    e = events.withColumns({
        "__said": text.scrub(F.coalesce("content", F.lit(""))),
        "__payload": json_udf.scrub_pretty(F.when(api, hashed_arguments(fn, F.coalesce("kwargs_json", F.lit("{}"))))),
        "__path": F.when(api, classify.primary_path(fn, argument("file_path"), argument("path"), argument("notebook_path"))),
    })
    body = F.when(api, F.col("__payload")).when(action | obs, F.col("__said")).otherwise(json_udf.scrub_pretty(F.when(~action & ~obs, item)))
    e = e.withColumns({"__body": body, "__most": F.when(obs, max_observation).otherwise(max_action)})
    place = F.concat(F.lit("current="), F.col("idx").cast("string"), F.coalesce(F.concat(F.lit(" original="), F.col("original_idx").cast("string")), F.lit("")))
    label = F.when(api, F.concat(F.lit("api_action "), fn)).when(cls == "code_action", F.concat(F.lit("code_action "), F.coalesce("language", F.lit("")))).otherwise("message_action")
    excerpt, truncated = F.expr("left(__body, __most)"), F.when(F.char_length("__body") > F.col("__most"), "true").otherwise("false")
    name = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("name: "), text.scrub("name")))
    path = F.when(F.col("__path") != "", F.concat(F.lit("path: "), text.scrub("__path")))
    line = (
        F.when(obs, F.concat_ws("\n", F.lit(""), F.concat(F.lit("[ADP OBSERVATION "), place, F.lit(" source="), F.coalesce("source", F.lit("")), F.lit("]")), name, F.lit("excerpt:"), excerpt, F.concat(F.lit("sha256: "), text.sha(F.col("__said"))), F.concat(F.lit("truncated: "), truncated)))
        .when(action, F.concat_ws("\n", F.lit(""), F.concat(F.lit("[ADP ACTION "), place, F.lit(": "), label, F.lit("]")), path, F.lit("payload:"), excerpt, F.concat(F.lit("sha256: "), text.sha(item)), F.concat(F.lit("truncated: "), truncated)))
        .otherwise(F.concat_ws("\n", F.lit(""), F.concat(F.lit("[ADP ITEM "), place, F.lit(": "), F.coalesce(cls, F.lit("")), F.lit("]")), excerpt, F.concat(F.lit("truncated: "), truncated)))
    )
    own = lambda c: F.concat(F.lit(f"- {c}: "), F.coalesce(c, F.lit("")))
    head = F.concat_ws("\n", F.lit(TRAJECTORY_HEAD), F.lit("\nSOURCE\n------"), F.concat(F.lit("- trajectory_id: "), "traj_id"), own("repo"), own("instance_id"), own("base_commit"))
    out = meta.select("traj_id", head.alias("head")).join(lines_by(e, "body", line, "idx"), "traj_id", "left")
    whole = text.scrub(F.concat_ws("\n", "head", "body"))
    return out.select("traj_id", F.concat(F.regexp_replace(whole, rf"(?U){text.SPACE}+\z", ""), F.lit("\n")).alias("rendered_text"))


def kept_places(decisions: DataFrame) -> DataFrame:
    """traj_id, keep, keep_seen: places of kept events, and of the observations among them."""
    kept = F.col("decision") == "keep"
    return decisions.groupBy("traj_id").agg(F.collect_set(F.when(kept, F.col("idx"))).alias("keep"), F.collect_set(F.when(kept & (F.col("class_") == "text_observation"), F.col("idx"))).alias("keep_seen"))


def strip_memory(memories: DataFrame, decisions: DataFrame, hashes_only: bool = True) -> DataFrame:
    """memories (columns MEMORY) cut down to what decisions (traj_id, idx, class_, decision) keep, with rendered_text and strip_error.

    Parts without any place go, since nothing ties them to a kept event. Scratch edits, submission
    artifacts, plans, reasoning and the final message always go. A memory without decisions stays as it is and says so in strip_error.
    """
    m = memories.join(kept_places(decisions).withColumnRenamed("traj_id", "source_trajectory_id"), "source_trajectory_id", "left")
    ok = lambda i, places: i.isNull() | F.array_contains(F.coalesce(places, F.array().cast("array<int>")), i)
    fields = {
        "search_anchors": ("action_index",), "commands": ("action_index",), "observed_failures": ("source_action_index", "observation_index"),
        "observation_evidence": ("source_action_index", "observation_index"), "edits": ("action_index",),
    }

    def kept(items: Column, column: str) -> Column:
        def good(x: Column) -> Column:
            known, fine = F.lit(False), F.lit(True)
            for f in fields[column]:
                known, fine = known | x[f].isNotNull(), fine & ok(x[f], F.col("keep_seen" if f == "observation_index" else "keep"))
            return known & fine

        return F.filter(items, good)

    def clean(items: Column, **changed) -> Column:
        """The items with changed fields; changed: field=function of its value."""
        return F.transform(items, lambda x: reduce(lambda y, c: y.withField(c[0], c[1](x[c[0]])), changed.items(), x))

    scrub = lambda c: F.when(c.isNotNull(), text.scrub(c))
    stated = text.scrub("prior_problem.problem_statement")
    sha = F.when(stated != "", text.sha(stated)).otherwise("")
    problem = F.when(F.col("prior_problem").isNotNull(), F.struct(stated.alias("problem_statement"), stated.alias("raw_user_prompt"), sha.alias("sha256"), sha.alias("raw_user_prompt_sha256"), F.lit(False).alias("raw_user_prompt_truncated")))
    body = (lambda c: F.lit("")) if hashes_only else scrub
    gone = lambda k: k.isin("scratch_edits", "submission_artifacts")
    edits = F.transform_values("edits", lambda k, v: clean(F.filter(kept(v, "edits"), lambda x: ~gone(k)), path=scrub, old_text_excerpt=body, new_text_excerpt=body))
    rows = lambda c: F.filter(F.col(f"files.{c}"), lambda r: ~classify.path_class(r["path"]).isin("submission_artifact", "harness", "scratch", "workspace_root") & ok(r["first_action_index"], F.col("keep")))
    final = F.when(F.col("prior_agent_final_message").isNotNull(), F.struct(F.lit("").alias("text"), F.coalesce("prior_agent_final_message.sha256", F.lit("")).alias("sha256"), F.lit(False).alias("truncated"), F.lit(False).alias("included_in_rendered_text"), F.lit(True).alias("stripped")))
    none = F.array().cast("array<string>")
    new = {
        "prior_problem": problem,
        "search_anchors": clean(kept(F.col("search_anchors"), "search_anchors"), pattern=scrub, path=scrub, glob=scrub),
        "commands": F.transform_values("commands", lambda k, v: clean(kept(v, "commands"), command=scrub)),
        "observed_failures": F.transform_values("observed_failures", lambda k, v: clean(kept(v, "observed_failures"), line=scrub)),
        "observation_evidence": clean(kept(F.col("observation_evidence"), "observation_evidence"), excerpt=scrub),
        "edits": edits,
        "files": F.when(F.col("files").isNotNull(), F.struct(rows("inspected").alias("inspected"), rows("edited").alias("edited"))),
        "planning_actions": none,
        "reasoning": none,
        "prior_agent_final_message": final,
    }
    found = F.col("keep").isNotNull()
    m = m.withColumns({c: F.when(found, v).otherwise(F.col(c)) for c, v in new.items()})
    error = F.when(~found, F.concat(F.lit("No manifest found for source_trajectory_id="), quoted(F.coalesce("source_trajectory_id", F.lit("")))))
    m = m.withColumns({"strip_policy_version": F.lit(POLICY_VERSION), "strip_error": error})
    return m.withColumn("rendered_text", F.when(found, memory_text())).drop("keep", "keep_seen")


def memory_text() -> Column:
    """The rendered text of a stripped memory's columns."""
    texts = lambda items, f: F.transform(items, f)
    section = lambda title, lines: F.concat(F.lit(f"\n{title}\n{'-' * len(title)}\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(none)"))
    own = lambda c: F.concat(F.lit(f"- {c}: "), F.coalesce(f"source_metadata.{c}", F.lit("")))
    source = F.concat_ws("\n", F.lit("\nSOURCE\n------"), F.concat(F.lit("- trajectory_id: "), F.coalesce("source_trajectory_id", F.lit(""))), own("repo"), own("instance_id"), own("base_commit"))
    some = lambda c, label: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" {label}="), quoted(c))).otherwise("")

    def of(column: str, *buckets: str) -> Column:
        kind = {"commands": "struct<action_index:int,command_class:string,command:string>", "observed_failures": "struct<observation_index:int,source_action_index:int,line:string>"}.get(column)
        kind = kind or "struct<action_index:int,path:string,old_text_sha256:string,new_text_sha256:string,old_text_excerpt:string,new_text_excerpt:string>"
        empty = F.array().cast(f"array<{kind}>")
        return F.flatten(F.array(*(F.coalesce(F.try_element_at(F.col(column), F.lit(b)), empty) for b in buckets)))

    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    commands = F.flatten(F.array(*(F.transform(of("commands", b), lambda x, b=b: F.concat(F.lit("- ["), F.coalesce(x["command_class"], F.lit(b)), F.lit("] "), text.scrub(x["command"]))) for b in ("test_commands", "diagnostic_commands", "other_commands"))))
    indented = lambda c, by: F.when(text.scrub(c) == "", F.lit(by.rstrip())).otherwise(F.regexp_replace(text.scrub(c), r"(?m)^", by))
    evidence = texts(F.col("observation_evidence"), lambda x: F.concat(F.lit("- ["), F.coalesce(x["kind"], F.lit("observation")), F.lit(" after action #"), number(x["source_action_index"]), F.lit("]\n"), indented(x["excerpt"], "  ")))
    digest = lambda x, c: F.when(F.coalesce(x[c], F.lit("")) != "", F.concat(F.lit(f"\n  {c}: "), x[c])).otherwise("")
    excerpt = lambda x, c: F.when(F.coalesce(x[c], F.lit("")) != "", F.concat(F.lit(f"\n  {c}:\n"), indented(x[c], "    "))).otherwise("")
    edits = texts(of("edits", "source_edits", "test_edits", "other_edits"), lambda x: F.concat(F.lit("- "), text.scrub(x["path"]), digest(x, "old_text_sha256"), digest(x, "new_text_sha256"), excerpt(x, "old_text_excerpt"), excerpt(x, "new_text_excerpt")))
    anchors = texts(F.col("search_anchors"), lambda x: F.concat(F.lit("- ["), number(x["action_index"]), F.lit("] "), F.coalesce(x["tool"], F.lit("")), some(x["pattern"], "pattern"), some(x["path"], "path"), some(x["glob"], "glob")))
    stated = text.scrub("prior_problem.problem_statement")
    whole = F.concat_ws(
        "\n", F.lit(MEMORY_HEAD), source, F.concat(F.lit("\nPRIOR PROBLEM\n-------------\n"), F.when(stated == "", "(not found)").otherwise(stated)),
        section("FILES INSPECTED", F.transform(F.col("files.inspected"), lambda r: F.concat(F.lit("- "), F.coalesce(r["path"], F.lit(""))))), section("SEARCH ANCHORS", anchors), section("TEST / DIAGNOSTIC / OTHER COMMANDS", commands),
        section("OBSERVED TEST / RUNTIME FAILURES", texts(of("observed_failures", "test_failures", "runtime_failures", "other_failures"), lambda x: F.concat(F.lit("- "), text.scrub(x["line"])))),
        section("RELEVANT OBSERVATION EXCERPTS", evidence), section("SOURCE EDIT EVIDENCE", edits), F.lit(f"\nINJECTION WARNING\n-----------------\n{WARNING}"),
    )
    return text.scrub(whole)
