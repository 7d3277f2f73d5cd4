"""Rendered texts: memory, stripped trajectories, transcripts and prompts, as ordered collections of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from . import memory as M

#: Opening lines of a memory, by template, and its closing warning (fixed values).
HEADERS = {
    "generic": "This is deterministic evidence from a previous trajectory on a related issue.\nDo not copy the old patch blindly. Verify everything in the current repository.",
    "swe-agent": "This is read-only prior trajectory evidence for SWE-Agent.\nDo not apply the old patch verbatim. Re-derive the fix in the current repository.",
    "openhands": "This is read-only prior trajectory evidence for OpenHands.\nUse it as context only; verify all behavior in the current workspace.",
}
WARNING = "This memory is from a prior related issue. Use it as evidence only. Do not copy patches blindly."
CUT = "[... truncated ...]"

CONDITIONS = ("no_memory", "raw", "adp", "memory")
#: What a prompt says about its prior context, by condition (fixed values).
CONTEXT_LABELS = {
    "no_memory": "No prior context is provided for this run.",
    "raw": "The following is a stripped raw transcript from an officially related prior issue.",
    "adp": "The following is a stripped ADP-rendered trajectory from an officially related prior issue.",
    "memory": "The following is deterministic extractive memory from an officially related prior issue.",
}
PROMPT_VERSION = "prompt_v1.1.0"
#: Fixed texts of a prompt.
BASE_INSTRUCTION = """You are an autonomous software-engineering agent.

Your task is to resolve the CURRENT_ISSUE in the current repository by inspecting the code, making the necessary edits, and validating the change with appropriate tests.

A PRIOR_CONTEXT section is included below. It may contain read-only evidence from an officially related previous issue, or it may explicitly state that no prior context is provided for this run. If prior evidence is present, it is optional context only. It may contain irrelevant details, failed attempts, incomplete evidence, or edits that do not apply to the current repository state.

Use PRIOR_CONTEXT only if helpful. The CURRENT_ISSUE and current repository state are authoritative. Independently inspect the current repository and verify all conclusions. Do not copy prior patches blindly.

Workspace constraints: work only inside the current repository workspace. Do not create, edit, or delete files outside the workspace root. Do not change directory above the workspace root. If you create temporary reproduction scripts or notes, create them inside the workspace and remove them before finishing unless they are intentional test files. Prefer existing repository test commands over ad hoc scripts, and use python3 unless the repository clearly requires a different interpreter."""
FINAL_INSTRUCTION = """FINAL_INSTRUCTION
Fix the CURRENT_ISSUE in the current repository. Do not modify unrelated behavior. Run relevant tests when practical, and leave the repository with the intended patch applied."""


#: Control characters, but for those that have a letter of their own, and the blanks of one byte's codes that don't show.
UNSEEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad]"


def quoted(c: Column) -> Column:
    """A text as a Python literal: single quotes, or double ones if only single ones are in it; control characters escaped."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    code = lambda x: F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(x)), 2, "0")))
    body = F.when(body.rlike(UNSEEN), F.array_join(F.transform(F.split(body, ""), lambda x: F.when(x.rlike(UNSEEN), code(x)).otherwise(x)), "")).otherwise(body)
    for char, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(mark))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def lines_by(df: DataFrame, name: str, line: Column, *order: str) -> DataFrame:
    """traj_id and one text of all lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy("traj_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(name))


def titled(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n{title}\n{'-' * len(title)}\n"), F.coalesce(body, F.lit("(none)")))


def memory_text(events: DataFrame, cfg: M.MemoryConfig = M.MemoryConfig(), source: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """traj_id, rendered_text: the memory of each trajectory in ten sections.

    source: traj_id, repo, instance_id, base_commit, model, problem_statement, truncated, one row for each trajectory to render; by default what the first prompt says.
    """
    part = lambda cond, label, c: F.when(cond, F.concat(F.lit(f" {label}="), quoted(text.scrub(c)))).otherwise("")
    desc = F.col("prior_agent_description")
    few = (desc != "") & (F.char_length(desc) <= 160)
    counts = F.array_join(F.transform(F.map_entries("action_counts"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
    seen = M.inspected(events).filter(classify.path_class(F.col("path"), "memory") != "submission_artifact")
    seen = lines_by(seen, "s_files", F.concat(F.lit("- "), text.scrub("path"), F.lit(" ["), counts, F.lit("]")), "first_action_index", "path")
    a = M.anchors(events)
    search = F.concat(F.lit("- ["), F.col("action_index").cast("string"), F.lit("] "), F.col("tool"), *(part(F.col(c) != "", c, F.col(c)) for c in ("pattern", "path", "glob")), part(few, "prior_agent_description", desc))
    search = lines_by(a, "s_search", search, "action_index")
    cmds = M.budgeted_commands(M.commands(events, cfg), cfg)
    cmds = lines_by(cmds, "s_commands", F.concat("line", F.when(F.col("cut"), F.lit(f"\n  {CUT}")).otherwise("")), "action_index")
    bad = M.failures(events, cfg).filter("bucket in ('test_failures', 'runtime_failures')").withColumn("b", F.when(F.col("bucket") == "test_failures", 0).otherwise(1))
    bad = lines_by(bad, "s_failures", F.concat(F.lit("- "), text.scrub("line")), "b", "observation_index", "line_no")
    ev = M.evidence(events, cfg).filter("not excluded_from_rendered_text")
    shown = F.concat(F.lit("- ["), F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(" after action #"), F.col("source_action_index").cast("string"), F.lit("]\n"), text.indent(text.scrub("excerpt"), "  "), F.when(F.col("truncated"), F.lit(f"\n  {CUT}")).otherwise(""))
    ev = lines_by(ev, "s_evidence", shown, "observation_index")
    ed = M.edits(events, cfg).filter("bucket in ('source_edits', 'test_edits')").withColumn("b", F.when(F.col("bucket") == "source_edits", 0).otherwise(1)).withColumn("sub", F.coalesce("subedit_index", F.lit(0)))
    opt = lambda c, label: F.when(F.col(c) != "", F.concat(F.lit(f"\n  {label}: "), F.col(c))).otherwise("")
    body = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f"\n  {c}:\n"), text.indent(text.scrub(F.col(c)), "    "))).otherwise("")
    shown = F.concat(
        F.lit("- "), text.scrub("path"), F.lit("\n  Tool: "), F.col("tool"), F.lit(" action #"), F.col("action_index").cast("string"), F.when(few, F.concat(F.lit("\n  prior_agent_description: "), text.scrub(desc))).otherwise(""),
        opt("old_text_sha256", "old_text_sha256"), opt("new_text_sha256", "new_text_sha256"), body("old_text_excerpt"), body("new_text_excerpt"), F.when(F.col("truncated"), F.lit(f"\n    {CUT}")).otherwise(""),
    )
    ed = lines_by(ed, "s_edits", shown, "b", "action_index", "sub")
    cut = lambda flag: F.when(F.col(flag), F.lit(f"\n{CUT}")).otherwise("")
    last = M.final_message(events, cfg).filter("text <> ''").select("traj_id", F.concat(F.lit("The following is prior-agent generated text, not ground truth:\n"), F.col("text"), cut("truncated")).alias("s_final"))
    prob = M.problem(events, cfg).withColumn("model", F.lit("")) if source is None else source
    stated = F.concat("problem_statement", cut("truncated")) if source is None else F.when(F.col("problem_statement") != "", F.concat(text.scrub("problem_statement"), cut("truncated")))
    prob = prob.withColumn("s_problem", stated)
    out = (events if source is None else source).select("traj_id").distinct()
    for df in (prob, seen, search, cmds, bad, ev, ed, last):
        out = out.join(df, "traj_id", "left")
    field = lambda label, c: F.concat(F.lit(f"- {label}: "), F.coalesce(c, F.lit("")))
    source = F.concat_ws("\n", field("trajectory_id", F.col("traj_id")), field("repo", F.col("repo")), field("instance_id", F.col("instance_id")), field("base_commit", F.col("base_commit")), field("model", F.col("model")))
    whole = F.concat_ws(
        "\n", F.lit("PRIOR EXPERIENCE MEMORY"), F.lit(HEADERS.get(cfg.template, HEADERS["generic"])), titled("SOURCE", source), titled("PRIOR PROBLEM", F.coalesce("s_problem", F.lit("(not found)"))), titled("FILES INSPECTED", F.col("s_files")),
        titled("SEARCH ANCHORS", F.col("s_search")), titled("TEST / DIAGNOSTIC / OTHER COMMANDS", F.col("s_commands")), titled("OBSERVED TEST / RUNTIME FAILURES", F.col("s_failures")), titled("RELEVANT OBSERVATION EXCERPTS", F.col("s_evidence")),
        titled("SOURCE EDIT EVIDENCE", F.col("s_edits")), titled("PRIOR AGENT FINAL MESSAGE", F.col("s_final")), titled("INJECTION WARNING", F.lit(WARNING)),
    )
    return out.select("traj_id", text.scrub(whole).alias("rendered_text"))


def transcript(events: DataFrame) -> DataFrame:
    """traj_id, rendered_text: kept events in order, each under a heading of its place and class."""
    head = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("class_"), F.coalesce(F.concat(F.lit(" "), F.coalesce("function", "language", "source")), F.lit("")))
    body = F.coalesce(F.when(F.col("class_") == "api_action", F.col("kwargs_json")), F.col("content"), F.lit(""))
    return lines_by(events, "rendered_text", F.concat(head, F.lit("\n"), text.indent(text.scrub(body), "  "), F.lit("\n")), "idx")


def prompts(runs: DataFrame) -> DataFrame:
    """runs with prompt, prompt_chars, prompt_sha256, prior_context_chars, injection_sha256, target_problem_statement_sha256.

    runs: condition, target_repo, target_base_commit, target_instance_id, target_problem_statement,
    injection_text (null or blank for no_memory only; else the query fails and names the run).
    """
    label = F.create_map(*(F.lit(x) for kv in CONTEXT_LABELS.items() for x in kv))[F.col("condition")]
    injected = text.normalize_whole(F.col("injection_text"))
    wrong = F.when(label.isNull(), F.lit("unknown condition")).when((F.col("condition") == "no_memory") & (injected != ""), F.lit("no_memory takes no injection")).when((F.col("condition") != "no_memory") & (injected == ""), F.lit("an injection is needed"))
    r = runs.withColumn("injection_text", F.when(wrong.isNotNull(), F.raise_error(F.concat(F.coalesce("run_id", F.lit("?")), F.lit(": "), wrong))).otherwise(injected))
    v = lambda c: text.normalize_whole(F.col(c))
    prior = F.concat(F.lit("PRIOR_CONTEXT\nCondition: "), F.col("condition"), F.lit("\n\n"), label, F.when(F.col("condition") == "no_memory", "").otherwise(F.concat(F.lit("\n\n"), F.col("injection_text"))), F.lit("\nEND_PRIOR_CONTEXT\n"))
    issue = F.concat(F.lit("CURRENT_TARGET\nRepository: "), v("target_repo"), F.lit("\nBase commit: "), v("target_base_commit"), F.lit("\nInstance ID: "), v("target_instance_id"), F.lit("\n\nCURRENT_ISSUE\n"), v("target_problem_statement"), F.lit("\nEND_CURRENT_ISSUE\n"))
    whole = F.concat(text.normalize_whole(F.concat_ws("\n\n\n", F.lit(BASE_INSTRUCTION + "\n"), prior, issue, F.lit(FINAL_INSTRUCTION))), F.lit("\n"))
    r = r.withColumn("prompt", whole)
    return r.withColumns(
        {
            "prompt_template_version": F.lit(PROMPT_VERSION),
            "prompt_chars": F.char_length("prompt"),
            "prompt_sha256": text.sha(F.col("prompt")),
            "prior_context_chars": F.char_length("injection_text"),
            "injection_sha256": F.when(F.col("injection_text") != "", text.sha(F.col("injection_text"))).otherwise(""),
            "target_problem_statement_sha256": text.sha(v("target_problem_statement")),
        }
    )
