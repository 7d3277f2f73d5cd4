"""Session logs rendered as transcripts: by policy, or exactly as far as a strip manifest keeps their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, json_udf, rules, text, variants
from . import convert_session
from .render import CUT
from .strip import StripConfig

#: Opening lines of transcripts (fixed values).
TITLE = "STRIPPED RAW CLAUDE CODE TRAJECTORY"
BY_POLICY = "This transcript was rendered with the same deterministic junk policy as ADP stripping."
BY_MANIFEST = "This transcript was rendered from original raw JSONL using the canonical ADP strip manifest."
MAX_ACTION, MAX_RESULT = 2000, 2000


def blocks(records: DataFrame) -> DataFrame:
    """session, lineno, rtype, role, block_index, btype, block VARIANT: a row for each block, and one without a block for each other record.

    records: session, lineno, rec VARIANT; a column pos is kept.
    """
    rec, place = F.col("rec"), [c for c in ("pos",) if c in records.columns]
    message = F.when(variants.is_object(variants.field(rec, "message", "variant")), variants.field(rec, "message", "variant"))
    rtype = variants.field(rec, "type")
    aside = F.coalesce(rtype.isin("summary", "file-history-snapshot"), F.lit(False))
    r = records.select("session", "lineno", *place, rtype.alias("rtype"), F.when(~aside, message).alias("message"))
    r = r.withColumn("role", F.when(F.col("message").isNotNull(), F.coalesce(F.nullif(variants.field(F.col("message"), "role"), F.lit("")), "rtype")))
    items = F.when(F.col("message").isNotNull(), variants.blocks(variants.field(F.col("message"), "content", "variant")))
    b = r.select("session", "lineno", *place, "rtype", "role", F.col("message").isNotNull().alias("is_message"), F.posexplode_outer(items).alias("block_index", "block"))
    return b.withColumn("btype", variants.field(F.col("block"), "type")).filter("not is_message or block is not null")


def described(b: DataFrame) -> DataFrame:
    """Add said (scrubbed text), tool, tool_use_id, input (JSON object), result (scrubbed text of what a tool gave)."""
    v = lambda name, kind="string": variants.field(F.col("block"), name, kind)
    use, given = F.col("btype") == "tool_use", F.col("btype") == "tool_result"
    inputs = F.when(variants.is_object(v("input", "variant")), F.to_json(v("input", "variant"))).otherwise(F.lit("{}"))
    own = F.when(F.col("btype") == "thinking", variants.content_text(v("thinking", "variant"), compact=True)).when(given, variants.content_text(v("content", "variant"), compact=True)).otherwise(F.to_json("block"))
    return b.withColumns({
        "said": F.when(F.col("btype") == "text", text.scrub(v("text"))),
        "tool": F.when(use, text.normalize(v("name"))),
        "tool_use_id": text.normalize(F.coalesce(F.when(use, v("id")), F.when(given, v("tool_use_id")), F.lit(""))),
        "input": F.when(use, inputs),
        "result": F.when(~use & F.coalesce(F.col("btype") != "text", F.lit(True)), text.scrub(own)),
    })


def tool_decisions(b: DataFrame, cfg: StripConfig) -> DataFrame:
    """Add own struct<reason, label>: what the policy says of a tool call by itself; null for other blocks."""
    use = (F.col("role") == "assistant") & (F.col("btype") == "tool_use")
    arg = lambda name: F.get_json_object("input", f"$.{name}")
    tool = F.coalesce("tool", F.lit(""))
    # each in a projection of its own, so that none is worked out twice
    b = b.withColumns({"__command": F.when(use & (tool == "Bash"), text.normalize(F.coalesce(arg("command"), F.lit("")))), "__path": F.when(use & (tool != "Bash"), classify.primary_path(tool, arg("file_path"), arg("path"), arg("notebook_path")))})
    b = b.withColumns({
        "__class": F.when(F.col("__command").isNotNull(), classify.command_class(F.col("__command"))), "__patch": F.when(F.col("__command").isNotNull(), classify.is_patch_payload(F.col("__command"))),
        "__path_class": F.when(F.col("__path").isNotNull(), classify.path_class(F.col("__path"))), "__bad": F.when(use, text.forbidden(F.col("input"))),
    })
    return b.withColumn("own", F.when(use, _own_decision(cfg))).drop("__command", "__path", "__class", "__patch", "__path_class", "__bad")


def _own_decision(cfg: StripConfig) -> Column:
    tool, kind, path = F.coalesce("tool", F.lit("")), F.col("__class"), F.col("__path_class")
    bash, files = tool == "Bash", tool.isin(*rules.INSPECT_TOOLS, *rules.EDIT_TOOLS)
    edit = tool.isin(*rules.EDIT_TOOLS)
    bad = files & F.col("__bad")
    noisy = [
        ("submission_artifact", True), ("harness", True), ("patch_dump_or_staging", True), ("diagnostic_environment_noise", True),
        ("destructive", cfg.drop_destructive_commands), ("setup", cfg.drop_setup_commands), ("build_install", cfg.drop_build_install_commands),
    ]
    dropped = [k for k, drop in noisy if drop]
    lit = lambda reason, label: F.struct(F.lit(reason).alias("reason"), (F.lit(label) if isinstance(label, str) else label).alias("label"))
    made = lambda before, c, after, label: F.struct(F.concat(F.lit(before), c, F.lit(after)).alias("reason"), label.alias("label"))
    return (
        F.when(tool == "TodoWrite", lit("keep.todowrite_explicitly_included" if cfg.include_todowrite else "drop.todowrite", "planning"))
        .when(bash & F.col("__patch"), lit("drop.patch_payload_command", "other"))
        .when(bash & kind.isin(*dropped), made("drop.", kind, "_command", kind))
        .when(bash, made("keep.", kind, "_command", kind))
        .when(bad & classify.holds_any(F.col("input"), rules.ARTIFACT_TEXT), lit("drop.submission_payload", "other"))
        .when(bad, lit("drop.harness_payload", "other"))
        .when(files & path.isin("submission_artifact", "harness"), made("drop.", path, "_path", path))
        .when(files & edit & (path == "scratch"), lit("drop.scratch_file_body", path))
        .when(files & (path == "scratch") & F.lit(cfg.drop_scratch_reads), lit("drop.scratch_file_read", path))
        .when(files, made("keep.", F.lower(tool), "", path))
        .otherwise(lit("keep.raw_tool_use", "tool"))
    )


def decide(records: DataFrame, cfg: StripConfig = StripConfig()) -> DataFrame:  # noqa: B008
    """described() blocks with `reason` (keep. or drop., null where a text is kept as a matter of course), label, first (the first user text).

    A result follows the last call before it that has its id: it is dropped with it, or as an edit
    tool's echo, or for what it says. One shuffle by session and one by session and id.
    """
    b = described(blocks(records))
    use = (F.col("role") == "assistant") & (F.col("btype") == "tool_use")
    given = (F.col("role") == "user") & (F.col("btype") == "tool_result")
    b = tool_decisions(b, cfg)
    past = Window.partitionBy("session", "tool_use_id").orderBy("lineno", "block_index").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("call", F.when(F.col("tool_use_id") != "", F.last(F.when(use, F.struct("own", "tool")), ignorenulls=True).over(past)))
    asked = (F.col("role") == "user") & (F.col("btype") == "text")
    nth = F.sum(F.coalesce(asked, F.lit(False)).cast("int")).over(Window.partitionBy("session").orderBy("lineno", "block_index"))
    b = b.withColumn("first", F.coalesce(asked & (nth == 1), F.lit(False)))
    late = ~F.col("first") & F.lit(cfg.normalize_user_prompt and not cfg.keep_additional_user_messages)
    pairs = [
        ("drop.raw_summary", F.col("rtype") == "summary"),
        ("drop.raw_file-history-snapshot", F.col("rtype") == "file-history-snapshot"),
        ("drop.raw_non_message_record", ~F.col("is_message")),
        ("drop.reasoning_content", (F.col("btype") == "thinking") & F.lit(not cfg.keep_reasoning_content)),
        ("drop.additional_user_message_default_off", asked & late),
        ("drop.assistant_text_default_off", (F.col("role") == "assistant") & (F.col("btype") == "text") & F.lit(not cfg.include_final_message)),
        ("drop.raw_tool_result_after_dropped_tool", given & F.col("call.own.reason").startswith("drop.")),
        ("drop.edit_tool_result_snippet", given & F.col("call.tool").isin(*rules.EDIT_TOOLS)),
        ("drop.empty_tool_result", given & (text.strip(F.col("result")) == "")),
        ("drop.hard_forbidden_tool_result", given & text.forbidden(F.col("result"))),
        ("drop.environment_observation_noise", given & classify.is_noise(F.col("result"))),
        ("keep.raw_tool_result", given),
    ]
    reason = F.coalesce(F.col("own.reason"), classify.chain(pairs, None))
    return b.withColumn("reason", reason).withColumn("label", F.col("own.label")).drop("own", "call")


def issue_text(c: Column) -> Column:
    """A prompt as labelled lines of its repo, instance_id, base_commit and statement, or scrubbed as it is where it has none of these."""
    m = text.issue_metadata(c)
    line = lambda name: F.when(m[name].isNotNull(), F.concat(F.lit(f"{name}: "), m[name]))
    whole = F.concat_ws("\n", F.lit("PRIOR ISSUE METADATA"), line("repo"), line("instance_id"), line("base_commit"), F.lit("problem_statement:"), text.scrub(F.coalesce(m["problem_statement"], F.lit(""))))
    none = F.coalesce(m["repo"], m["instance_id"], m["base_commit"], m["problem_statement"]).isNull()
    return F.when(none, text.scrub(c)).otherwise(text.strip(whole))


def shown(b: DataFrame, cfg: StripConfig, labels: bool, max_action: int, max_result: int) -> DataFrame:
    """Add `lines`: heading and body of a kept block; null for what says nothing."""
    use = (F.col("role") == "assistant") & (F.col("btype") == "tool_use")
    cut = lambda c, most: F.concat(F.left(c, F.lit(most)), F.when(F.char_length(c) > most, F.lit(f"\n{CUT}")).otherwise(""))
    at = lambda *more: F.concat(F.lit("[RAW line "), F.col("lineno").cast("string"), F.lit(" "), *more, F.lit("]\n"))
    rest = variants.without_keys(F.try_parse_json("input"), "description")
    for t in rules.EDIT_TOOLS:
        rest = F.when(F.col("tool") == t, json_udf.edit_hashes(F.when(use & (F.col("tool") == t), variants.without_keys(F.try_parse_json("input"), "description")), t)).otherwise(rest)
    b = b.withColumn("__rest", F.when(use & (F.col("tool") != "Bash"), rest))
    payload = F.when(F.col("tool") == "Bash", text.scrub(F.coalesce(F.get_json_object("input", "$.command"), F.lit("")))).otherwise(json_udf.scrub_pretty(F.col("__rest")))
    label = F.concat(F.lit(" "), F.col("label")) if labels else F.lit("")
    said, result = F.col("said"), F.col("result")
    body = (
        F.when(F.col("btype") == "thinking", F.concat(at(F.lit("THINKING")), result) if cfg.keep_reasoning_content else F.lit(None))
        .when((F.col("role") == "user") & (F.col("btype") == "text"), F.concat(at(F.lit("USER")), F.when(F.col("first") & F.lit(cfg.normalize_user_prompt), issue_text(said)).otherwise(said)))
        .when((F.col("role") == "assistant") & (F.col("btype") == "text"), F.concat(at(F.lit("ASSISTANT TEXT")), said))
        .when(use, F.concat(at(F.lit("TOOL "), F.coalesce("tool", F.lit("")), label), cut(payload, max_action)))
        .when((F.col("role") == "user") & (F.col("btype") == "tool_result"), F.concat(at(F.lit("TOOL RESULT "), F.col("tool_use_id")), cut(result, max_result)))
        .otherwise(F.concat(at(F.coalesce("role", F.lit("None")), F.lit(" "), F.coalesce("btype", F.lit("None"))), F.when(text.strip(F.coalesce(result, F.lit(""))) != "", result)))
    )
    return b.withColumn("lines", body).drop("__rest")


def joined(sessions: DataFrame, b: DataFrame, how: str, *order: str) -> DataFrame:
    """session, transcript: title and kept lines; a session that keeps nothing has its title alone."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "lines")))
    found = b.filter("lines is not null").groupBy("session").agg(F.array_join(F.transform(ordered, lambda x: x["lines"]), "\n").alias("body"))
    whole = F.concat_ws("\n", F.lit(TITLE), F.lit(how), F.lit(""), "body")
    return sessions.join(found, "session", "left").select("session", F.concat(F.regexp_replace(whole, rf"(?U){text.SPACE}+\z", ""), F.lit("\n")).alias("transcript"))


def by_policy(records: DataFrame, cfg: StripConfig = StripConfig(), max_action: int = MAX_ACTION, max_result: int = MAX_RESULT) -> DataFrame:  # noqa: B008
    """session, transcript of records (session, lineno, rec) in line order, by the rules of decide()."""
    b = decide(records, cfg).filter("reason is null or startswith(reason, 'keep.')")
    return joined(records.select("session").distinct(), shown(b, cfg, True, max_action, max_result), BY_POLICY, "lineno", "block_index")


def with_manifest(records: DataFrame, decisions: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """described() blocks of the conversation's chain with pos and adp_indices: the kept decisions that name them, null for none.

    decisions: session, idx, decision, provenance. A decision names a line; its role, block type and
    block index, where given, must be the block's; ids of tool calls and results must be equal, other blocks may lack one.
    chain: convert_session.linear(records), where the caller has it.
    """
    chain = convert_session.linear(records) if chain is None else chain
    plain = blocks(chain.select("session", "lineno", "pos", "rec"))
    b = described(plain)
    kept = decisions.filter("decision = 'keep'").select("session", "idx", F.col("provenance.raw_jsonl_line").alias("lineno"), *(F.col(f"provenance.{n}").alias(f"d_{n}") for n in ("raw_role", "raw_block_type", "raw_block_index", "tool_use_id")))
    free = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    named, theirs = F.col("tool_use_id"), text.normalize(F.coalesce("d_tool_use_id", F.lit("")))
    strict = F.coalesce(F.col("btype").isin("tool_use", "tool_result"), F.lit(False))
    ids = (named == "") | (theirs == named) | ((theirs == "") & ~strict)
    fits = (free("d_raw_role") | (F.col("d_raw_role") == F.coalesce("role", F.lit("")))) & (free("d_raw_block_type") | (F.col("d_raw_block_type") == F.coalesce("btype", F.lit("unknown"))))
    fits = fits & (F.col("d_raw_block_index").isNull() | (F.col("d_raw_block_index") == F.col("block_index"))) & ids
    found = b.select("session", "lineno", "role", "btype", "block_index", "tool_use_id").join(kept, ["session", "lineno"]).filter(fits)
    found = found.groupBy("session", "lineno", "block_index").agg(F.array_sort(F.collect_list("idx")).alias("adp_indices"))
    # described after the join, so that only blocks that a caller keeps have their texts worked out
    return described(plain.join(found, ["session", "lineno", "block_index"], "left"))


def by_manifest(records: DataFrame, decisions: DataFrame, cfg: StripConfig = StripConfig(), max_action: int = MAX_ACTION, max_result: int = MAX_RESULT, chain: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """session, transcript of the blocks that with_manifest() finds kept, in conversation order; results of kept edit calls are left out."""
    b = with_manifest(records, decisions, chain).filter("adp_indices is not null")
    asked = F.coalesce((F.col("role") == "user") & (F.col("btype") == "text"), F.lit(False))
    b = b.withColumn("first", asked & (F.sum(asked.cast("int")).over(Window.partitionBy("session").orderBy("pos", "block_index")) == 1))
    past = Window.partitionBy("session", "tool_use_id").orderBy("pos", "block_index").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("caller", F.when(F.col("tool_use_id") != "", F.last(F.when(F.col("role") == "assistant", F.col("tool")), ignorenulls=True).over(past)))
    echo = (F.col("role") == "user") & (F.col("btype") == "tool_result") & F.col("caller").isin(*rules.EDIT_TOOLS)
    b = b.filter(~F.coalesce(echo, F.lit(False))).withColumn("label", F.lit(""))
    out = joined(records.select("session").distinct(), shown(b, cfg, False, max_action, max_result), BY_MANIFEST, "pos", "block_index")
    return out.withColumn("transcript", F.concat(F.regexp_replace(text.scrub("transcript"), rf"(?U){text.SPACE}+\z", ""), F.lit("\n")))


def transcripts(records: DataFrame, decisions: DataFrame, cfg: StripConfig = StripConfig(), chain: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """session, transcript, render_mode: exact for sessions whose decisions name lines, by policy for the others. chain: convert_session.linear(records), where the caller has it."""
    named = decisions.filter("provenance.raw_jsonl_line > 0").select("session").distinct()
    own = chain.join(named, "session", "left_semi") if chain is not None else None
    exact = by_manifest(records.join(named, "session", "left_semi"), decisions, cfg, chain=own).withColumn("render_mode", F.lit("manifest_exact"))
    return exact.unionByName(by_policy(records.join(named, "session", "left_anti"), cfg).withColumn("render_mode", F.lit("policy_fallback_no_provenance")))


def match_key(c: Column) -> Column:
    """A file's name without folders, extension and a copy's number in brackets at its end."""
    name = F.regexp_replace(text.normalize(c), r"\A.*/", "")
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", ""), r"\([^)]*\)\z", "")


def match_manifests(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files with traj_id of the only manifest whose source_file or traj_id has the file's key; else of the only manifest there is; else null.

    files: path. manifests: traj_id, source_file; two rows are two manifests, equal or not.
    """
    m = manifests.withColumn("__m", F.monotonically_increasing_id())
    keys = m.select("__m", "traj_id", F.explode(F.array_distinct(F.array(match_key(F.coalesce("source_file", F.lit(""))), match_key(F.coalesce("traj_id", F.lit("")))))).alias("key")).filter("key <> ''")
    one = keys.groupBy("key").agg(F.min("traj_id").alias("traj_id"), F.count_distinct("__m").alias("n")).filter("n = 1").drop("n")
    sole = manifests.limit(2).groupBy(F.lit("").alias("__all")).agg(F.count("*").alias("n"), F.min("traj_id").alias("sole")).filter("n = 1")
    out = files.withColumn("key", match_key(F.col("path"))).withColumn("__all", F.lit("")).join(one, "key", "left").join(F.broadcast(sole.drop("n")), "__all", "left")
    return out.withColumn("traj_id", F.coalesce("traj_id", "sole")).drop("key", "__all", "sole")
