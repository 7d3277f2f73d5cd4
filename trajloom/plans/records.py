"""Queries over whole records: memories with their warnings, error records, files that are written and read back, and their SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shared, text
from ..operators import adp, convert_bulk, convert_session, gates, manifest, memory, memory_record, paths, positional, render
from ..sources import readers, sinks
from . import sqltext as S
from .fixtures import TOOLS, agent_events, raw_sessions
from .queries import COMMAND_ROWS, PAIRS, PREVIOUS, _prompt_sql, bulk_rows, pair_tables, run_rows
from .registry import query, table


# ---- trajectories as lines, some of them broken


def odd_events(spark, sf_dir):
    """agent_events() in which some calls have no function, no path, or edits without any edit."""
    e, call, i = agent_events(spark, sf_dir), F.col("class_") == "api_action", F.col("idx")
    return e.withColumns(
        {
            "function": F.when(call & (i % 29 == 5), "").when(call & (i % 31 == 7), "MultiEdit").otherwise(F.col("function")),
            "kwargs_json": F.when(call & (i % 23 == 3), "{}").when(call & (i % 31 == 7), F.concat(F.expr("left(kwargs_json, length(kwargs_json) - 1)"), F.lit(',"edits":[]}'))).otherwise(F.col("kwargs_json")),
            "class_": F.when(i % 37 == 9, "odd_item").otherwise(F.col("class_")),
        }
    )


ODD_EVENTS = f"""select * exclude (class_) replace (case when class_ = 'api_action' and idx % 29 = 5 then '' when class_ = 'api_action' and idx % 31 = 7 then 'MultiEdit' else function end as function,
  case when idx % 23 = 3 then '' else file_path end as file_path), case when idx % 37 = 9 then 'odd_item' else class_ end as class_ from ({S.AGENT_EVENTS})"""


def adp_lines(spark, sf_dir):
    """src_file, lineno, value: the trajectories of odd_events() as lines of JSON, with details of three kinds; of 17 lines one is cut, one a list, one has content that is none."""
    items = F.struct(*(c for c in ("class_", "source", "content", "language", "function", "description", "reasoning_content")), F.parse_json(F.coalesce("kwargs_json", F.lit("null"))).alias("kwargs"))
    t = odd_events(spark, sf_dir).groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.to_json(items).alias("x")))), lambda x: x["x"]).alias("items"))
    k = F.substr("traj_id", F.lit(2)).cast("long")
    n = k.cast("string")
    issue = F.concat(F.lit('{"issue_metadata":{"repo":"R \\n","instance_id":"I'), n, F.lit('","base_commit":null,"problem_statement":"stated '), n, F.lit('  "},"models":["m'), n, F.lit('","x"],"warnings":["w'), n, F.lit('",2],"source_file":"f'), n, F.lit('"}'))
    details = F.when(k % 3 == 0, issue).when(k % 3 == 1, F.lit('{"issue_metadata":{"repo":"R"},"models":[]}')).otherwise(F.lit('"none"'))
    content = F.when(k % 17 == 2, F.lit("{}")).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    own = F.when(k % 19 == 3, F.lit("")).otherwise(F.concat(F.lit('"id":"'), F.col("traj_id"), F.lit('",')))
    line = F.concat(F.lit("{"), own, F.lit('"schema_version":"1.1.0","details":'), details, F.lit(',"content":'), content, F.lit("}"))
    value = F.when(k % 17 == 0, F.left(line, F.lit(40))).when(k % 17 == 1, F.lit("[1]")).otherwise(line)
    return t.select(F.lit("agents.jsonl").alias("src_file"), (k + 1).cast("int").alias("lineno"), value.alias("value"))


ADP = f"""u as (select distinct traj_id as own, cast(substr(traj_id, 2) as bigint) as k from a),
i as (select *, case when k % 17 in (0, 1) or k % 19 = 3 then 'line-' || (k + 1) else own end as id, k % 17 > 2 as good from u)"""


@functools.lru_cache(maxsize=2)
def trajectories(spark, sf_dir):
    """The lines' trajectories, good and broken ones, written once for every query over memories."""
    return shared.stored(adp.trajectories(adp_lines(spark, sf_dir)), "trajectories")


@functools.lru_cache(maxsize=2)
def memories(spark, sf_dir, cfg: memory.MemoryConfig = memory.MemoryConfig()):  # noqa: B008
    """Events are written once, since every part of a memory reads them."""
    t = trajectories(spark, sf_dir)
    return memory_record.records(t, shared.stored(adp.events(t), "events"), cfg)


def broken_memories(spark, sf_dir):
    """The records of memories() for trajectories with an error, without working out and joining the good ones' parts and texts."""
    t = trajectories(spark, sf_dir).filter("error is not null")
    return memory_record.records(t, adp.events(t))


@query(f"""with a as ({ODD_EVENTS}), {ADP},
p as (select traj_id as own, min_by({S.normalize('content')}, idx) as prompt from a where class_ = 'text_observation' and source = 'user' group by 1)
select id, good, case when not good then null when k % 3 = 0 then 'R' || chr(10) when k % 3 = 1 then 'R' else '' end as repo, case when not good then null when k % 3 = 0 then 'I' || k else '' end as instance_id, case when good then '' end as base_commit,
  case when not good then null when k % 3 = 0 then 'm' || k else '' end as model, case when not good then null when k % 3 = 0 then 'f' || k else 'agents.jsonl' end as source_file,
  case when not good then null when k % 3 = 0 then 'issue_metadata.problem_statement' when prompt is not null then 'first_user_text_observation' else 'missing' end as problem_source,
  case when not good then '' when k % 3 = 0 then 'stated ' || k else coalesce(left(prompt, 4000), '') end as problem_statement, case when good then coalesce(prompt, '') else '' end as raw_user_prompt,
  case when not good then '' when k % 3 = 0 then sha256('stated ' || k) else sha256(coalesce(prompt, '')) end as problem_sha,
  case when not good then '' when k % 3 = 0 then '[source] w' || k || '|[source] 2' when prompt is not null then '{memory_record.FALLBACK}' else '{memory_record.NO_PROBLEM}' end as about
from i left join p using (own)""")
def t11_source_metadata(spark, sf_dir):
    r = memories(spark, sf_dir)
    told = F.filter("quality.warnings", lambda w: w.startswith("[source]") | w.startswith("prior_problem"))
    m = lambda c: F.col(f"source_metadata.{c}").alias(c)
    return r.select(
        F.col("source_trajectory_id").alias("id"), F.col("source_metadata").isNotNull().alias("good"), *map(m, ("repo", "instance_id", "base_commit", "model", "source_file")), F.col("prior_problem.source").alias("problem_source"),
        "prior_problem.problem_statement", "prior_problem.raw_user_prompt", F.col("prior_problem.sha256").alias("problem_sha"), F.array_join(told, "|").alias("about"),
    )


@query(f"with a as ({ODD_EVENTS}), {ADP} select id, 'CONVERTER ERROR: ' || case k % 17 when 0 then 'invalid JSON' when 1 then 'not an object' else 'content is no list' end as warnings, case when k % 17 = 2 then '1.1.0' else '' end as version, 0 as items, '' as rendered_text from i where not good")
def t10_error_records(spark, sf_dir):
    r = broken_memories(spark, sf_dir).filter("source_metadata is null")
    items = F.size("search_anchors") + F.size("observation_evidence") + sum(F.size(f"commands.{b}") for b in memory.COMMAND_BUCKETS.values())
    return r.select(F.col("source_trajectory_id").alias("id"), F.array_join("quality.warnings", "|").alias("warnings"), F.col("source_schema_version").alias("version"), items.alias("items"), "rendered_text")


ODD_PREVIOUS, ODD_COMMANDS = PREVIOUS.replace(S.AGENT_EVENTS, ODD_EVENTS), COMMAND_ROWS.replace(S.AGENT_EVENTS, ODD_EVENTS)
EDIT_ROWS = f"select traj_id, {S.path_class('path', 'memory')} as category from (select *, case when coalesce(file_path, '') = '' then '' else {S.normal_path('file_path')} end as path from a where class_ = 'api_action' and function in ('Edit', 'Write'))"
BUCKETS = [("commands", b) for b in memory.COMMAND_BUCKETS.values()] + [("observed_failures", b) for b in memory_record.FAILURE_BUCKETS] + [("edits", b) for b in memory.EDIT_BUCKETS.values()]


def _case(column: str, table: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


@query(ODD_PREVIOUS + f""", {ADP}, kk as (select *, {S.command_class(S.scrub('content'), 'memory')} as command_class from a where class_ = 'code_action'),
l as (select traj_id, idx, bucket, trim(unnest(string_split(clean, chr(10)))) as line, generate_subscripts(string_split(clean, chr(10)), 1) as line_no from o),
r as (select *, {S.failure_rule('line')} as rule from l), f as (select *, row_number() over (partition by traj_id, bucket, line order by idx, line_no) as nth from r where rule is not null),
g as (select *, row_number() over (partition by traj_id order by idx, line_no) as n from f where nth = 1),
w as (select traj_id, 'commands' as part, {_case('command_class', memory.COMMAND_BUCKETS)} as bucket from kk union all select traj_id, 'observed_failures', bucket from g where n <= 80
  union all select traj_id, 'edits', {_case('category', memory.EDIT_BUCKETS)} from ({EDIT_ROWS})),
bk as (select * from (values {', '.join(str(x) for x in BUCKETS)}) as x(part, bucket))
select i.id, bk.part, bk.bucket, count(w.part) filter (i.good) as n from i cross join bk left join w on w.traj_id = i.own and w.part = bk.part and w.bucket = bk.bucket group by all""")
def h7_memory_buckets(spark, sf_dir):
    """Every bucket of every record, also where it is empty."""
    r = memories(spark, sf_dir)
    counts = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(b).alias("bucket"), F.size(f"{p}.{b}").cast("long").alias("n")) for p, b in BUCKETS))
    return r.select(F.col("source_trajectory_id").alias("id"), F.inline(counts))


@query(ODD_PREVIOUS + f""", {ADP}, ev as (select traj_id, count(*) as n from o where kind is not null and {S.strip('clean')} <> '' group by 1),
wn as (select traj_id, string_agg(w, '|' order by idx, ord) as w from (
  select traj_id, idx, 1 as ord, '[' || idx || '] ' || function || ' action has no extractable file path' as w from a where class_ = 'api_action' and function in ('Read', 'Edit', 'Write', 'MultiEdit') and coalesce(file_path, '') = ''
  union all select traj_id, idx, 2, '[' || idx || '] MultiEdit has no extractable edits' from a where class_ = 'api_action' and function = 'MultiEdit'
  union all select traj_id, idx, 3, '[' || idx || '] api_action has empty function' from a where class_ = 'api_action' and function = '') group by 1),
q as (select traj_id, count(*) filter (class_ = 'odd_item' or (class_ = 'api_action' and function not in ('', 'TodoWrite', 'Read', 'Grep', 'Glob', 'Edit', 'Write', 'MultiEdit'))) as unknown, bool_or(reasoning_content is not null) as thought, bool_or(class_ = 'api_action' and function = 'TodoWrite') as planned from a group by 1),
ed as (select traj_id, count(*) filter (category = 'submission_artifact') as artifacts, count(*) filter (category = 'scratch') as scratch from ({EDIT_ROWS}) group by 1)
select i.id, q.unknown as unknown_type_count, q.thought as excluded_reasoning, q.planned as excluded_todowrite, coalesce(ed.artifacts, 0) as artifacts, coalesce(ed.scratch, 0) as scratch, least(coalesce(ev.n, 0), 20) as evidence, coalesce(wn.w, '') as event_warnings,
  (case when ev.n > 20 then 'observation_evidence capped at max_observation_evidence_items=20; skipped=' || (ev.n - 20) || '|' else '' end) || (case when q.unknown > 0 then 'Skipped ' || q.unknown || ' unhandled item classes/functions' else '' end) as late
from i join q on q.traj_id = i.own left join ed on ed.traj_id = i.own left join ev on ev.traj_id = i.own left join wn on wn.traj_id = i.own where i.good""")
def t8_memory_quality(spark, sf_dir):
    r = memories(spark, sf_dir).filter("source_metadata is not null")
    own = F.filter("quality.warnings", lambda w: w.rlike(r"^\[[0-9]+\]"))
    late = F.filter("quality.warnings", lambda w: w.startswith("observation_evidence") | w.startswith("Skipped"))
    q = lambda c, name: F.col(f"quality.{c}").alias(name)
    joined = F.array_join(late, "|")
    return r.select(
        F.col("source_trajectory_id").alias("id"), "quality.unknown_type_count", q("excluded_reasoning_content", "excluded_reasoning"), q("excluded_todowrite", "excluded_todowrite"), q("excluded_submission_artifacts_count", "artifacts"),
        q("excluded_scratch_edits_count", "scratch"), F.size("observation_evidence").cast("long").alias("evidence"), F.array_join(own, "|").alias("event_warnings"),
        F.when((F.size(late) == 1) & late[0].startswith("observation"), F.concat(joined, F.lit("|"))).otherwise(joined).alias("late"),
    )


# ---- files that are written and read back


def scratch(spark, name: str) -> str:
    """A folder of its own below the shared one; queries that write files are eager there, and leave them for lazy readers."""
    return f"{shared.ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("select 'part-' || lpad(cast((n - 1) // 500 as varchar), 5, '0') || '.jsonl.zst' as file, (n - 1) % 500 + 1 as line, doc_id, sha256(text) as sha from (select *, row_number() over (order by doc_id) as n from documents)")
def k2_shards(spark, sf_dir):
    """Documents in numbered zstd shards of 500 rows, read back line by line."""
    path = scratch(spark, "shards")
    sinks.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id", rows=500)
    back = readers.lines(spark, path, "*.zst")
    return back.select(F.substring_index("src_file", "/", -1).alias("file"), F.col("lineno").cast("long").alias("line"), F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), text.sha(F.get_json_object("value", "$.text")).alias("sha"))


@query("select lpad(cast(row_number() over (order by doc_id) as varchar), 6, '0') || '_' || lang || '_' || source || '.txt' as file, sha256(text || chr(10)) as sha from documents")
def k6_numbered_texts(spark, sf_dir):
    """A file for each document, named by its number and an id with signs that no name may have."""
    path = scratch(spark, "texts")
    d = table(spark, sf_dir, "documents").withColumn("id", F.concat(F.lit(" ."), "lang", F.lit(":/* "), "source", F.lit("?")))
    written = sinks.numbered_texts(d, path, "id", "text", "doc_id")
    back = readers.texts_at(written.select("name", F.concat(F.lit(f"{path}/"), "name").alias("path")), "path")
    return back.select(F.col("name").alias("file"), text.sha(F.col("value")).alias("sha"))


def two_sides(spark, sf_dir):
    """Documents as lines, in files of 300 and of 280; of the second side every 70th has another id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 2).alias("resolved"))
    a, b = scratch(spark, "left"), scratch(spark, "right")
    sinks.shards(d.select("doc_id", "id", "resolved"), a, "doc_id", rows=300, name="raw-%05d.jsonl")
    sinks.shards(d.withColumn("id", F.when(F.col("doc_id") % 70 == 0, "other").otherwise(F.col("id"))).select("doc_id", "id"), b, "doc_id", rows=280, name="adp-%05d.jsonl.gz")
    return a, b


SIDES = """with d as (select doc_id, row_number() over (order by doc_id) - 1 as n from documents), l as (select n // 300 as file_no, n % 300 as row_no, cast(doc_id as varchar) as id from d),
r as (select n // 280 as file_no, n % 280 as row_no, case when doc_id % 70 = 0 then 'other' else cast(doc_id as varchar) end as id from d)"""


@query(SIDES + " select file_no, row_no, l.id as left_id, r.id as right_id from l join r using (file_no, row_no)")
def j8_side_by_side(spark, sf_dir):
    a, b = two_sides(spark, sf_dir)
    id = F.get_json_object("value", "$.id")
    both = positional.side_by_side(positional.by_place(spark, a, "*.jsonl"), positional.by_place(spark, b, "*.gz"), id, id, strict=False)
    return both.select(F.col("file_no").cast("long").alias("file_no"), F.col("row_no").cast("long").alias("row_no"), "left_id", "right_id")


@query(SIDES + """, a as (select file_no, count(*) as n from l group by 1), b as (select file_no, count(*) as n from r group by 1)
select file_no, row_no, 'id mismatch: raw=' || l.id || ' converted=' || r.id as error from l join r using (file_no, row_no) where l.id <> r.id
union all select file_no, least(coalesce(a.n, 0), coalesce(b.n, 0)), 'row count mismatch: raw=' || coalesce(a.n, 0) || ' converted=' || coalesce(b.n, 0) from a full join b using (file_no) where a.n is distinct from b.n""")
def j8_mismatches(spark, sf_dir):
    a, b = two_sides(spark, sf_dir)
    id = F.get_json_object("value", "$.id")
    found = positional.mismatches(positional.by_place(spark, a, "*.jsonl"), positional.by_place(spark, b, "*.gz"), id, id)
    return found.select(F.col("file_no").cast("long").alias("file_no"), F.col("row_no").cast("long").alias("row_no"), "error")


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) as n from documents) where n <= 430 and doc_id % 2 = 1")
def o4_first_seen(spark, sf_dir):
    """The limit is the feature: of the first 430 rows seen those that are resolved."""
    a, _ = two_sides(spark, sf_dir)
    rows = positional.first_seen(spark, f"{a}/*.jsonl", 430).rows
    return rows.filter(F.get_json_object("value", "$.resolved") == "1").select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


# ---- gates and selections


@query("""with t as (select 't' || conv_id as trajectory_id, conv_id % 5 as k from (select distinct conv_id from conversations))
select case when k = 0 then null else trajectory_id end as trajectory_id, case k when 0 then 'no trajectory_id' when 1 then 'no trajectory' else 'a message is null' end as error from t where k < 3""")
def t2_bulk_errors(spark, sf_dir):
    """Rows without an id, without messages, with a null message; the others are converted."""
    k = F.substr("trajectory_id", F.lit(2)).cast("long") % 5
    b = bulk_rows(spark, sf_dir).withColumn("k", k)
    b = b.withColumns({"trajectory_id": F.when(F.col("k") != 0, F.col("trajectory_id")), "trajectory": F.when(F.col("k") == 2, F.array_append("trajectory", F.lit(None))).when(F.col("k") != 1, F.col("trajectory"))})
    return convert_bulk.convert(b.drop("k"), errors="skip")[1]


def broken_prompts(spark, sf_dir):
    """Prompts of targets that lack a condition, have two issue texts, or have a run twice; and long ones."""
    k = F.substr("target_instance_id", F.lit(7)).cast("long") % 5
    r = run_rows(spark, sf_dir).filter(~((k == 0) & (F.col("condition") == "raw")))
    r = r.withColumn("target_problem_statement", F.when((k == 1) & (F.col("condition") == "adp"), F.concat("target_problem_statement", F.lit(" and more"))).otherwise(F.col("target_problem_statement")))
    again = r.filter((k == 2) & (F.col("condition") == "memory")).withColumn("run_id", F.concat("run_id", F.lit("_again")))
    return render.prompts(r.unionByName(again))


@query(f"""with p as ({_prompt_sql()}), r as (select run_id, prompt_chars, regexp_extract(run_id, '^(org__b[0-9]+)__(.*)$', 1) as t, regexp_extract(run_id, '^(org__b[0-9]+)__(.*)$', 2) as c from p),
k as (select *, cast(substr(t, 7) as bigint) % 5 as k from r), x as (select run_id, t, c, k, prompt_chars + case when k = 1 and c = 'adp' then 9 else 0 end as n from k where not (k = 0 and c = 'raw')),
y as (select * from x union all select run_id || '_again', t, c, k, n from x where k = 2 and c = 'memory')
select 'bad_condition_sets' as gate, t as key, 'adp,memory,no_memory' as detail, false as promoted from (select distinct t from y where k = 0)
union all select 'inconsistent_target_issue_hashes', t, null, false from (select distinct t from y where k = 1)
union all select 'duplicate_prompt_paths', t || '/' || c || '/prompt.txt', run_id, false from y where run_id like '%_again' union all select 'too_long', run_id, cast(n as varchar), false from y where n > 9000""")
def v5_prompt_gates(spark, sf_dir):
    """All violations of prompts that must not be published; what was published before stays, which tests/test_gates.py holds."""
    out = gates.publish(broken_prompts(spark, sf_dir), scratch(spark, "prompts"), "run_id", [g for g in gates.prompt_gates(9000) if g.name != "forbidden"])
    detail = F.when(F.col("gate") != "inconsistent_target_issue_hashes", F.col("detail"))
    return out.violations.select("gate", "key", detail.alias("detail"), F.lit(out.promoted).alias("promoted"))


@query(PAIRS + ", n as (select count(*) as n from pairs) select n.n as pair_rows, (select count(distinct experience_instance_id) from pairs) as unique_priors, n.n as unique_targets, 4 * n.n as run_rows, 'org__x1,org__x2' as missing_targets from n")
def a16_manifest_summary(spark, sf_dir):
    p = manifest.pairs(*(pair_tables(spark, sf_dir)[i] for i in (2, 0, 1, 3)))
    r = run_rows(spark, sf_dir)
    more = spark.createDataFrame([("org__x2",), ("org__x1",)], "target_instance_id string")
    s = manifest.manifest_summary(p, r, r.select("target_instance_id").unionByName(more))
    return s.withColumn("missing_targets", F.array_join("missing_targets", ","))


@query("""with e as (select *, event_id % 7 = 0 as skipped, case when event_id % 11 = 0 then 'OSError' end as exception, event_id % 3 as outside, case when event_type <> 'signup' then case when event_type = 'error' then 1 else 0 end end as exit_code, case when event_id % 2 = 0 then 'diff' else '' end as patch from events)
select event_id, case when skipped then 'skipped_success' when exception is not null then 'orchestrator_exception' when exit_code is null then 'started' when outside > 1 then 'workspace_guardrail_failed' when exit_code = 0 then case when patch = '' then 'success_empty_patch' else 'success' end else 'openhands_failed' end as status,
  case event_id % 4 when 0 then 'host' when 1 then case when event_id % 3 = 0 then 'image' end when 2 then case when event_id % 3 = 0 then 'image' when event_id % 5 = 0 then 'host' end end as runtime from e""")
def c14_run_status(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    e = table(spark, sf_dir, "events").select("event_id", (i % 7 == 0).alias("skipped"), F.when(i % 11 == 0, "OSError").alias("exception"), F.greatest(i % 3 - 1, F.lit(0)).alias("off_workspace_writes"), F.when(kind != "signup", (kind == "error").cast("int")).alias("exit_code"), F.when(i % 2 == 0, "diff").otherwise("").alias("patch"))
    asked = F.element_at(F.array(*map(F.lit, ("host", "image", "auto", "none"))), (i % 4 + 1).cast("int"))
    return e.select("event_id", manifest.run_status().alias("status"), manifest.runtime(asked, i % 3 == 0, i % 5 == 0)["runtime"].alias("runtime"))


@query(PAIRS + """, r as (select related_instance_id || '__' || c as run_id, related_instance_id as t, c, cast(substr(related_instance_id, 7) as bigint) as k from pairs, (select unnest(['no_memory', 'raw', 'adp', 'memory']) as c)),
x as (select * from r union all select run_id || 'b', t, c, k from r where k % 4 = 0 and c = 'raw')
select 'null_field' as problem, run_id || ': target_base_commit,sandbox_image' as detail from x where k % 6 = 1 union all select 'duplicate', t || ' raw' from r where k % 4 = 0 and c = 'raw' union all select 'unconfirmed', ''""")
def v7_selection_problems(spark, sf_dir):
    k = F.substr("target_instance_id", F.lit(7)).cast("long")
    r = run_rows(spark, sf_dir).withColumn("prompt_path", F.lit("p"))
    r = r.unionByName(r.filter((k % 4 == 0) & (F.col("condition") == "raw")).withColumn("run_id", F.concat("run_id", F.lit("b"))))
    return manifest.selection_problems(r.withColumns({c: F.when(k % 6 != 1, F.col(c)) for c in ("target_base_commit", "sandbox_image")}), confirmed=False)


# ---- predictions and paths


def run_folders(spark, sf_dir):
    """Labels as runs with folders, whose prediction files are written: some missing, some no object, some without an audit, some of the same instance."""
    root = scratch(spark, "runs")
    i = F.col("doc_id")
    plan = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("run"), i.cast("string")).alias("run_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("condition"), F.concat(F.lit("i"), (i % 50).cast("string")).alias("target_instance_id"), i.alias("plan_index"),
        F.concat(F.lit(root), F.lit("/r"), i.cast("string")).alias("run_dir"),
    )
    at = F.concat(F.lit("r"), F.col("plan_index").cast("string"))
    k = F.col("plan_index")
    body = F.when(k % 13 == 1, "[1]").when(k % 13 == 2, '{"instance').otherwise(F.concat(F.lit('{"instance_id":"'), "target_instance_id", F.lit('","model_patch":"p","n":'), k.cast("string"), F.lit("}")))
    said = plan.filter(k % 13 != 0).select(F.concat(at, F.lit("/prediction.json")).alias("name"), body.alias("value"))
    audit = plan.filter(k % 5 != 0).select(F.concat(at, F.lit("/prediction_audit.json")).alias("name"), F.concat(F.lit('{"run_id":"'), "run_id", F.lit('","audited":true}')).alias("value"))
    sinks.files(said.unionByName(audit), root, "name", "value")
    return plan


PREDICTED = """with e as (select doc_id as k, 'run' || doc_id as run_id, 'q' || quality as condition, 'i' || (doc_id % 50) as iid from labels), h as (select * from e where k % 13 > 2)"""


@query(PREDICTED + """ select 'strict' as part, run_id, condition, '{"instance_id":"' || iid || '","model_patch":"p","n":' || k || '}' as json from h
union all select 'audit', run_id, condition, case when k % 5 <> 0 then '{"audited":true,"run_id":"' || run_id || '"}' else '{"run_id":"' || run_id || '","condition":"' || condition || '","target_instance_id":"' || iid || '","prediction_missing_audit":true}' end from h
union all select 'missing', run_id, null, 'r' || k || '/prediction.json' from e where k % 13 < 3
union all select 'duplicates', null, condition, string_agg(iid, ',' order by iid) from (select condition, iid from h group by 1, 2 having count(*) > 1) group by condition""")
def x4_predictions(spark, sf_dir):
    plan = run_folders(spark, sf_dir)
    read = [shared.stored(readers.predictions(plan, name), "predictions") for name in ("prediction.json", "prediction_audit.json")]  # four parts of the plan read them
    p = manifest.predictions(plan, *read)
    rows = lambda df, part, run, condition, json: df.select(F.lit(part).alias("part"), run.alias("run_id"), condition.alias("condition"), json.alias("json"))
    own, none = F.col("run_id"), F.lit(None).cast("string")
    out = rows(p.strict, "strict", own, F.col("condition"), F.col("json")).unionByName(rows(p.audit, "audit", own, F.col("condition"), F.col("json")))
    out = out.unionByName(rows(p.missing, "missing", own, none, F.regexp_extract("prediction_path", "(r[0-9]+/[^/]*)$", 1)))
    return out.unionByName(rows(p.duplicates, "duplicates", none, F.col("condition"), F.array_join("instance_ids", ",")))


@query("""with p as (select doc_id, case doc_id % 4 when 0 then '/abs/' || source || '/./f' || doc_id when 3 then 'no/../where' else './sub//' || source || '/../f' || doc_id end as path from documents)
select doc_id, case doc_id % 4 when 0 then case when doc_id % 3 = 0 then '/abs/' || source || '/f' || doc_id end when 1 then case when doc_id % 3 < 2 then '/root/sub/f' || doc_id when doc_id % 5 = 0 then '/cwd/sub/f' || doc_id end
  when 2 then case when doc_id % 3 < 2 then '/root/sub/f' || doc_id when doc_id % 5 = 0 then '/cwd/sub/f' || doc_id end end as path_resolved from documents""")
def h11_resolved_paths(spark, sf_dir):
    """Paths below one of two roots, absolute ones, and some that are nowhere."""
    d, i = table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id")
    n = i.cast("string")
    path = F.when(i % 4 == 0, F.concat(F.lit("/abs/"), "source", F.lit("/./f"), n)).when(i % 4 == 3, "no/../where").otherwise(F.concat(F.lit("./sub//"), "source", F.lit("/../f"), n))
    there = d.filter(i % 3 < 2).select(F.concat(F.lit("file:/root/sub/f"), n).alias("path")).unionByName(d.filter(i % 5 == 0).select(F.concat(F.lit("/cwd/sub/f"), n).alias("path"))).unionByName(d.filter(i % 3 == 0).select(F.concat(F.lit("file:///abs/"), "source", F.lit("/f"), n).alias("path")))
    return paths.resolved(d.select("doc_id", path.alias("path")), "path", there, ("/root", "/manifest", "/cwd"), strict=False).select("doc_id", "path_resolved")


@query("""with f as (select event_id, user_id % 20 as t, event_type as c, value, 'f' || event_id as name, case event_id % 6 when 0 then 'workspace/a' when 1 then '.tmp' when 2 then '.' when 3 then '..' when 4 then 'other' else 'workspacex' end as w from events),
r as (select distinct t, c from f), p as (select t, case w when '.' then c || '/' || case when event_id % 12 = 2 then 'patch.diff' else name end when '..' then name else c || '/' || w || '/' || name end as path, c as own, w, event_id from f where event_id % 9 <> 0)
select 't' || r.t || '_' || r.c as run_id, p.path from r join (select distinct t, path, own, w from p) p on p.t = r.t where not (p.own = r.c and (p.w in ('workspace/a', '.tmp') or p.path = r.c || '/patch.diff'))""")
def v8_writes_outside(spark, sf_dir):
    """Files of events as written by runs, four of a target beside each other: in the workspace, scoped folders, as known files, and astray."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/runs/t"), (F.col("user_id") % 20).cast("string")).alias("target"), F.col("event_type").alias("c"), (F.col("user_id") % 20).alias("t"))
    runs = e.select("target", "c", "t").distinct()
    runs = runs.select(F.concat(F.lit("t"), F.col("t").cast("string"), F.lit("_"), "c").alias("run_id"), F.concat("target", F.lit("/"), "c").alias("run_dir"), F.concat("target", F.lit("/"), "c", F.lit("/workspace")).alias("workspace_dir"), F.lit("2024-01-01").cast("timestamp").alias("since"))
    at = F.element_at(F.array(*map(F.lit, ("workspace/a", ".tmp", ".", "..", "other", "workspacex"))), (i % 6 + 1).cast("int"))
    name = F.when(i % 12 == 2, "patch.diff").otherwise(F.concat(F.lit("f"), i.cast("string")))
    files = e.select(F.concat_ws("/", F.lit("file:"), "target", "c", at, name).alias("path"), F.when(i % 9 != 0, F.lit("2024-06-01")).otherwise(F.lit("2023-06-01")).cast("timestamp").alias("modified"))
    files = files.groupBy(F.regexp_replace("path", "^file:/", "").alias("path")).agg(F.max("modified").alias("modified"))
    return paths.writes_outside(files, runs, (".tmp",), most=1 << 20)


# ---- sessions with tools, ids and warnings


LINES = """with w as (select 'u' || user_id as session, user_id, event_id as k, event_type as kind, ts, row_number() over (partition by user_id order by ts, event_id) as p from events), m as (select *, kind in ('click', 'purchase') as call, kind in ('view', 'error') as result, kind = 'signup' and k % 2 = 0 as normal from w where k % 13 <> 0),
s as (select *, sum(case when normal then 1 else 0 end) over (partition by session order by p) as seg, sum(case when normal or call then 1 else 0 end) over (partition by session order by p) as stop,
  last_value(case when call then k end ignore nulls) over (partition by session order by p rows between unbounded preceding and 1 preceding) as cid from m),
c as (select * from s where call), r as (select s.*, c.seg = s.seg as waits, c.p as cp from s left join c on c.session = s.session and c.k = s.cid where s.result),
f as (select session, cid, min(p) as first_r, max(p) as last_r from r where waits group by 1, 2), a as (select c.*, first_r, last_r from c left join f on f.session = c.session and f.cid = c.k),
b as (select *, coalesce(bool_or(first_r is null) over (partition by session, seg order by p rows between unbounded preceding and 1 preceding), false) as blocked from a),
o as (select session, seg, k, p, case when not blocked and first_r is not null then first_r else 1152921504606846976 end as k1, case when not blocked and first_r is not null then 1 else 2 end as k2, p as k3, 0 as k4 from b
  union all select r.session, r.seg, r.k, r.p, case when b.k is null or (not blocked and r.p > first_r) then r.p when not blocked then first_r else 1152921504606846976 end,
    case when b.k is null or not blocked then 1 else 3 end, case when b.k is null or (not blocked and r.p > first_r) then r.p else b.p end, case when b.k is null or (not blocked and r.p > first_r) then 0 else 1 end
    from r left join b on b.session = r.session and b.k = r.cid and r.waits where b.k is null or not blocked or r.p = last_r
  union all select session, seg, k, p, p, 1, p, 0 from s where normal),
t as (select session, seg, stop, string_agg('all done ' || k, chr(10) || chr(10) order by p) as said, max(k) as k, max(p) as p from s where kind = 'signup' and not normal group by 1, 2, 3)"""


@query(LINES + f""", tk as (select t.*, s.k as taker from t left join s on s.session = t.session and s.stop = t.stop + 1 and s.call),
x as (select o.*, s.kind, s.cid, tk.said from o join s on s.session = o.session and s.k = o.k left join tk on tk.session = o.session and tk.taker = o.k union all select session, seg, k, p, 1152921504606846976, 4, stop, 0, 'message', null, said from tk where taker is null)
select session as traj_id, row_number() over (partition by session order by seg, k1, k2, k3, k4) - 1 as idx, case kind when 'click' then 'code_action' when 'purchase' then 'api_action' when 'message' then 'message_action' else 'text_observation' end as class_,
  case when kind = 'purchase' then {S.pick(TOOLS, 'k')} end as function, case when kind = 'signup' then 'user' when kind in ('view', 'error') then coalesce(case when cid % 1 = 0 then (select case when kind = 'click' then 'Bash' else {S.pick(TOOLS, 'w.k')} end from w where w.k = x.cid) || ':t' || cid end, 'tool') end as name,
  case when kind = 'click' then said when kind = 'purchase' then coalesce(said || chr(10) || chr(10), '') || 'd' end as description, case when kind = 'message' then said end as message, p as line from x""")
def t3_session_tools(spark, sf_dir):
    """Sessions whose calls wait for their results: blocked ones, results that come twice, strays, text that a call takes or nothing does."""
    e = convert_session.events(raw_sessions(spark, sf_dir), use_parent_chain=False)
    return e.select("traj_id", F.col("idx").cast("long").alias("idx"), "class_", "function", "name", "description", F.when(F.col("class_") == "message_action", F.col("content")).alias("message"), F.col("provenance.raw_jsonl_line").cast("long").alias("line"))


@query(LINES + """, l as (select session, max(seg) as last from s group by 1), u as (
  select o.session, o.seg, k1, k2, k3, 'Unpaired tool_use ' || chr(39) || 't' || o.k || chr(39) || ' emitted without tool_result before ' || case when o.seg = last then 'end of trajectory' else 'normal user message' end as said from o join l using (session) where k2 = 2
  union all select o.session, o.seg, k1, k2, k3, 'tool_result ' || chr(39) || 't' || s.cid || chr(39) || ' had no pending tool_use ' || case when o.seg = last then 'at end of trajectory' else 'before normal user message' end from o join l using (session) join s on s.session = o.session and s.k = o.k where k2 = 3
  union all select o.session, o.seg, k1, k2, k3, 'tool_result ' || chr(39) || coalesce('t' || s.cid, '') || chr(39) || ' at line ' || o.p || ' had no pending tool_use' from o join s on s.session = o.session and s.k = o.k where s.result and k2 = 1 and k4 = 0)
select session, row_number() over (partition by session order by seg, k1, k2, k3) - 1 as n, said from u""")
def t3_warnings(spark, sf_dir):
    w = convert_session.convert(raw_sessions(spark, sf_dir), use_parent_chain=False).warnings
    return w.select("session", F.col("n").cast("long").alias("n"), "said")


def named_sessions(spark, sf_dir):
    """Conversations as sessions with one id, two ids, or none; some share theirs."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    n = F.col("conv_id").cast("string")
    own = F.when(F.col("conv_id") % 9 == 0, '"shared"').when(F.col("conv_id") % 3 == 0, F.concat(F.lit('"S'), n, F.lit('"'))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('"S'), n, F.lit("-"), (F.col("k") % 2).cast("string"), F.lit('"')))
    c = c.withColumn("k", k)
    value = F.concat(F.lit('{"uuid": "m'), F.col("k").cast("string"), F.lit('", "type":"user","message":{"role":"user","content": "k'), F.col("k").cast("string"), F.lit('"}'), F.coalesce(F.concat(F.lit(',"sessionId":'), own), F.lit("")), F.lit("}"))
    return c.select(F.concat(F.lit("/logs/c"), n, F.lit(".jsonl")).alias("session"), F.col("k").cast("int").alias("lineno"), F.parse_json(value).alias("rec"), value.alias("value"))


@query("""with c as (select conv_id, row_number() over (partition by conv_id order by turn) as k from conversations), g as (select conv_id, count(*) as n, '[' || string_agg('{"_jsonl_lineno": ' || k || ', "message": {"content": "k' || k || '", "role": "user"}, "type": "user", "uuid": "m' || k || '"}', ', ' order by k) || ']' as j from c group by 1),
i as (select conv_id, n, case when conv_id % 9 = 0 then 'shared' when conv_id % 3 = 0 then 'S' || conv_id when conv_id % 3 = 1 and n > 1 then 'c' || conv_id || '-' || left(sha256('S' || conv_id || '-0|S' || conv_id || '-1'), 12) when conv_id % 3 = 1 then 'S' || conv_id || '-1' else 'c' || conv_id || '-' || left(sha256(j), 12) end as id from g)
select '/logs/c' || conv_id || '.jsonl' as session, id, case when count(*) over (partition by id) > 1 then id || ' /logs/c' || conv_id || '.jsonl' else id end as traj_id, n as records, n as events from i""")
def t4_trajectory_ids(spark, sf_dir):
    c = convert_session.convert(named_sessions(spark, sf_dir), use_parent_chain=False)
    n = c.events.groupBy("traj_id").agg(F.count("*").alias("events"))
    return c.trajectories.join(n, "traj_id", "left").select("session", "id", "traj_id", F.get_json_object("details", "$.raw_record_count").cast("long").alias("records"), F.coalesce("events", F.lit(0)).alias("events"))
