"""Operators on small inline logs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trajloom.functions import variants
from trajloom.functions.json_udf import all_texts, canonical_json
from trajloom.functions.shared import ensure_checkpoint_dir
from trajloom.operators import audit, convert_bulk, convert_session, manifest, memory, render, strip
from trajloom.operators.events import as_events, empty_events
from trajloom.sources import readers, sinks
from trajloom.streaming import rowwise


def log(spark, *items):
    """Events of one trajectory from dictionaries."""
    names = ["class_", "source", "name", "content", "language", "function", "kwargs_json", "description", "reasoning_content"]
    rows = [("t", i, *(x.get(n) for n in names)) for i, x in enumerate(items)]
    return as_events(spark.createDataFrame(rows, "traj_id string, idx int, " + ", ".join(f"{n} string" for n in names)))


def user(text):
    return {"class_": "text_observation", "source": "user", "name": "user", "content": text}


def env(text, name=None):
    return {"class_": "text_observation", "source": "environment", "name": name, "content": text}


def bash(command):
    return {"class_": "code_action", "language": "bash", "content": command}


def api(function, **kwargs):
    return {"class_": "api_action", "function": function, "kwargs_json": json.dumps(kwargs)}


def test_strip_passes(spark):
    e = log(
        spark, user("fix"), bash("git status"), env("clean"), api("Edit", file_path="src/a.py", old_string="x", new_string="y"), env("snippet"), bash("pytest"), env("1 failed"), env("No files found"), user("more"),
        {"class_": "message_action", "content": "bye"}, api("Read", file_path=1), api("TodoWrite"), {**bash("ls src"), "reasoning_content": "hm"}, {"class_": "odd"},
    )
    got = {r["idx"]: (r["decision"], list(r["reason_codes"]), r["new_idx"]) for r in strip.decide(e).collect()}
    assert [got[i][0] for i in range(14)] == ["keep", "drop", "drop", "keep", "drop", "keep", "keep", "drop", "drop", "drop", "keep", "drop", "keep", "keep"]
    assert got[2][1] == ["drop.observation_after_dropped_action"] and got[4][1] == ["drop.edit_tool_result_snippet"] and got[7][1] == ["drop.environment_observation_noise"]
    assert got[8][1] == ["drop.additional_user_message_default_off"] and got[12][1] == ["strip.reasoning_content_field_removed", "keep.diagnostic_command"] and got[13][1] == ["keep.unknown_item_class"]
    assert [got[i][2] for i in (0, 3, 5, 6, 10, 12, 13)] == list(range(7))
    kept = strip.stripped(strip.decide(e)).orderBy("idx").collect()
    assert [r["original_idx"] for r in kept] == [0, 3, 5, 6, 10, 12, 13] and all(r["reasoning_content"] is None for r in kept)
    m = strip.manifest(strip.decide(e)).first()
    assert m["decision_counts"] == {"drop": 7, "keep": 7} and m["index_map"][12] == 5
    loose = strip.StripConfig(include_final_message=True, keep_additional_user_messages=True, include_todowrite=True)
    assert strip.decide(e, loose).filter("decision = 'keep'").count() == 10
    assert strip.decide(empty_events(spark)).count() == 0


def test_evidence_follows_the_manifest(spark):
    d = strip.decide(log(spark, user("x"), bash("pytest"), env("ok"), bash("git status"), env("y")))
    ev = spark.createDataFrame([("t", 1, 2), ("t", 3, 4), ("t", None, 2)], "traj_id string, source_action_index int, observation_index int")
    assert [(r["source_action_index"], r["observation_index"]) for r in strip.filter_evidence(ev, d).collect()] == [(1, 2)]


def test_memory_children_and_text(spark):
    e = log(
        spark, user("repo: a/b\ninstance_id: i1\nproblem_statement: it breaks\nbadly"), api("Read", file_path="./src/a.py"), env("code"), api("Grep", pattern="it's", path="src"), env("hit"), api("Read", file_path="src/a.py"),
        bash("pytest tests"), env("FAILED x\nFAILED x\nE  y"), api("MultiEdit", file_path="src/a.py", edits=[{"old_string": "a", "new_string": "b"}, {"old_string": "", "new_string": "c"}]), api("Write", file_path="tmp/x.py", content="z"),
        bash("echo " + "q" * 600), {"class_": "message_action", "content": "first"}, {"class_": "message_action", "content": "all done"},
    )
    files = {r["path"]: r for r in memory.inspected(e).collect()}
    assert files["src/a.py"]["raw_paths"] == ["./src/a.py", "src/a.py"] and files["src/a.py"]["action_counts"] == {"Read": 2}
    assert [(r["tool"], r["subedit_index"], r["edit_category"]) for r in memory.edits(e).orderBy("action_index", "subedit_index").collect()] == [("MultiEdit", 0, "source"), ("MultiEdit", 1, "source"), ("Write", None, "scratch")]
    assert [(r["line"], r["bucket"]) for r in memory.failures(e).orderBy("line_no").collect()] == [("FAILED x", "test_failures"), ("E  y", "test_failures")]
    assert memory.failures(e, memory.MemoryConfig(max_failures=1)).first()["skipped"] == 1
    text = render.memory_text(e).first()["rendered_text"]
    titles = ["SOURCE", "PRIOR PROBLEM", "FILES INSPECTED", "SEARCH ANCHORS", "TEST / DIAGNOSTIC / OTHER COMMANDS", "OBSERVED TEST / RUNTIME FAILURES", "RELEVANT OBSERVATION EXCERPTS", "SOURCE EDIT EVIDENCE", "PRIOR AGENT FINAL MESSAGE", "INJECTION WARNING"]
    places = [text.index(f"\n{t}\n{'-' * len(t)}\n") for t in titles]
    assert places == sorted(places)
    for part in ("- repo: a/b", "it breaks\nbadly", "- src/a.py [Read: 2]", 'pattern="it\'s"', "- [test] pytest tests", "- FAILED x\n- E  y", "[Read Result after action #1]\n  code", "Tool: MultiEdit action #8", "all done", "[... truncated ...]"):
        assert part in text, part


def budget(lines, most_lines, most):
    """Line by line, as the rule is worded."""
    out, total = [], 0
    for line in lines:
        if len(out) >= most_lines or total >= most:
            break
        out.append(line[: most - total])
        total += len(out[-1])
    return out


def test_command_budget(spark):
    rng = random.Random(3)
    cfg = memory.MemoryConfig(max_rendered_commands=5, max_rendered_command_total_chars=120)
    for _ in range(4):
        commands = [f"echo {'x' * rng.randint(0, 60)}" for _ in range(8)]
        e = log(spark, *(bash(c) for c in commands))
        got = [r["line"] for r in memory.budgeted_commands(memory.commands(e, cfg), cfg).orderBy("action_index").collect()]
        assert got == budget([f"- [other/reproduction] {c}" for c in commands], 5, 120)


def test_bulk_conversion_and_parity(spark):
    call = lambda name, args: {"id": "c1", "type": "function", "function": {"name": name, "arguments": args}}
    messages = [
        {"role": "system", "content": "s"}, {"role": "user", "content": None}, {"role": "assistant", "content": " go ", "tool_calls": [call("think", '{"thought": "t"}'), call("x", "[1]"), call("y", "plain"), call(None, None)]},
        {"role": "tool", "content": "r", "tool_call_id": "c1"}, {"role": "assistant", "content": " "}, {"role": "assistant", "content": "done"}, {"role": "alien", "content": "?"},
    ]
    rows = spark.createDataFrame([{"trajectory_id": "a", "trajectory": messages, "resolved": 1}, {"trajectory_id": "b", "trajectory": []}], convert_bulk.ROW)
    got = convert_bulk.events(rows).orderBy("idx").collect()
    assert [r["class_"] for r in got] == ["text_observation"] * 2 + ["api_action"] * 4 + ["text_observation", "message_action", "text_observation"]
    assert [json.loads(r["kwargs_json"]) for r in got[2:6]] == [{**k, "_openhands_tool_call_id": "c1", "_openhands_tool_call_type": "function"} for k in ({"thought": "t"}, {"value": [1]}, {"value": "plain"}, {})]
    assert got[2]["reasoning_content"] == "t" and got[2]["description"] == "go" and got[5]["function"] == "unknown_tool" and got[6]["name"] == "c1" and got[8]["name"] == "unknown_role:alien"
    assert convert_bulk.parity(rows, convert_bulk.events(rows)).count() == 0
    assert [r["error"] for r in convert_bulk.parity(rows, convert_bulk.events(rows).filter("idx <> 3")).collect()] == ["number of calls"]
    clean = json.loads(convert_bulk.clean_messages(rows).filter("trajectory_id = 'a'").select(F.to_json("trajectory").alias("j")).first()["j"])
    assert set(clean[0]) == {"role", "content"} and "tool_call_id" in clean[3]
    assert convert_bulk.details(rows, "d").filter("trajectory_id = 'a'").first()["details"]["resolved"] == "1"


def records(spark, *lines):
    return spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(lines, 1)], "session string, lineno int, j string").select("session", "lineno", F.parse_json("j").alias("rec"))


def message(uuid, parent, role, content):
    return {"uuid": uuid, "parentUuid": parent, "type": role, "sessionId": "S", "message": {"role": role, "content": content}}


def test_live_branch(spark):
    ensure_checkpoint_dir(spark)
    lines = [message("1", None, "user", "a"), message("2", "1", "assistant", "dead"), message("3", "1", "assistant", "live"), message("4", "3", "user", "b"), {"type": "summary", "leafUuid": "missing", "summary": "x"}]
    got = [r["lineno"] for r in convert_session.linear(records(spark, *lines)).orderBy("pos").collect()]
    assert got == [1, 3, 4]
    cycle = [message("1", "2", "user", "a"), message("2", "1", "assistant", "b")]
    assert convert_session.linear(records(spark, *cycle)).count() == 2
    broken = [message(str(i), str(i - 1) if i != 5 else "gone", "user", "x") for i in range(1, 7)]
    assert convert_session.linear(records(spark, *broken)).count() == 6
    long = [message(str(i), str(i - 1) if i > 1 else None, "user", "x") for i in range(1, 300)]
    assert convert_session.linear(records(spark, *long)).count() == 299


def test_session_events(spark):
    ensure_checkpoint_dir(spark)
    use = lambda i, name="Read", **kw: {"type": "tool_use", "id": i, "name": name, "input": kw}
    result = lambda i, text: {"type": "tool_result", "tool_use_id": i, "content": [{"type": "text", "text": text}]}
    lines = [
        message("1", None, "user", "please"), message("2", "1", "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "reading"}, use("A", file_path="a"), use("B", "Bash", command="ls", description="list")]),
        message("3", "2", "user", [result("B", "b out")]), message("4", "3", "user", [result("A", "a out")]), message("5", "4", "assistant", [{"type": "text", "text": "half"}, use("C")]), message("6", "5", "user", "stop"), message("7", "6", "assistant", [{"type": "text", "text": "bye"}]),
    ]
    got = convert_session.events(records(spark, *lines)).orderBy("idx").collect()
    assert [(r["class_"], r["content"] or r["function"]) for r in got] == [
        ("text_observation", "please"), ("api_action", "Read"), ("text_observation", "a out"), ("code_action", "ls"), ("text_observation", "b out"), ("api_action", "Read"), ("text_observation", "stop"), ("message_action", "bye"),
    ]
    assert got[1]["description"] == "reading" and got[1]["reasoning_content"] == "hm" and got[3]["description"] == "list" and got[2]["name"] == "Read:A"
    d = convert_session.session_details(records(spark, *lines), convert_session.linear(records(spark, *lines))).first()
    assert d["session_ids"] == ["S"] and d["raw_record_count"] == 7


def fifo(stream):
    """Parallel calls one by one: a queue of calls; results kept by id, the later of two, until their call is at its head; a result without an id is the head's."""
    out, queue, held = [], [], {}
    for p, kind, i in stream:
        if kind == "action":
            queue.append((p, i))
        elif any(i == q for _, q in queue) or (i == "" and queue):
            held[i if any(i == q for _, q in queue) else queue[0][1]] = p
            while queue and queue[0][1] in held:
                q, j = queue.pop(0)
                out += [q, held.pop(j)]
        else:
            out.append(p)
    return out + [q for q, _ in queue] + list(held.values())


def test_parallel_calls(spark):
    """Segments of calls and results in any order, with ids that are missing or come twice."""
    rng, rows, want = random.Random(8), [], {}
    for s in range(120):
        ids = [rng.choice(["a", "b", ""]) if s % 3 == 0 else str(i) for i in range(rng.randint(0, 5))]
        results = [("result", i if rng.random() < 0.8 else "") for i in ids if rng.random() < 0.8] + [("result", i) for i in ids if s % 3 and rng.random() < 0.2]
        stream = [("action", i) for i in ids] + results + ([("result", "no")] if rng.random() < 0.3 else [])
        rng.shuffle(stream)
        numbered = [(p, k, i) for p, (k, i) in enumerate(stream, 1)]
        want[s] = fifo(numbered)
        rows += [(s, 0, p, k, i) for p, k, i in numbered]
    got: dict = {s: [] for s in want}
    calls = spark.createDataFrame(rows, "session int, seg int, p long, kind string, id string")
    for r in convert_session.queued(calls).filter("not dropped").orderBy("session", "k1", "k2", "k3", "k4").collect():
        got[r["session"]].append(r["p"])
    assert got == want


def test_pairs_and_prompts(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "instance_id string")
    related = spark.createDataFrame([("r__1", "o/r", "c", "broken"), ("r__2", "o/r", "d", "bad")], "instance_id string, repo string, base_commit string, problem_statement string")
    rel = spark.createDataFrame([("e2", "r__1"), ("e1", "r__1"), ("e1", "r__1"), ("e9", "r__2"), ("e3", "r__2")], "experience_instance_id string, related_instance_id string")
    index = spark.createDataFrame([("e1", "t1"), ("e2", "t2")], "prior_instance_id string, prior_trajectory_id string")
    p = manifest.pairs(rel, ids("e1", "e2", "e3"), related, index)
    assert [(r["experience_instance_id"], r["related_instance_id"]) for r in p.collect()] == [("e1", "r__1")]
    assert manifest.pairs(rel, ids("e1", "e2", "e3"), related, index, one_per_target=False).count() == 2
    files = spark.createDataFrame([("/x/000_t1_abcdefg.txt", ""), ("/x/b.txt", "- trajectory_id: t1\n")], "path string, value string")
    keys = manifest.injection_index(files)
    assert {r["key"]: r["path"] for r in keys.collect()}["t1"] == "/x/b.txt"
    runs = manifest.runs(manifest.with_injections(p, {"raw": keys, "adp": keys, "memory": keys}))
    assert {r["condition"]: r["injection_file"] for r in runs.collect()} == {"no_memory": None, "raw": "/x/b.txt", "adp": "/x/b.txt", "memory": "/x/b.txt"}
    full = render.prompts(runs.withColumn("injection_text", F.when(F.col("condition") != "no_memory", "seen before")))
    rows = {r["condition"]: r for r in full.collect()}
    assert rows["raw"]["prompt"].endswith("intended patch applied.\n") and "\n\nseen before\nEND_PRIOR_CONTEXT\n" in rows["raw"]["prompt"] and rows["no_memory"]["prior_context_chars"] == 0
    assert manifest.incomplete_targets(full).count() == 0 and audit.prompt_checks(full).count() == 0
    assert manifest.incomplete_targets(full.filter("condition <> 'raw'")).count() == 1
    with pytest.raises(Exception, match="an injection is needed"):
        render.prompts(runs.withColumn("injection_text", F.lit(""))).collect()
    with pytest.raises(Exception, match="not unique"):
        manifest.pairs(rel, ids("e1"), related, index.unionByName(index)).collect()
    plan = manifest.ordered_plan(runs, ("memory", "raw"), most=1)
    assert [r["run_id"] for r in plan.collect()] == ["r__1__memory"]
    done = spark.createDataFrame([("r__1__memory", "success")], "run_id string, status string")
    assert manifest.to_do(plan, done).count() == 0 and manifest.report(plan, done).first()["status_counts"] == {"success": 1}


def test_json_functions(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": "x \\r\\ny", "é": [1e-7, null]}',), ("no",), (None,)], "j string")
    assert [r[0] for r in df.select(canonical_json(F.col("j"))).collect()] == ['{"a":"x\\ny","b":1.0,"é":[1e-07,null]}', None, None]
    one = spark.createDataFrame([('{"a": {"b": "c"}, "s": "d"}', '[{"type": "text", "text": "x"}, "y", {"content": [{"text": "z"}]}]')], "j string, k string")
    assert one.select(all_texts(F.col("j"), ("s",))).first()[0] == ["__KEY__:a", "__KEY__:b", "c"]
    assert one.select(variants.flat_text(F.parse_json("k"))).first()[0] == 'x\n"y"\n{"text": "z"}'


def test_text_of_contents(spark):
    """Literal cases: only blocks of type text give their text; other items of lists are JSON, strings among them."""
    cases = {
        '["a", null, {"type":"x","text":"t","content":"c"}, 5, ["n"]]': '"a"\nnull\nc\n5\n["n"]', '"plain"': "plain", "null": "", "[]": "", '{"b":1,"a":"x, y: z"}': '{"a": "x, y: z", "b": 1}',
        '[{"type":"text","text":"t"},{"content":[{"type":"text","text":"u"},{"content":null}]},{"type":"image","b":1,"a":[1,2]}]': 't\nu\n\n{"a": [1, 2], "b": 1, "type": "image"}', "true": "True", "7": "7", '[{"type":"text"}]': "",
    }
    for depth in (1, 3, 4, 5, 6, 12, 100):
        cases['[{"content":' * depth + '[{"type":"text","text":"deep"},{"b":1,"a":"x, y"}]' + "}]" * depth] = 'deep\n{"a": "x, y", "b": 1}'
    df = spark.createDataFrame(list(cases.items()), "j string, want string")
    assert [r for r in df.select("j", "want", variants.content_text(F.parse_json("j")).alias("got")).collect() if r["got"] != r["want"]] == []
    df = df.filter("length(j) < 200 and j not like '%deep%'")
    assert [r for r in df.select("j", "want", variants.flat_text(F.parse_json("j")).alias("got")).collect() if r["got"] != r["want"]] == []
    assert df.limit(1).select(variants.without_keys(F.parse_json(F.lit('{"description":"d","b":[1],"a":null}')), "description")).first()[0] == '{"a":null,"b":[1]}'
    assert df.limit(1).select(variants.detail(F.parse_json(F.lit('{"b":"é","a":1}')))).first()[0] == '{"a": 1, "b": "é"}'


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_bytes(b'{"x": 1}\n\n{"x": 2}\r\nbad\n[1]\n')
    raw = readers.lines(spark, str(tmp_path / "in"))
    assert [(r["lineno"], r["error"]) for r in readers.bad_lines(raw).orderBy("lineno").collect()] == [(4, "invalid JSON"), (5, "not an object")]
    assert [r["lineno"] for r in readers.jsonl(spark, str(tmp_path / "in"), strict=False).orderBy("lineno").collect()] == [1, 3]
    with pytest.raises(Exception, match=r"a\.jsonl:4: invalid JSON"):
        readers.jsonl(spark, str(tmp_path / "in")).filter("rec is not null").collect()
    df = spark.range(1200).select(F.col("id"), F.lit(None).cast("string").alias("n"))
    sinks.jsonl(df.coalesce(1), str(tmp_path / "out"), rows_per_file=500)
    assert len(list((tmp_path / "out").glob("*.gz"))) == 3 and readers.jsonl(spark, str(tmp_path / "out"), "*.gz").count() == 1200
    sinks.csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1200
    sinks.texts(spark.createDataFrame([("k1", "a\nb"), ("k2", "c")], "k string, t string"), str(tmp_path / "texts"), "k", "t")
    assert {r["value"] for r in readers.text_folder(spark, str(tmp_path / "texts")).collect()} == {"a\nb\n", "c\n"}
    assert sinks.report(df.agg(F.count("*").alias("rows")), str(tmp_path / "report")) == {"rows": 1200}
    assert readers.first_file(spark, str(tmp_path), "*.jsonl").endswith("a.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.first_file(spark, str(tmp_path), "*.none")


def test_zstd_lines(spark, tmp_path):
    import zstandard

    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"x": 1}\n{"x": 2}\n'))
    assert readers.jsonl(spark, str(tmp_path)).count() == 2


def test_stream_sees_each_file_once(spark, tmp_path):
    e = log(spark, bash("pytest"), env("No files found"), user("x"))
    e.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = rowwise.scrubbed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
        rowwise.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("idx").collect()
    assert [(r["command_class"], r["noise"]) for r in got] == [("test", False), (None, True), (None, False)]


def test_audits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b"), (5, None)], "k int, v string")
    assert [(r["v"], r["n"]) for r in audit.most_common(df, "v", order="k").collect()] == [("b", 2), (None, 2), ("a", 1)]
    assert audit.presence(df, df.filter("k > 2").unionByName(spark.createDataFrame([(9, "z")], df.schema)), "k").first().asDict() == {"in_both": 3, "left_only": 2, "right_only": 1}
    hits = audit.forbidden_hits(spark.createDataFrame([(1, "ok\nsee .claude/x\n /.claude/"), (2, "fine")], "k int, t string"), "k", "t").collect()
    assert [(r["pattern"], r["line"]) for r in hits] == [("claude_dir", 3)]
