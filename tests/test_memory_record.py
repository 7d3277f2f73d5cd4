"""Whole memory records, sessions with ids and details, trajectories written and read back: hand-written cases and round trips."""

import functools
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trajloom.functions.json_udf import canonical_json
from trajloom.operators import adp, convert_session, memory, memory_record, render, safe
from trajloom.sources import sinks

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
canonical = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def api(function, reasoning=None, **kwargs):
    return {"class_": "api_action", "function": function, "kwargs": kwargs, "description": f"do {function}".strip()} | ({"reasoning_content": reasoning} if reasoning else {})


bash = lambda c: {"class_": "code_action", "language": "bash", "content": c, "description": ""}
seen = lambda t: {"class_": "text_observation", "source": "environment", "name": "x", "content": t}
TRAJECTORY = {
    "schema_version": "1.1.0",
    "id": "T",
    "content": [
        {"class_": "text_observation", "source": "user", "name": "user", "content": "please fix  \nit"},
        api("Read", "why not", file_path="./src/a.py"), seen("def f():\n    pass"),
        api("Grep", pattern="it's", path="src//b", glob="*.py"), seen("No such thing"),
        api("Edit", file_path="src/a.py", old_string="x", new_string="y"), seen("ok"),
        api("MultiEdit", file_path="tests/test_a.py", edits=[{"old_string": "", "new_string": "n"}, 5, {"old_string": "o"}]), seen("ok"),
        bash("pytest -q"), seen("FAILED tests/test_a.py::t - assert 0\nE   assert 0"),
        api("TodoWrite", todos=[{"b": 1, "a": "z "}]), api("Write", file_path="debug.py", content="1"), api("Fly"), api(""), {"class_": "odd"}, 7,
        {"class_": "message_action", "content": "all done", "description": ""},
    ],
    "details": {"issue_metadata": {"repo": "o/r"}, "models": ["m1"], "warnings": ["careful"], "source_file": "s.jsonl"},
}


@functools.cache
def whole_record(spark):
    return records(spark, TRAJECTORY, cfg=memory.MemoryConfig(include_todowrite=True, include_reasoning=True, hashes_only=True))[0]


def records(spark, *lines, cfg):
    df = spark.createDataFrame([("/in/a.jsonl", i + 1, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "src_file string, lineno int, value string")
    t = adp.trajectories(df)
    return [json.loads(r["json"]) for r in memory_record.record_json(memory_record.records(t, adp.events(t), cfg)).orderBy("source_trajectory_id").collect()]


def test_every_part(spark):
    m = whole_record(spark)
    assert list(m) == ["memory_schema_version", "source_trajectory_id", "source_schema_version", "renderer", "source_metadata", "prior_problem", "files", "search_anchors", "commands", "observed_failures", "observation_evidence", "edits", "planning_actions", "reasoning", "prior_agent_final_message", "rendered_text", "quality"]
    assert m["renderer"]["source_trajectory_sha256"] == sha(canonical(TRAJECTORY | {"content": [x | {"content": "please fix\nit"} if i == 0 else x | {"kwargs": {"todos": [{"b": 1, "a": "z"}]}} if i == 11 else x for i, x in enumerate(TRAJECTORY["content"])]}))
    assert list(m["renderer"]["flags"]) == list(memory_record.FLAGS) and m["renderer"]["flags"]["edit_body_mode"] == "hashes-only" and m["renderer"]["flags"]["max_observed_failure_lines"] == 80
    assert m["source_metadata"] == {"repo": "o/r", "instance_id": "", "base_commit": "", "model": "m1", "source_file": "s.jsonl"}
    assert m["prior_problem"] == {"problem_statement": "please fix\nit", "raw_user_prompt": "please fix\nit", "source": "first_user_text_observation", "sha256": sha("please fix\nit"), "raw_user_prompt_sha256": sha("please fix\nit"), "truncated": False, "raw_user_prompt_truncated": False}
    assert [f["path"] for f in m["files"]["inspected"]] == ["src/a.py", "src/b"] and [(f["path"], f["edit_category"], f["actions"]) for f in m["files"]["edited"]] == [("src/a.py", "source", ["Edit"]), ("tests/test_a.py", "test", ["MultiEdit"]), ("debug.py", "scratch", ["Write"])]
    assert m["search_anchors"] == [{"action_index": 3, "tool": "Grep", "pattern": "it's", "path": "src/b", "raw_path": "src//b", "glob": "*.py", "prior_agent_description": "do Grep"}]
    assert list(m["commands"]) == list(memory.COMMAND_BUCKETS.values()) and [c["command"] for c in m["commands"]["test_commands"]] == ["pytest -q"] and m["commands"]["setup_commands"] == []
    assert list(m["observed_failures"]) == list(memory_record.FAILURE_BUCKETS) and len(m["observed_failures"]["test_failures"]) == 2
    assert [(e["source_action_index"], e["kind"]) for e in m["observation_evidence"]] == [(1, "read_result"), (3, "grep_result"), (9, "test_output")]
    assert [len(m["edits"][b]) for b in memory.EDIT_BUCKETS.values()] == [1, 2, 1, 0, 0] and m["edits"]["test_edits"][1]["subedit_index"] == 2 and "subedit_index" not in m["edits"]["source_edits"][0]
    assert m["planning_actions"][0]["payload"] == '{"todos":[{"a":"z","b":1}]}' and m["reasoning"] == [{"action_index": 1, "item_class": "api_action", "text": "why not", "sha256": sha("why not"), "truncated": False}]
    assert m["prior_agent_final_message"] == {"text": "all done", "sha256": sha("all done"), "truncated": False, "included_in_rendered_text": True}
    assert m["quality"] == {
        "warnings": ["[source] careful", memory_record.FALLBACK, "[14] api_action has empty function", "Skipped 3 unhandled item classes/functions"],
        "excluded_reasoning_content": False, "excluded_todowrite": False, "excluded_submission_artifacts_count": 0, "excluded_scratch_edits_count": 1, "unknown_type_count": 3,
    }
    text = m["rendered_text"]
    assert "- repo: o/r\n- instance_id: \n" in text.replace("- instance_id:\n", "- instance_id: \n") and "- model: m1" in text and "PRIOR PROBLEM\n-------------\nplease fix\nit\n" in text
    assert "- [3] Grep pattern=\"it's\" path='src/b' glob='*.py' prior_agent_description='do Grep'" in text and "- [test] pytest -q" in text


def test_fallbacks_errors_and_limits(spark):
    stated = TRAJECTORY | {"id": "A", "details": {"issue_metadata": {"problem_statement": "s" * 10}}, "content": []}
    cfg = memory.MemoryConfig(max_problem_chars=4, max_failures=1, max_evidence=1, keep_excluded_edit_details=False)
    got = records(spark, stated, "{bad", [1], {"id": "B", "content": {}}, {"content": []}, TRAJECTORY | {"id": "A"}, TRAJECTORY, cfg=cfg)
    by = {m["source_trajectory_id"]: m for m in got}
    assert sorted(by) == ["/in/a.jsonl:line-6", "A", "B", "T", "line-2", "line-3", "line-5"]
    assert (by["A"]["prior_problem"]["problem_statement"], by["A"]["prior_problem"]["truncated"], by["A"]["prior_problem"]["source"]) == ("ssss", True, "issue_metadata.problem_statement") and by["A"]["source_metadata"]["source_file"] == "a.jsonl"
    assert by["line-5"]["quality"]["warnings"] == [memory_record.NO_PROBLEM] and by["line-5"]["prior_problem"]["source"] == "missing" and "(not found)" in by["line-5"]["rendered_text"]
    errors = {"line-2": "invalid JSON", "line-3": "not an object", "B": "content is no list", "/in/a.jsonl:line-6": "the id of an earlier line"}
    for k, e in errors.items():
        assert by[k]["quality"]["warnings"] == [f"CONVERTER ERROR: {e}"] and by[k]["rendered_text"] == "" and "source_metadata" not in by[k] and by[k]["commands"]["test_commands"] == []
    with pytest.raises(ValueError, match="max_reasoning_chars"):
        memory.MemoryConfig(max_reasoning_chars=-1)
    few = by["T"]
    assert few["quality"]["warnings"][-3:-1] == ["observed_failures capped at max_observed_failure_lines=1", "observation_evidence capped at max_observation_evidence_items=1; skipped=2"]
    assert few["edits"]["scratch_edits"] == [] and few["quality"]["excluded_scratch_edits_count"] == 1 and few["quality"]["excluded_todowrite"] and few["planning_actions"] == []


def test_records_can_be_stripped(spark):
    """All ten parts of a record, cut by a manifest that keeps the first actions and what was seen after them."""
    m = whole_record(spark)
    df = spark.createDataFrame([(json.dumps(m),)], "j string").select(F.from_json("j", safe.MEMORY).alias("m")).select("m.*")
    decisions = spark.createDataFrame([("T", i, "text_observation" if i in (2, 4, 6, 8, 10) else "api_action", "keep" if i < 7 else "drop") for i in range(18)], "traj_id string, idx int, class_ string, decision string")
    r = safe.strip_memory(df, decisions).first()
    assert [f["path"] for f in r["files"]["inspected"]] == ["src/a.py", "src/b"] and [f["path"] for f in r["files"]["edited"]] == ["src/a.py"]
    assert len(r["search_anchors"]) == 1 and len(r["observation_evidence"]) == 2 and r["commands"]["test_commands"] == [] and r["observed_failures"]["test_failures"] == []
    assert len(r["edits"]["source_edits"]) == 1 and r["edits"]["test_edits"] == [] and r["edits"]["scratch_edits"] == [] and r["planning_actions"] == [] and r["reasoning"] == []
    assert r["prior_agent_final_message"]["stripped"] and r["prior_agent_final_message"]["text"] == "" and r["strip_error"] is None
    want = "\n".join([
        *safe.MEMORY_HEAD.split("\n"), "", "SOURCE", "------", "- trajectory_id: T", "- repo: o/r", "- instance_id:", "- base_commit:", "", "PRIOR PROBLEM", "-------------", "please fix", "it", "", "FILES INSPECTED", "---------------", "- src/a.py", "- src/b",
        "", "SEARCH ANCHORS", "--------------", "- [3] Grep pattern=\"it's\" path='src/b' glob='*.py'", "", "TEST / DIAGNOSTIC / OTHER COMMANDS", "-" * 34, "(none)", "", "OBSERVED TEST / RUNTIME FAILURES", "-" * 32, "(none)",
        "", "RELEVANT OBSERVATION EXCERPTS", "-" * 29, "- [read_result after action #1]", "  def f():", "      pass", "- [grep_result after action #3]", "  No such thing", "", "SOURCE EDIT EVIDENCE", "-" * 20,
        "- src/a.py", f"  old_text_sha256: {sha('x')}", f"  new_text_sha256: {sha('y')}",
    ])
    assert r["rendered_text"].startswith(want)


def test_python_literals(spark):
    texts = ["a\x00b", "\x1f\x7f", "tab\tline\nret\r", "it's", 'q"it\'s', "é\xa0\xad", "\\x", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", render.quoted(F.col("t")).alias("q")).collect()
    assert [r for r in got if r["q"] != repr(r["t"])] == []


def session(spark, *files):
    rows = [(name, i + 1, json.dumps(r)) for name, lines in files for i, r in enumerate(lines)]
    return spark.createDataFrame(rows, "session string, lineno int, value string").withColumn("rec", F.parse_json("value"))


def message(k, role, content, **more):
    return {"uuid": f"m{k}", "parentUuid": f"m{k - 1}" if k > 1 else None, "type": role, "message": {"role": role, "content": content, "model": "M"}} | more


def test_converted_sessions(spark, tmp_path):
    use = lambda i, name="Read", **kw: {"type": "tool_use", "id": i, "name": name, "input": kw}
    result = lambda i, t: {"type": "tool_result", "tool_use_id": i, "content": t}
    one = [
        {"type": "summary", "summary": "sum"}, message(1, "user", "repo: o/r\nproblem_statement: it", sessionId="S"), message(2, "assistant", [use("a", "Grep", pattern="p"), {"type": "odd", "x": 1}], sessionId="S"),
        message(3, "user", [result("a", "first")], toolUseResult={"n": 1}), message(4, "assistant", [use("a", "Glob", pattern="q"), use("b")]), message(5, "user", [result("b", "early")]), message(6, "user", [result("b", "late")]),
        message(7, "user", [result("a", "second"), result("zz", "stray")]), message(8, "assistant", [use("c")]), {"type": "file-history-snapshot"},
    ]
    two = [message(1, "user", "hello", sessionId="S")]
    three = [message(1, "user", "no id", n=1.0), message(2, "assistant", "é")]
    c = convert_session.convert(session(spark, ("/logs/one.jsonl", one), ("/logs/two.jsonl", two), ("/logs/three.x.jsonl", three)), use_parent_chain=False)
    t = {r["session"]: r for r in c.trajectories.collect()}
    digest = sha(json.dumps([r | {"_jsonl_lineno": i + 1} for i, r in enumerate(three)], sort_keys=True, ensure_ascii=False))[:12]
    assert {k: (r["id"], r["traj_id"]) for k, r in t.items()} == {"/logs/one.jsonl": ("S", "S /logs/one.jsonl"), "/logs/two.jsonl": ("S", "S /logs/two.jsonl"), "/logs/three.x.jsonl": (f"three.x-{digest}", f"three.x-{digest}")}
    d = json.loads(t["/logs/one.jsonl"]["details"])
    assert d["tool_use_id_to_function"] == {"a": "Glob", "b": "Read", "c": "Read"} and d["raw_tool_inputs_by_id"]["a"] == {"pattern": "q"} and d["raw_tool_results_by_id"]["zz"]["content"] == "stray"
    assert d["summary"] == ["sum"] and d["issue_metadata"] == {"repo": "o/r", "problem_statement": "it"} and d["models"] == ["M"] and d["raw_record_count"] == 10 and d["message_record_count"] == 8 and d["file_history_snapshot_count"] == 1
    assert d["warnings"] == ["Unknown assistant content block type 'odd' at line 3", "tool_result 'zz' at line 8 had no pending tool_use", "Unpaired tool_use 'c' emitted without tool_result before end of trajectory"]
    e = c.events.filter("traj_id = 'S /logs/one.jsonl'").orderBy("idx").collect()
    # the first Grep's result says Grep, though its id is Glob's later; of two results of b, which waits behind a, the later counts
    assert [(r["function"], r["name"], r["content"]) for r in e if r["class_"] in ("api_action", "text_observation")][1:] == [
        ("Grep", None, None), (None, "Grep:a", "first"), ("Glob", None, None), (None, "Glob:a", "second"), ("Read", None, None), (None, "Read:b", "late"), (None, "tool:zz", "stray"), ("Read", None, None),
    ]

    lines = convert_session.adp_lines(c)
    back = adp.trajectories(lines.select(F.concat("session", F.lit("x")).alias("src_file"), F.lit(1).alias("lineno"), F.col("json").alias("value")))
    assert back.filter("error is not null").count() == 1  # the id that two files have
    same = adp.events(adp.trajectories(lines.filter("session not like '%two%'").select(F.col("session").alias("src_file"), F.lit(1).alias("lineno"), F.col("json").alias("value"))))
    norm = lambda df: sorted(str([r["idx"], r["class_"], r["source"], r["content"], r["function"], json.loads(r["kwargs_json"] or "null"), r["description"], r["provenance"]]) for r in df.collect())
    assert norm(same.drop("original_idx")) == norm(c.events.filter("traj_id not like '%two%'"))
    sinks.documents(lines.withColumn("stem", F.regexp_replace(F.substring_index("session", "/", -1), r"\.jsonl$", "")), str(tmp_path / "adp"), "stem", "json")
    names = sorted(p.name for p in (tmp_path / "adp").glob("*.json"))
    assert names == ["one.adp.json", "three.x.adp.json", "two.adp.json"] and json.loads((tmp_path / "adp/two.adp.json").read_text())["content"][0]["content"] == "hello"
    assert (tmp_path / "adp/one.adp.json").read_text().startswith('{\n  "schema_version": "1.1.0",\n  "id": "S",\n  "content": [\n    {\n      "class_": "text_observation",')


def test_canonical_json_of_records(spark):
    """Unsorted and repeated keys, blanks at line ends, other scripts, numbers of all kinds, against Python's own."""
    texts = ['{"b":1,"a":{"d":[1.5,1e-7,1E3,-0.0],"c":"x  \\r\\ny\\t"}}', '{"k":1,"k":2}', '{"é":"\\u00e9\\ud83d\\ude00","z":null,"t":true}', '[{"b":[],"a":{}}]', '"s "', "12345678901234567890", '{"a b ":" \\n "}']

    def tidy(v):
        if isinstance(v, str):
            return "\n".join(x.rstrip() for x in v.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
        return [tidy(x) for x in v] if isinstance(v, list) else {k: tidy(x) for k, x in v.items()} if isinstance(v, dict) else v

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical_json(F.col("t")).alias("c")).collect()
    assert [r for r in got if r["c"] != canonical(tidy(json.loads(r["t"])))] == []
