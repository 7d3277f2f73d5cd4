"""Gates: planted violations keep results back and are all listed; what was there stays."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trajloom.operators import gates, manifest
from trajloom.sources import folders


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v int, error string")


def own_gates():
    return [gates.RowGate("negative", F.col("v") < 0, F.col("v").cast("string")), gates.RowGate("odd", F.col("v") % 2 == 1, stops=False), gates.TableGate("twice", lambda df: df.groupBy(F.col("v").alias("key")).agg(F.count("*").alias("detail")).filter("detail > 1"))]


def listed(out):
    return sorted(tuple(r) for r in out.violations.select("gate", "key", "detail").collect())


def test_promotion(spark, tmp_path):
    path = str(tmp_path / "out")
    good = gates.publish(table(spark, [(1, 2, None), (2, 3, None), (3, -5, "broken"), (4, 2, "broken too")]), path, "k", own_gates(), "error")
    assert good.promoted and good.path == path
    assert good.counts == {"rows": 4, "rejected": 2, "negative": 0, "odd": 1, "twice": 0}
    assert listed(good) == [("error", "3", "broken"), ("error", "4", "broken too"), ("odd", "2", "")]
    assert sorted(r["k"] for r in gates.rows_at(spark.range(1), path).collect()) == [1, 2]
    bad = gates.publish(table(spark, [(5, -1, None), (6, 4, None), (7, 4, None), (8, -1, None), (9, 1, None)]), path, "k", own_gates(), "error")
    assert not bad.promoted and bad.path != path and folders.exists(spark, bad.path)
    assert listed(bad) == [("negative", "5", "-1"), ("negative", "8", "-1"), ("odd", "9", ""), ("twice", "-1", "2"), ("twice", "4", "2")]
    assert sorted(r["k"] for r in gates.rows_at(spark.range(1), path).collect()) == [1, 2]
    again = gates.publish(table(spark, [(10, 4, None)]), path, "k", own_gates(), "error")
    assert again.promoted and [r["k"] for r in gates.rows_at(spark.range(1), path).collect()] == [10]
    assert not [p for p in Path(tmp_path).iterdir() if p.name not in ("out", bad.path.rpartition("/")[2])]


def test_errors_can_stop(spark, tmp_path):
    out = gates.publish(table(spark, [(1, 2, None), (2, 4, "x")]), str(tmp_path / "out"), "k", [], "error", errors_stop=True)
    assert not out.promoted and listed(out) == [("error", "2", "x")] and not (tmp_path / "out").exists()
    empty = gates.publish(table(spark, []), str(tmp_path / "none"), "k", own_gates(), "error")
    assert empty.promoted and empty.counts["rows"] == 0 and listed(empty) == []


def prompts(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, target_instance_id string, condition string, prompt string, target_problem_statement_sha256 string, prior_context_chars int")


def test_prompts(spark, tmp_path):
    four = [(f"t{t}__{c}", f"t{t}", c, f"prompt {c}", "h", 3) for t in (1, 2) for c in ("raw", "adp", "memory", "no_memory")]
    out = gates.publish_prompts(prompts(spark, *four), str(tmp_path / "p"), 100)
    assert out.promoted and listed(out) == []
    report = gates.prompt_report(out, prompts(spark, *four))
    assert report["prompt_count"] == 8 and report["unique_targets"] == 2 and report["condition_counts"] == {"adp": 2, "memory": 2, "no_memory": 2, "raw": 2}
    assert report["prompt_length_by_condition"]["raw"] == {"count": 2, "min": 10, "max": 10, "mean": 10.0, "median": 10.0}
    more = [*four[:7], ("x", "t1", "raw", "ok\nsee /.claude/ here", "h", 3), ("y", "t3", "odd", "l" * 101, "g", 0), ("z", "t3", "raw", "p", "f", 0)]
    bad = gates.publish_prompts(prompts(spark, *more), str(tmp_path / "p"), 100)
    found = listed(bad)
    assert not bad.promoted
    assert [x for x in found if x[0] == "bad_condition_sets"] == [("bad_condition_sets", "t2", "adp,memory,raw"), ("bad_condition_sets", "t3", "odd,raw")]
    assert [x[1] for x in found if x[0] == "inconsistent_target_issue_hashes"] == ["t3"]
    assert [x[1:] for x in found if x[0] == "duplicate_prompt_paths"] == [("t1/raw/prompt.txt", "x")]
    assert [x[1:] for x in found if x[0] == "too_long"] == [("y", "101")]
    assert [x[1] for x in found if x[0] == "forbidden"] == ["x"]
    assert gates.rows_at(spark.range(1), str(tmp_path / "p")).count() == 8
    report = gates.prompt_report(bad, prompts(spark, *more))
    assert report["too_long"] == [{"run_id": "y", "prompt_chars": 101}] and report["forbidden_hit_count"] == 1 and report["promoted"] is False
    lax = gates.publish_prompts(prompts(spark, *four, *[(f"t9__{c}", "t9", c, "/.claude/", "h", 1) for c in ("raw", "adp", "memory", "no_memory")]), str(tmp_path / "q"), fail_on_forbidden=False)
    assert lax.promoted and len([x for x in listed(lax) if x[0] == "forbidden"]) == 4


def runs(spark, *rows):
    return spark.createDataFrame([(r, c, t, "repo", "base", "p", "img", "out") for r, t, c in rows], "run_id string, condition string, target_instance_id string, target_repo string, target_base_commit string, prompt_path string, sandbox_image string, output_dir string")


def test_selections(spark):
    four = [(f"{t}_{c}", t, c) for t in ("a", "b") for c in ("raw", "adp", "memory", "no_memory")]
    assert [r["run_id"] for r in manifest.select_runs(runs(spark, *four), smoke_target="b").orderBy("plan_index").collect()] == ["b_no_memory", "b_raw", "b_adp", "b_memory"]
    assert manifest.select_runs(runs(spark, *four), most=3).count() == 3
    for rows, options, match in (
        (four[:3], {"smoke_target": "a"}, "smoke_conditions adp,memory,raw"), (four, {"smoke_target": "c"}, "smoke_conditions"), (four, {"confirmed": False}, "unconfirmed"),
        ([*four, ("again", "a", "raw")], {}, "duplicate a raw"), (four, {"conditions": ("none",)}, "empty"), ([*four, ("n", None, "raw")], {}, "null_field n: target_instance_id"),
    ):
        with pytest.raises(ValueError, match=match):
            manifest.select_runs(runs(spark, *rows), **options)
    with pytest.raises(ValueError, match="missing columns"):
        manifest.select_runs(runs(spark, *four).drop("sandbox_image"))
