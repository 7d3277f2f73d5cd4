"""What must not grow with the tables: Python's batches, calls of Python for each group, and how often a text is worked out."""

import contextlib
import io

from pyspark.sql import functions as F

from trajloom.functions import classify, json_udf, text
from trajloom.operators import convert_session


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()


def test_batches_of_texts_are_bounded(spark):
    """10,000 lines of 100 kB each were one batch."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    json_udf.canonical_json(F.col("value"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def calls(spark):
    rows = [("s", g, 10 * g + i, k, x) for g in range(1500) for i, (k, x) in enumerate([("action", "a"), ("action", ""), ("result", "a"), ("result", "a"), ("result", ""), ("result", "stray")])]
    return spark.createDataFrame(rows, "session string, seg long, p long, kind string, id string")


def test_segments_stream_by(spark):
    """A call of Python for each segment becomes one for each task; every segment keeps its own places."""
    found = convert_session.queued(calls(spark))
    assert "FlatMapGroupsInArrow" not in plan(found)
    rows = [(r.p % 10, r.kind, r.k1 % 10, r.k2, r.k3 % 10, r.k4, r.paired, r.dropped) for r in found.collect()]
    assert len(rows) == 9000
    assert set(rows) == {
        (0, "action", 2, 1, 0, 0, True, False), (1, "action", 4, 1, 1, 0, True, False), (2, "result", 2, 1, 0, 1, True, False), (3, "result", 3, 1, 3, 0, False, False),
        (4, "result", 4, 1, 1, 1, True, False), (5, "result", 5, 1, 5, 0, False, False),
    }


def test_a_path_is_normalised_once(spark):
    df = spark.createDataFrame([("src/a.py",)], "path string").select(classify.path_class(F.col("path")).alias("c"))
    assert plan(df).split("== Analyzed")[1].split("== Optimized")[0].count("testbed/(.*)$") == 1
    assert df.first().c == "source"


def test_strip_by_trimming_is_strip_by_expression(spark):
    """ASCII texts are trimmed without a regular expression, others by the one that all had."""
    ends = ["", " ", "\t\n", "\x0b\f\r", "\x1c\x1d\x1e\x1f", "\x00", "\x85", " ", "\xa0 "]
    rows = [(a + m + b,) for a in ends for b in ends for m in ("", "x", "x \ny", "\xe9")] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    whole = F.regexp_replace("t", rf"(?U)\A{text.SPACE}+|(?<!{text.SPACE}){text.SPACE}+\z", "")
    assert df.filter(~text.strip(F.col("t")).eqNullSafe(whole)).count() == 0
    assert "btrim" in plan(df.select(text.strip(F.col("t"))))


def test_forbidden_parts_hide_nothing(spark):
    from trajloom.functions import rules

    words = ["DIFF --GIT", "```Diff", "manual.YML", "Manual.yaml", "Agent-Summary:", "agent-session-PATHS:", ".realign/Sessions/", "Model_Patch", "x_preds.JSON", "prediction.json", "<System-Reminder>", "</system-reminder>", "REASONING_content", "TodoWrite", "none", "manual.txt"]
    df = spark.createDataFrame([(f"a {w} b",) for w in words] + [(None,)], "t string")
    assert df.filter(text.forbidden(F.col("t")) != F.coalesce("t", F.lit("")).rlike(rules.HARD_FORBIDDEN)).count() == 0
    assert df.filter(text.forbidden(F.col("t"))).count() == len(words) - 2


def test_empty_paths_are_not_normalised(spark):
    """Most events have no path: nulls and '' were taken through all expressions of a normal form."""
    rows = [("",), (None,), (" ",), ("./",), ("src/a.py",), ("output/x.txt",)]
    df = spark.createDataFrame(rows, "path string")
    found = df.select(classify.path_class(F.col("path")).alias("s"), classify.path_class(F.col("path"), "memory").alias("m"))
    assert [tuple(r) for r in found.collect()] == [("empty_path", "other"), ("empty_path", "other"), ("workspace_root", "other"), ("workspace_root", "other"), ("source", "source"), ("submission_artifact", "other")]
    # ahead of the first expression of a normal form it is asked whether there is a path at all
    none = F.lit(None).cast("string")
    for c, asked in ((classify.path_class(F.col("path")), "(namedlambdavariable() = ) THEN empty"), (classify.primary_path(F.lit("Read"), F.col("path"), none, none), "(namedlambdavariable() IS NULL) THEN")):
        analyzed = plan(df.select(c)).split("Analyzed Logical Plan")[1].split("Optimized Logical Plan")[0]
        assert asked in analyzed.split("regexp_replace", 1)[0] or asked in analyzed.split(r"[\\/]+", 1)[0]
