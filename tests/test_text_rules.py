"""Text functions and rule tables on literal cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajloom.functions import classify, text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def tidy(s):
    return "\n".join(x.rstrip() for x in (s or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x0c\x1c\x1f\x85\xa0 é", max_size=30), min_size=1, max_size=30))
def test_normalize_and_strip(spark, values):
    assert column(spark, values, text.normalize) == [tidy(v) for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


DIFF_LINES = ["diff --git a/x b/x", "index 1a..2b 100644", "--- a/x", "+++ b/y", "@@ -1 +1 @@", "@@", "@@x", " kept", "+added", "-gone", "\\ no newline", "", "prose", "  diff --git q", "--- other", "\tt"]


def without_diff(lines):
    """Line by line, as the rule is worded."""
    import re

    header = re.compile(r"(?:diff --git\b|index\s+[0-9a-f]+\.\.[0-9a-f]+\b|---\s+[ai]/|\+\+\+\s+[bw]/|@@(?:\s|$))", re.I)
    out, inside = [], False
    for x in lines:
        if header.match(x.lstrip()):
            inside = True
        elif not (inside and (not x.strip() or x[0] in " \t+-\\")):
            inside = False
            out.append(x)
    return "\n".join(out)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(DIFF_LINES), max_size=12), min_size=1, max_size=20))
def test_diffs_are_removed(spark, texts):
    assert column(spark, ["\n".join(t) for t in texts], text.without_diffs) == [without_diff([x.rstrip() for x in t]) for t in texts]


def test_scrub(spark):
    got = column(spark, [None, "a\n<system-reminder>\nx\n</system-reminder>\nb", "a\nsee MANUAL.yaml\nb", "x\n```diff\n-a\n+b\n```\ny", "plain \r\n text"], text.scrub)
    assert got == ["", "a\nb", "a\nb", "x\n\n\ny", "plain\n text"]


def test_truncation_counts_code_points(spark):
    assert column(spark, ["\U0001f600\U0001f600\U0001f600", "ab", None], lambda c: text.truncate(c, 2)["text"]) == ["\U0001f600\U0001f600", "ab", None]
    with pytest.raises(ValueError, match="negative"):
        text.truncate(F.lit("x"), -1)


PATH_CASES = [
    ("", "empty_path", "other"), (".", "workspace_root", "other"), ("./a//b.py", "source", "source"), ("a\\b.py", "source", "source"), ("/tmp/x/testbed/f.py", "source", "scratch"), ("output/x.txt", "submission_artifact", "other"),
    ("x_preds.json", "submission_artifact", "submission_artifact"), ("check_a.py", "scratch", "source"), ("reproduce.py", "scratch", "source"), ("debug.py", "scratch", "scratch"), ("tests/a.py", "test", "test"), ("a.SPEC.ts", "test", "test"),
    (".claude/x", "harness", "other"), ("report.json", "harness", "source"), ("fix.patch", "submission_artifact", "submission_artifact"), ("notes.txt", "other", "other"), ("tmp/y.c", "scratch", "scratch"), ("tests", "other", "other"),
]


@pytest.mark.parametrize(("policy", "at"), [("strip", 1), ("memory", 2)])
def test_path_classes(spark, policy, at):
    assert column(spark, [c[0] for c in PATH_CASES], lambda c: classify.path_class(c, policy)) == [c[at] for c in PATH_CASES]


COMMAND_CASES = [
    ("rm -rf x && pytest", "destructive", "destructive"), ("pytest && rm -rf x", "destructive", "destructive"), ("git reset --hard", "destructive", "destructive"), ("python -m pytest -q", "test", "test"), ("cd a; tox", "test", "test"), ("./gradlew test", "test", "test"),
    ("pip install x", "build_install", "build_install"), ("make", "build_install", "build_install"), ("remake", "other", "other"), ("git clone u", "setup", "setup"), ("mkdir -p a", "setup", "setup"), ("ls src", "diagnostic", "diagnostic"), ("cd a && grep x b", "diagnostic", "diagnostic"),
    ("ls", "diagnostic_environment_noise", "diagnostic"), ("git status", "diagnostic_environment_noise", "diagnostic"), ("git diff --cached", "patch_dump_or_staging", "diagnostic"), ("git commit -m x", "patch_dump_or_staging", "other"), ("cat a.diff", "submission_artifact", "other"),
    ("echo x > output/a", "submission_artifact", "other"), ("cat .claude/a", "harness", "diagnostic"), ("echo hi", "other", "other"), ("", "other", "other"),
]


@pytest.mark.parametrize(("policy", "at"), [("strip", 1), ("memory", 2)])
def test_command_classes(spark, policy, at):
    assert column(spark, [c[0] for c in COMMAND_CASES], lambda c: classify.command_class(c, policy)) == [c[at] for c in COMMAND_CASES]


def test_patch_payloads(spark):
    assert column(spark, ["cat > fix.patch", "tee > 'a/diff.txt'", "cat > a.py", "echo diff --git", "cat >> patch"], classify.is_patch_payload) == [True, True, False, True, True]


def test_failure_rules_in_order(spark):
    lines = ["FAILED a", "FAILEDx", "ERROR: x", "Traceback (most", "ValueError: x", "panic: x", "FAIL: x", "FAIL x", "E   assert", "Ex", "ok"]
    want = ["pytest_failure", None, "error_line", "traceback", "value_error", "panic", "go_test_failure", "go_test_failure", "pytest_error_line", None, None]
    assert column(spark, lines, text.failure_rule) == want


def test_noise(spark):
    got = column(spark, ["", "No files found", ".\n..\n.claude", "src\n.claude", "ls: no such file or directory", "fine"], classify.is_noise)
    assert got == [True, True, True, False, True, False]


def test_small_helpers(spark):
    assert column(spark, ["a__b__c"], text.docker_tag) == ["a.b.c"]
    assert column(spark, ["a b/c", None, "..."], text.safe_name) == ["a_b_c", "unknown", "unknown"]
    assert column(spark, ["a\nb", ""], lambda c: text.indent(c, "  ")) == ["  a\n  b", ""]
    assert column(spark, ["x"], lambda c: text.compact(F.array(F.lit(" a "), F.lit(" "), c))) == ["a\n\nx"]
