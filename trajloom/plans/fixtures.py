"""An agent's event log derived from the driver's `events` table, which has no tool calls of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.events import as_events

COMMANDS = (
    "rm -rf build && pytest", "python -m pytest tests/test_a.py -q", "pytest -x", "ls", "ls -la testbed", "pwd", "cat src/app.py | head -20", "grep -rn foo src", "git status", "git -C repo log --oneline", "cd repo && git status",
    "git diff --cached", "git add -A", "git commit -m x", "git diff HEAD~1", "pip install -e .", "pip3 install numpy", "make", "make test", "npm run build", "npm test", "cargo test", "go test ./...", "mvn package", "./gradlew test", "./gradlew build",
    "git clone https://x/y", "git checkout main", "mkdir -p a/b", "conda create -n x", "python -c 'print(1)'", "python run_test_suite.py", "python3 setup.py develop", "find . -name x -delete", "find . -name x", "sed -n 1,5p a.py",
    "cat > fix.patch", "echo hi > output/x.txt", "cat model_patch", "cat .claude/x", "cat manual.yaml", "tail run_instance.log", "echo done", "cd a && ls", "cd /tmp && rm -r x", "sudo rm -f x", "git reset --hard", "git clean -fdx", "wc -l a.py",
    "cat <<'EOF' > a.py\nprint(1)\nEOF", "virtualenv env", "apt-get update", "tox -e py3", "bundle exec rspec", "poetry install", "echo testbed does not exist", "ls || echo 'testbed does not exist'", "head -5 x.diff", "rg foo", "git show --stat", "git show abc",
)
OBSERVATIONS = (
    "src\ntests\nREADME.md", ".\n..\n.claude\noutput", "testbed does not exist", "No files found", "ls: cannot access x: No such file or directory", "def f():\n    return 1", "FAILED tests/test_a.py::test_b - assert 1 == 2\nE   assert 1 == 2\nERROR x",
    "Traceback (most recent call last):\n  File \"a.py\", line 1\nValueError: bad", "ok", "3 passed in 0.1s", "ModuleNotFoundError: No module named 'x'\nImportError: y", "No module named 'extension_helpers'", "<tool_use_error>File does not exist.",
    "Todos have been modified successfully", "the model_patch is here", "panic: boom\nFAIL: TestA\nFAIL x", "   ", "a\n<system-reminder>\nbe nice\n</system-reminder>\nb", "see manual.yaml\nline two", "RuntimeError: a  \nTypeError: b\t\nException: c\nAssertionError",
)
PATHS = (
    "src/app.py", "./a//b.py", "/tmp/x/testbed/pkg/f.py", "testbed/g.py", "output/x.txt", "x_preds.json", "check_a.py", "tests/a.py", "a.SPEC.ts", "a.spec.ts", "debug.py", "docs/readme.md", ".claude/x", "report.json", "tmp/y.py", "lib/test_z.py",
    "notes.txt", "fix.patch", "swebench_1/testbed/m.py", "Makefile", "deep/specs/q.rb", "my_tmp.go", ".", "reproduce.py", "a/output/b.c", "preds.json", "src/test.java", "src/x_test.py", "debug/z.c", "all_preds.json",
)
TOOLS = ("Read", "Edit", "Grep", "Write", "Glob", "TodoWrite", "WebFetch")


def pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, by time, as a trajectory: clicks are commands, purchases tool calls, views and errors
    observations, sign-ups user prompts and, for odd ids, messages."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    k, kind = F.col("event_id"), F.col("event_type")
    prompt = F.concat(F.lit("repo: r"), (k % 7).cast("string"), F.lit("\ninstance_id: i"), k.cast("string"), F.lit("\nproblem_statement: fix  \nit "), k.cast("string"))
    args = F.concat(F.lit('{"file_path":"'), pick(PATHS, k), F.lit('","old_string":"a'), k.cast("string"), F.lit('","new_string":"b","pattern":"p'), (k % 5).cast("string"), F.lit('"}'))
    user = (kind == "signup") & (k % 2 == 0)
    e = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("traj_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int").alias("idx"),
        F.when(kind == "click", "code_action").when(kind == "purchase", "api_action").when((kind == "signup") & ~user, "message_action").otherwise("text_observation").alias("class_"),
        F.when(user, "user").when(kind.isin("view", "error"), "environment").alias("source"),
        F.when(kind == "click", pick(COMMANDS, k)).when(kind.isin("view", "error"), pick(OBSERVATIONS, k)).when(user, prompt).when(kind == "signup", F.concat(F.lit("all done "), k.cast("string"))).alias("content"),
        F.when(kind == "click", "bash").alias("language"),
        F.when(kind == "purchase", pick(TOOLS, k)).alias("function"),
        F.when(kind == "purchase", args).alias("kwargs_json"),
        F.when(k % 3 == 0, F.concat(F.lit("step "), k.cast("string"))).alias("description"),
        F.when((k % 11 == 0) & kind.isin("click", "purchase"), "because").alias("reasoning_content"),
    )
    return as_events(e)


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, lineno, rec VARIANT: agent_events() as session logs, each record the child of the one before; every 13th event is a summary.

    Clicks are calls of Bash, purchases of other tools; views and errors are results of the last call before them.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    k, kind = F.col("event_id"), F.col("event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumns({"n": F.row_number().over(order), "call": F.last(F.when(kind.isin("click", "purchase") & (k % 13 != 0), k), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    js = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    args = F.concat(F.lit('{"file_path":"'), pick(PATHS, k), F.lit('","old_string":"a'), k.cast("string"), F.lit('","new_string":"b","pattern":"p'), (k % 5).cast("string"), F.lit('","description":"d"}'))
    use = lambda name, inputs: F.concat(F.lit('[{"type":"tool_use","id":"t'), k.cast("string"), F.lit('","name":'), js(name), F.lit(',"input":'), inputs, F.lit("}]"))
    prompt = F.concat(F.lit("repo: r"), (k % 7).cast("string"), F.lit("\ninstance_id: i"), k.cast("string"), F.lit("\nproblem_statement: fix it "), k.cast("string"))
    content = (
        F.when(kind == "click", use(F.lit("Bash"), F.concat(F.lit('{"command":'), js(pick(COMMANDS, k)), F.lit("}"))))
        .when(kind == "purchase", use(pick(TOOLS, k), args))
        .when(kind.isin("view", "error"), F.concat(F.lit('[{"type":"tool_result","tool_use_id":"'), F.coalesce(F.concat(F.lit("t"), F.col("call").cast("string")), F.lit("")), F.lit('","content":'), js(pick(OBSERVATIONS, k)), F.lit("}]")))
        .when(k % 2 == 0, js(prompt)).otherwise(F.concat(F.lit('[{"type":"text","text":"all done '), k.cast("string"), F.lit('"}]')))
    )
    role = F.when(kind.isin("click", "purchase") | ((kind == "signup") & (k % 2 == 1)), "assistant").otherwise("user")
    up = F.when(F.col("n") > 1, F.concat(F.lit('"m'), (F.col("n") - 1).cast("string"), F.lit('"'))).otherwise("null")
    record = F.concat(F.lit('{"type":"'), role, F.lit('","uuid":"m'), F.col("n").cast("string"), F.lit('","parentUuid":'), up, F.lit(',"message":{"role":"'), role, F.lit('","content":'), content, F.lit("}}"))
    rec = F.parse_json(F.when(k % 13 == 0, F.concat(F.lit('{"type":"summary","summary":"s'), k.cast("string"), F.lit('"}'))).otherwise(record))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), F.col("n").cast("int").alias("lineno"), rec.alias("rec"))
