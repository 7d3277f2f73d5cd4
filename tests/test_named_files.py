"""Files with names from the data: names and bytes by brute force, also after failed and repeated tasks."""

import json
import random
import re
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from trajloom.functions import text
from trajloom.sources import readers, sinks


def held(path):
    """name: bytes of every file below a folder but the commit's mark."""
    root = Path(path)
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.startswith(("_SUCCESS", "."))}


def test_one_file_per_record(spark, tmp_path):
    rows = [(f"d{i % 7}/n{i:03d}.txt", None if i == 5 else f"text {i}\né\x00" * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, value string").repartition(7)
    sinks.files(df, str(tmp_path / "out"), "name", "value")
    assert held(tmp_path / "out") == {n: (v or "").encode() for n, v in rows}
    assert (tmp_path / "out/_SUCCESS").exists()
    sinks.files(df.limit(1).select(F.lit("d0/n000.txt").alias("name"), F.lit("new").alias("value")), str(tmp_path / "out"), "name", "value", "append")
    assert held(tmp_path / "out") == {n: (v or "").encode() for n, v in rows} | {"d0/n000.txt": b"new"}
    sinks.files(spark.createDataFrame([("only.txt", "x")], "name string, value string"), "file://" + str(tmp_path / "out"), "name", "value")
    assert held(tmp_path / "out") == {"only.txt": b"x"}
    sinks.files(spark.createDataFrame([], "name string, value string"), str(tmp_path / "none"), "name", "value")
    assert held(tmp_path / "none") == {}


@pytest.mark.parametrize("bad", ["same.txt", "../up.txt", "/abs.txt", "a//b.txt", "", None, "_staging-x"])
def test_bad_and_equal_names_fail_and_leave_what_was_there(spark, tmp_path, bad):
    out = str(tmp_path / "out")
    sinks.files(spark.createDataFrame([("old.txt", "old")], "name string, value string"), out, "name", "value")
    rows = [(f"{i}.txt", "x") for i in range(50)] + [("same.txt", "1"), (bad, "2")]
    with pytest.raises(Exception, match="file name"):
        sinks.files(spark.createDataFrame(rows, "name string, value string"), out, "name", "value")
    assert held(out) == {"old.txt": b"old"}


def test_a_task_that_fails_and_runs_again(tmp_path):
    """In a session with retries: the first attempt of each task dies after it has written files."""
    import subprocess
    import sys

    code = """
import sys
from pathlib import Path
from pyspark import TaskContext
from pyspark.sql import SparkSession
from trajloom.sources import named_files, sinks

class Dies(named_files.OneFile):
    root = sys.argv[1]

    def close(self):
        done = super().close()
        mark = Path(self.root) / f"died-{TaskContext.get().partitionId()}"
        if not mark.exists():
            mark.touch()
            raise OSError("lost")
        return done

class Writer(named_files.NamedFilesWriter):
    def write(self, rows):
        named_files.OneFile = Dies
        return super().write(rows)

class Source(named_files.NamedFiles):
    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)

import pyspark.cloudpickle as cp, trajloom, __main__
cp.register_pickle_by_value(__main__)
named_files.NamedFiles = Source
spark = SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "5").config("spark.sql.adaptive.enabled", "false").getOrCreate()
df = spark.range(100).selectExpr("concat('f', id, '.txt') as name", "repeat(cast(id as string), 3) as value")
sinks.files(df, sys.argv[1] + "/out", "name", "value")
spark.stop()
"""
    script = tmp_path / "job.py"
    script.write_text(code)
    subprocess.run([sys.executable, str(script), str(tmp_path)], check=True, timeout=180, capture_output=True)
    assert len(list(tmp_path.glob("died-*"))) == 5
    assert held(tmp_path / "out") == {f"f{i}.txt": (str(i) * 3).encode() for i in range(100)}


def test_shards_are_numbered_and_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, f"ü{rng.random()}", None if k % 3 else k) for k in range(1234)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k int, t string, n int").repartition(6)
    out = tmp_path / "shards"
    sinks.shards(df, str(out), "k", rows=100)
    got = held(out)
    assert sorted(got) == [f"part-{i:05d}.jsonl.zst" for i in range(13)]
    lines = [zstandard.ZstdDecompressor().decompressobj().decompress(got[n]).decode().split("\n")[:-1] for n in sorted(got)]
    assert [len(x) for x in lines] == [100] * 12 + [34]
    assert [json.loads(x) for part in lines for x in part] == [{"k": k, "t": t, "n": n} for k, t, n in rows]
    back = readers.lines(spark, str(out)).orderBy("src_file", "lineno").collect()
    assert [json.loads(r["value"])["k"] for r in back] == list(range(1234))
    before = held(out)
    sinks.shards(df.repartition(3), str(out), "k", rows=100)
    assert held(out) == before


def test_plain_and_canonical_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "b  \nx", None), (1, "a", 1.5)], "z int, a string, m double")
    sinks.canonical_lines(df, str(tmp_path / "c"), "z")
    assert held(tmp_path / "c") == {"part-00000.jsonl": b'{"a":"a","m":1.5,"z":1}\n{"a":"b\\nx","m":null,"z":2}\n'}
    sinks.shards(df, str(tmp_path / "g"), "z", rows=1, name="part-%05d.jsonl.gz")
    assert sorted(held(tmp_path / "g")) == ["part-00000.jsonl.gz", "part-00001.jsonl.gz"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "g")).orderBy("value").collect()] == ['{"z":1,"a":"a","m":1.5}', '{"z":2,"a":"b  \\nx","m":null}']


def safe(value):
    """The rule in Python."""
    value = re.sub(r"_+", "_", re.sub(r"[/\\:*?\"<>|\s]+", "_", value.strip() or "unknown")).strip("._")
    return value[:120] or "unknown"


def test_numbered_texts_and_prompts(spark, tmp_path):
    ids = ["a/b", " x  y ", "", "..", "é:ü", "a" * 200, 'q"<>|?*', "___", "n.txt."]
    df = spark.createDataFrame([(i, s, f"t{i}") for i, s in enumerate(ids)], "k int, id string, t string")
    sinks.numbered_texts(df, str(tmp_path / "n"), "id", "t", "k")
    assert held(tmp_path / "n") == {f"{i + 1:06d}_{safe(s)}.txt": f"t{i}\n".encode() for i, s in enumerate(ids)}
    runs = spark.createDataFrame([("t/1", "raw", "runs/t1/raw/", "P1"), ("t/1", "adp", None, "P2")], "target_instance_id string, condition string, output_dir string, prompt string")
    sinks.prompt_files(runs, str(tmp_path / "p"), str(tmp_path / "root"))
    assert held(tmp_path / "p") == {"t_1/raw/prompt.txt": b"P1", "t_1/adp/prompt.txt": b"P2"}
    assert held(tmp_path / "root") == {"runs/t1/raw/prompt.txt": b"P1"}
    sinks.documents(spark.createDataFrame([("s1", '{"b":1,"a":["é"]}')], "stem string, j string"), str(tmp_path / "d"), "stem", "j")
    assert held(tmp_path / "d") == {"s1.adp.json": '{\n  "b": 1,\n  "a": [\n    "é"\n  ]\n}\n'.encode()}


def test_safe_parts(spark):
    got = spark.range(1).select(text.safe_path_part(F.lit("a b/c=1-é.")).alias("a"), text.safe_path_part(F.lit("///")).alias("b"), text.safe_path_part(F.lit(None).cast("string")).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == ("a_b_c=1-", "unnamed", "unnamed")
