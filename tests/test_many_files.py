"""Many small files: tasks move and read them, and the driver neither lists nor renames any."""

import contextlib
import io
import os

import pyarrow as pa
import pytest

from trajloom.plans import records
from trajloom.sources import named_files, readers, sinks

NAMES = ["a.txt", "d/b.txt", "d/c.txt", "e/f/g.txt"]


def staged(path):
    """An attempt's files in the staging folder s, and the attempt."""
    os.mkdir(f"{path}/s")
    writer = named_files.NamedFilesWriter({"path": path, "staging": "s"}, True)
    done = writer.write(iter([pa.record_batch({"name": NAMES, "value": [f"text of {n}" for n in NAMES]})]))
    writer.commit([done, None])
    return [pa.record_batch({"attempt": [done.attempt]})]


def names_of(batches):
    return [n for b in batches for n in b.column(0).to_pylist()]


def test_a_task_that_moves_files_again(tmp_path):
    """A task that died on its way, and one that runs beside itself, find what is moved in its place; a lost file is an error."""
    attempt, move = staged(str(tmp_path)), named_files.moved(str(tmp_path), "s")
    folder = tmp_path / "s" / attempt[0].column(0)[0].as_py()
    os.rename(folder / "0", tmp_path / "a.txt")
    assert names_of(move(iter(attempt))) == NAMES
    assert names_of(move(iter(attempt))) == NAMES
    assert {n: (tmp_path / n).read_text() for n in NAMES} == {n: f"text of {n}" for n in NAMES}
    (tmp_path / "d/c.txt").unlink()
    with pytest.raises(FileNotFoundError):
        list(move(iter(attempt)))


def test_a_task_of_a_failed_job_writes_nothing(tmp_path):
    named_files.clear(str(tmp_path), "s")
    with pytest.raises(OSError):
        named_files.NamedFilesWriter({"path": str(tmp_path), "staging": "s"}, True).write(iter([pa.record_batch({"name": NAMES, "value": NAMES})]))
    assert list(tmp_path.iterdir()) == []


def test_names_come_back_as_a_table(spark, tmp_path):
    df = spark.range(300).selectExpr("concat('r', id % 70, '/', id, '.txt') as name", "cast(id as string) as value").coalesce(1)
    got = sinks.files(df, str(tmp_path / "o"), "name", "value")
    assert sorted(r.name for r in got.collect()) == sorted(f"r{i % 70}/{i}.txt" for i in range(300))
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if p.name.startswith("_")) == ["_SUCCESS"]
    assert sinks.files(df.limit(0), str(tmp_path / "none"), "name", "value").count() == 0


def test_texts_at_their_paths(spark, tmp_path):
    """Missing files and null paths are null, empty ones empty, bytes as Spark's reader of texts gives them, in batches of any size."""
    held = {"a": b"x\r\n\xff\xc3", "b": b"", "c": "\u00e9\0".encode(), "d e%20f": b"z" * 5000}
    for n, b in held.items():
        (tmp_path / n).write_bytes(b)
    rows = [(i, p) for i, p in enumerate([*(f"{tmp_path}/{n}" for n in held), f"file://{tmp_path}/a", f"{tmp_path}/none", None])]
    df = spark.createDataFrame(rows, "k int, path string").coalesce(1)
    for size in (1, 6, 8 << 20):
        got = {r.k: (r.path, None if r.b is None else bytes(r.b)) for r in readers.texts_at(df, "path", size).selectExpr("k", "path", "cast(value as binary) as b").collect()}
        assert got == {k: (p, b) for (k, p), b in zip(rows, [*held.values(), held["a"], None, None], strict=True)}
    own = {r.path.rpartition("/")[2]: bytes(r.b) for r in readers.text_folder(spark, str(tmp_path), "[ac]").selectExpr("path", "cast(value as binary) as b").collect()}
    assert own == {n: held[n] for n in ("a", "c")}


def test_predictions_of_a_plan(spark, tmp_path):
    for n, t in {"r1": '{"a":1}', "r2": "[1]", "r3": '{"a'}.items():
        (tmp_path / n).mkdir()
        (tmp_path / n / "prediction.json").write_text(t)
    plan = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("r1/", "r1/", "r2", "r3", "r4")], "run_dir string")
    got = readers.predictions(plan).selectExpr("folder", "to_json(pred) as j").collect()
    assert sorted((r.folder[len(str(tmp_path)) :], r.j) for r in got) == [("/r1/", '{"a":1}'), ("/r2", None), ("/r3", None), ("/r4", None)]


@pytest.mark.parametrize("query", [records.k6_numbered_texts, records.x4_predictions])
def test_no_folder_of_files_is_listed(spark, query):
    """Both listed the folders they had written, on the driver and a task for each folder, and read 32 files a task."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        query(spark, "/root/testdata/sf0.001").explain(True)
    assert "Format: Text" not in out.getvalue() and "Relation [value" not in out.getvalue()
