"""Rows by place, limits of rows seen, paths, predictions: by brute force on small files."""

import gzip
import itertools
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from trajloom.operators import manifest, paths, positional
from trajloom.sources import readers


def write(folder, files):
    folder.mkdir()
    for name, lines in files.items():
        data = "".join(lines).encode()
        (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)


def zipped(left, right):
    """Files side by side, then their lines that aren't blank, as far as both go."""
    out = []
    for i, (a, b) in enumerate(zip(sorted(left), sorted(right), strict=False)):
        rows = zip(*([x.strip("\n") for x in side if x.strip()] for side in (left[a], right[b])), strict=False)
        out += [(i, j, x, y) for j, (x, y) in enumerate(rows)]
    return out


def test_side_by_side(spark, tmp_path):
    rng = random.Random(5)
    sides = []
    for suffix in (".jsonl", ".jsonl.gz"):
        sides.append({f"f{i:02d}{suffix}": [rng.choice(["\n", "  \n", f"v{i}-{j}\n"]) for j in range(rng.randint(0, 60))] for i in range(rng.randint(5, 8))})
    write(tmp_path / "l", sides[0])
    write(tmp_path / "r", sides[1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        a, b = (positional.by_place(spark, str(tmp_path / x), "*.jsonl*") for x in "lr")
        own = F.col("value")
        got = positional.side_by_side(a, b, own, own, strict=False).select("file_no", "row_no", "left_value", "right_value")
        # files without any line have no place of their own in a table; the brute force leaves them out too
        full = [{k: v for k, v in s.items() if any(x.strip() for x in v)} for s in sides]
        assert sorted(map(tuple, got.collect())) == sorted(zipped(*full))
        with pytest.raises(Exception, match="ids differ: v"):
            positional.side_by_side(a, b, own, F.concat(own, F.lit("x"))).collect()
        if len(full[0]) != len(full[1]):
            with pytest.raises(ValueError, match="files"):
                positional.side_by_side(a, b, own, own, strict=False, same_files=True)
        bad = positional.mismatches(a, b, F.lit("a"), F.lit("a")).collect()
        lengths = itertools.zip_longest(*([sum(bool(x.strip()) for x in s[k]) for k in sorted(s)] for s in full), fillvalue=0)
        assert sorted((r["file_no"], r["error"]) for r in bad) == [(i, f"row count mismatch: raw={x} converted={y}") for i, (x, y) in enumerate(lengths) if x != y]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("limit", [1, 3, 4, 5, 11, 12, 13, 99, None])
def test_first_seen_reads_no_later_files(spark, tmp_path, limit):
    files = {f"p{i}.jsonl": [f"{i}-{j}\n" for j in range(n)] for i, n in enumerate([4, 0, 5, 3, 2, 6, 1, 1, 1])}
    write(tmp_path / "in", files)
    seen = positional.first_seen(spark, str(tmp_path / "in/*.jsonl"), limit)
    every = [x.strip() for k in sorted(files) for x in files[k]]
    assert sorted(r["value"] for r in seen.rows.collect()) == sorted(every[:limit])
    if limit is not None:
        need = next((i + 1 for i in range(9) if sum(len(files[f"p{k}.jsonl"]) for k in range(i + 1)) >= limit), 9)
        assert len(seen.files) == need and len(seen.rows.inputFiles()) <= need
    with pytest.raises(FileNotFoundError):
        positional.first_seen(spark, str(tmp_path / "in/*.none"), 1)


def test_clean_paths_and_prefixes(spark):
    rng = random.Random(2)
    some = ["/".join(rng.choice(["a", "b", ".", "..", "", "c.d"]) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    some += ["/" + p for p in some] + ["", "/", ".", "..", "/..", "../..", "a/.."]
    got = spark.createDataFrame([(p,) for p in some], "p string").select("p", paths.clean(F.col("p")).alias("c")).collect()
    # two leading slashes mean something else to POSIX only
    want = lambda p: posixpath.normpath("/" + p.lstrip("/") if p.startswith("/") else p)
    assert [r for r in got if r["c"] != want(r["p"])] == []
    one = spark.createDataFrame([("/a/b/c",), ("x/y",)], "p string").select(paths.prefixes(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in one] == [["/a", "/a/b", "/a/b/c"], ["x", "x/y"]]


def test_nearest_folder(spark):
    rng = random.Random(4)
    name = lambda n: "/" + "/".join(rng.choice("abc") for _ in range(n))
    files, roots = [name(rng.randint(1, 6)) for _ in range(10_000)], {name(rng.randint(1, 4)) for _ in range(60)}
    got = paths.nearest_folder(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(r,) for r in roots], "root string")).collect()
    best = lambda f: max((r for r in roots if f == r or f.startswith(r + "/")), key=len, default=None)
    assert sorted((r["path"], r["root"] or "") for r in got) == sorted((f, best(f) or "") for f in files)


def test_resolved_and_relative(spark, tmp_path):
    df = spark.createDataFrame([("a.txt",), ("sub/../b.txt",), ("/abs/x",), (None,)], "p string")
    there = spark.createDataFrame([("file:/two/a.txt",), ("/one/b.txt",), ("/two/b.txt",), ("/abs/x",)], "path string")
    got = {r["p"]: r["p_resolved"] for r in paths.resolved(df, "p", there, ("/one", "/two")).collect()}
    assert got == {"a.txt": "/two/a.txt", "sub/../b.txt": "/one/b.txt", "/abs/x": "/abs/x", None: None}
    with pytest.raises(Exception, match="Tried: /one/gone, /two/gone"):
        paths.resolved(spark.createDataFrame([("gone",)], "p string"), "p", there, ("/one", "/two")).collect()
    rel = spark.createDataFrame([("/r/a/b",), ("/r",), ("/rx/a",), ("/r/../q",)], "p string").select("p", paths.relative(F.col("p"), "/r/").alias("x")).collect()
    assert {r["p"]: r["x"] for r in rel} == {"/r/a/b": "a/b", "/r": ".", "/rx/a": "/rx/a", "/r/../q": "/r/../q"}
    (tmp_path / "second").mkdir()
    one, two = str(tmp_path / "first"), str(tmp_path / "second")
    assert [paths.first_folder(spark, *x) for x in ((None, one, two), ("mine", one), (None, one, str(tmp_path / "third")))] == [two, "mine", one]


def test_predictions_of_one_condition_leave_the_others_alone(spark, tmp_path):
    rows = [(c, i, f"{c}{i}", f'{{"instance_id":"i{i}"}}') for c in ("raw", "adp") for i in range(5)]
    df = spark.createDataFrame(rows, "condition string, plan_index int, run_id string, json string")
    out = tmp_path / "out"
    manifest.write_predictions(df, str(out))
    before = {p.name: p.stat().st_mtime_ns for p in (out / "condition=adp").glob("part-*")}
    manifest.write_predictions(df.filter("condition = 'raw' and plan_index > 2").withColumn("json", F.lit("{}")), str(out))
    assert {p.name: p.stat().st_mtime_ns for p in (out / "condition=adp").glob("part-*")} == before
    back = readers.lines(spark, str(out), "part-*")
    assert [r["value"] for r in back.filter(F.col("src_file").contains("condition=adp")).orderBy("src_file", "lineno").collect()] == [r[3] for r in rows if r[0] == "adp"]
    assert [r["value"] for r in back.filter(F.col("src_file").contains("condition=raw")).collect()] == ["{}", "{}"]


def test_pair_limit_and_summary(spark):
    pairs = spark.createDataFrame([("e2", "r1"), ("e1", "r2"), ("e1", "r1")], "experience_instance_id string, related_instance_id string")
    first = lambda n: [tuple(r) for r in manifest.first_pairs(pairs, n).collect()]
    assert first(2) == [("e1", "r1"), ("e2", "r1")] and first(0) == [("e1", "r1")] and len(first(None)) == 3
    s = manifest.manifest_summary(pairs, spark.range(12), spark.createDataFrame([("r9",), ("r1",)], "target_instance_id string")).first()
    assert s.asDict() == {"pair_rows": 3, "unique_priors": 2, "unique_targets": 2, "run_rows": 12, "missing_targets": ["r9"]}


def test_related_rows_that_come_twice(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "instance_id string")
    rel = spark.createDataFrame([("e", "r")], "experience_instance_id string, related_instance_id string")
    index = spark.createDataFrame([("e", "t")], "prior_instance_id string, prior_trajectory_id string")
    twice = spark.createDataFrame([("r", "old", 1), ("r", "new", 2)], "instance_id string, repo string, row int").repartition(4)
    assert manifest.pairs(rel, ids("e"), twice, index).first()["target_repo"] == "new"
    with pytest.raises(Exception, match="not unique"):
        manifest.pairs(rel, ids("e"), twice.drop("row"), index).collect()
