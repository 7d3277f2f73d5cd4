"""Digests of files, required columns, timestamps, provenance in both forms, details without some members."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trajloom.functions import text
from trajloom.operators import adp
from trajloom.sources import digests


def test_file_digests(spark, tmp_path):
    files = {"a.bin": bytes(range(256)) * 5000, "b.gz": b"\x1f\x8b no gzip", "empty": b"", "sub/c d.txt": "é\r\n".encode() * 3}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = digests.file_digests(spark, str(tmp_path), chunk=1000, files_per_task=2).collect()
    assert {r["path"].rpartition("/")[2].replace("%20", " "): (r["length"], r["digest"]) for r in got} == {k.rpartition("/")[2]: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items() if v}  # Spark lists no empty files
    assert digests.file_digests(spark, str(tmp_path), "*.bin", "md5").first()["digest"] == hashlib.md5(files["a.bin"]).hexdigest()
    with pytest.raises(ValueError):
        digests.file_digests(spark, str(tmp_path), algorithm="none")


def test_first_filled(spark):
    df = spark.createDataFrame([(None, " x \r\n"), ("  ", "y"), ("a", "b"), ("", None)], "p string, q string")
    assert [r[0] for r in df.select(text.first_filled("p", "q", default="-")).collect()] == [" x\n", "y", "a", "-"]
    with pytest.raises(Exception, match="none of p, q is filled"):
        df.select(text.first_filled("p", "q", required=True)).collect()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_utc_seconds(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert spark.range(1).select(text.utc_seconds(F.lit("2024-01-31T08:00:00.9Z").cast("timestamp"))).first()[0] == "2024-01-31T08:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_provenance_and_details(spark):
    where = {"raw_jsonl_line": 3, "raw_uuid": "u", "raw_parent_uuid": None, "raw_role": "user", "raw_block_type": "text", "raw_block_index": 0, "tool_use_id": None}
    items = [{"class_": "a", "provenance": where, "raw_uuid": "no"}, {"class_": "a", "raw_uuid": "v", "raw_jsonl_line": 4}, {"class_": "a"}, {"class_": "a", "provenance": "text", "tool_use_id": "t"}]
    line = json.dumps({"id": "x", "content": items, "details": {"cwd": ["/"], "models": ["m"], "summary": [], "n": 1}})
    t = adp.trajectories(spark.createDataFrame([("f", 1, line), ("f", 2, '{"id":"y","details":"none"}')], "src_file string, lineno int, value string"))
    got = [r["provenance"] and {k: v for k, v in r["provenance"].asDict().items() if v is not None} for r in adp.events(t).orderBy("idx").collect()]
    assert got == [{k: v for k, v in where.items() if v is not None}, {"raw_uuid": "v", "raw_jsonl_line": 4}, None, {"tool_use_id": "t"}]
    kept = {r["traj_id"]: r["d"] for r in adp.without_details(t).select("traj_id", F.to_json("details").alias("d")).collect()}
    assert json.loads(kept["x"]) == {"models": ["m"], "n": 1} and kept["y"] == '"none"'
