"""Packing that doesn't depend on the rows' order, as a task that is run again on shuffled rows needs it."""

from pyspark.sql import functions as F

from trajloom.llm import packing, tokens


def test_groups_follow_from_values_alone(spark, docs):
    same = spark.range(5000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("a row that repeats beyond one lot").alias("text"))
    df = docs.select("doc_id", "text").unionByName(same)
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    one = packing.pack(df, path, group_docs=1000).collect()
    two = packing.pack(df.repartition(5, F.rand(3)), path, group_docs=1000).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    per_group = {}
    for r in one:
        per_group[r["sequence_id"] >> 32] = per_group.get(r["sequence_id"] >> 32, 0) + (r["doc_id"] == 9)
    assert sum(per_group.values()) >= 5000 and max(per_group.values()) < 5000
