"""Rows that repeat and columns that can't be ordered in the pipeline's third stage."""

import corpus_pipeline


def test_map_columns_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "s", {"a": 2}, 4)] * 50 + [(1, text, "s", {"a": 1}, 4), (2, text + " ", "s", None, 5), (3, "other words", None, {}, 6), (4, None, "s", {"b": 1}, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>, `a.b` int")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns and out.schema["tags"].dataType == df.schema["tags"].dataType
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text, "s", {"a": 1}, 4), (3, "other words", None, {}, 6), (4, None, "s", {"b": 1}, 7)], key=str)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0
