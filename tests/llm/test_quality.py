from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trajloom.llm import quality

DATA = "/root/testdata/sf0.01"


def slow_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return sum(any(windows.count(windows[j]) > 1 for j in range(max(0, i - 2), min(len(windows), i + 1))) for i in range(len(words)))


@pytest.mark.parametrize("words", ["a b c a b c", "a a a a", "a b", "", "a b c d e f", "x y z q x y z x y", "a b c b a b c d"])
def test_repeated_words(words):
    assert quality.repeated_words(words.encode().split()) == slow_repeats(words.split())


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("A line of prose, with an end.", None), ("", None), ("  ", None), ('He said "go."', None), ("Home | About | Contact", "navigation"), ("Wow!! this!! is!! loud!!", "marks"), ("a#b c$d e%f g*h.", "symbols"),
        ("All rights reserved.", "boilerplate"), ("We accept cookies here.", "boilerplate"), ("no end at all", "punctuation"), ("THIS IS A LINE OF CAPITALS ONLY.", "capitals"), ("First sentence. then no end", None), ("Fin…", None),
    ],
)
def test_line_rules(line, fault):
    assert quality.line_fault(line, quality.Rules()) == fault


def test_documents(spark, docs, empty):
    rows = {r["doc_id"]: r["quality"] for r in quality.judge(docs.withColumn("quality", F.lit(1))).collect()}
    assert all(not q["kept"] and q["base_failed"] for k, q in rows.items() if k not in (8, 9))
    assert (rows[0]["n_words"], rows[0]["word_chars"]) == (0, 0) and rows[9]["n_repeat_words"] == 400
    for r in docs.collect():
        t, q = r["text"] or "", rows[r["doc_id"]]
        words = t.encode().split()
        if r["doc_id"] != 3:
            assert (q["n_words"], q["word_chars"]) == (len(words), sum(len(w.decode()) for w in words))
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0


def test_clean_removes_failed_lines(spark):
    text = "".join(" ".join(f"w{i}x{j}" for j in range(9)) + ".\n" for i in range(9))
    df = spark.createDataFrame([(1, "Home | Shop | Help\n" + text + "All rights reserved.\n\n"), (2, "a | b | c | d | e | f | g | h\n" * 60 + text), (3, text)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in quality.clean(df).collect()}
    assert out == {1: text + "\n", 3: text}


def test_clean_adds_no_column(spark):
    text = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(7, text, 1.5, None), (8, None, 2.5, [1])], "quality long, text string, cleaned double, kept array<int>")
    assert [tuple(r) for r in quality.clean(df).collect()] == [(7, text, 1.5, None)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_agrees_with_labels(spark):
    d = quality.judge(spark.read.parquet(f"{DATA}/documents.parquet")).join(spark.read.parquet(f"{DATA}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id")
    rows = d.filter("not quality.base_failed").select("good", "quality.kept").collect()
    assert sum(r["kept"] == bool(r["good"]) for r in rows) >= 0.98 * len(rows)
    assert all(r["kept"] for r in rows if r["good"])
