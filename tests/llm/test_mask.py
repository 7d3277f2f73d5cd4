"""The loss mask: what the query says of it is cut from the formatted string by the mask alone."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajloom.llm import chat


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="<|>\\\\ a\n\U0001f600é", max_size=9) | st.just("long text " * 60)), min_size=1, max_size=90))
def test_mask_says_the_assistant_texts(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    out = out.select(chat.loss_text(F.col("formatted"), F.col("loss_runs")).alias("said"), chat.starts_of(F.transform("loss_runs", lambda r: r["chars"])).alias("at"), "loss_runs").first()
    assert out["said"] == "".join(t for r, t in turns if r == "assistant")
    lengths = [r["chars"] for r in out["loss_runs"]]
    assert out["at"] == [sum(lengths[:i]) for i in range(len(lengths))]


def test_a_broken_mask_is_seen(spark):
    df = spark.createDataFrame([(1, 0, "user", "Why?"), (1, 1, "assistant", "So."), (1, 2, "assistant", "And <| so.")], "conv_id long, turn long, role string, text string")
    good = chat.format_chats(df)
    said = lambda d: d.select(chat.loss_text(F.col("formatted"), F.col("loss_runs")).alias("x")).first()["x"]
    assert said(good) == "So.And <| so."
    none = good.withColumn("loss_runs", F.transform("loss_runs", lambda r: r.withField("loss", F.lit(False))))
    assert said(none) == ""
    late = good.withColumn("loss_runs", F.transform("loss_runs", lambda r, i: r.withField("chars", r["chars"] + F.when(i == 0, 1).otherwise(0))))
    assert said(late) != said(good)
    assert said(good.withColumn("loss_runs", F.array().cast("array<struct<chars:int,loss:boolean>>"))) == ""


def test_long_conversations(spark):
    turns = [("assistant" if i % 2 else "user", f"turn {i} <|im_end|> é" * (1 + i % 5)) for i in range(6000)] + [("assistant", "x" * 300_000)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select(F.sha2(chat.loss_text(F.col("formatted"), F.col("loss_runs")), 256).alias("x")).first()
    import hashlib

    assert out["x"] == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
