"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

Stages take any table with the columns doc_id, text and source, and all but the last return its
columns and no more, whatever they are called; an empty table gives an empty table. n_chars, if
there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm import jaccard, linededup, mixing, packing, quality, tokens
from trajloom.llm.common import WORD, Tables, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines. A null text is empty and fails; repeated rows are judged alike."""
    return with_chars(quality.clean(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long lines that at least five of them hold, but in the last one. A null text becomes empty."""
    return with_chars(linededup.cut_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row: of the smallest doc_id (null last), then of the smallest text hash.

    Of rows that repeat both, the first by the other columns stays (written as text, so they may be maps too); such rows
    become one in the tasks that read them, before the shuffle. Rows without a word are components of their own.
    """
    found, _ = jaccard.similar_documents(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("x")
    keep = found.filter("component is not null").groupBy("component").agg(least)
    keep = keep.select(F.coalesce("x.doc_id", F.lit(0)).alias("__id"), F.col("x.null").alias("__null"), F.col("x.text_hash").alias("__hash"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    keyed = docs.filter(worded).withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__null", F.col("doc_id").isNull()).withColumn("__hash", F.xxhash64("text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min_by(F.struct(*columns), F.struct(F.struct(F.lit(0), *others).cast("string"), "text"))
    one = keyed.groupBy("__id", "__null", "__hash").agg(first.alias("__row")).join(keep, ["__id", "__null", "__hash"], "left_semi")
    return one.select("__row.*").unionByName(docs.filter(~worded))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows that repeat a document are all taken as often as one of them most.

    A null source is a source of its own; texts without a word have no tokens and aren't taken.
    """
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    both = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; a null or empty text is one piece of one token."""
    return packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


def with_chars(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars, if it has that, as the text is now."""
    df = df.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in like.columns else df
    return df.select(*like.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: The stages use seeded hashes and a tokenizer, which SQL doesn't have; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's result written and read again."""
    docs, tables = read_table(spark, sf_dir, "documents"), Tables(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else tables.write(out, f"stage{i}")
        if i > 1:
            tables.remove(f"stage{i - 2}")
    return docs
