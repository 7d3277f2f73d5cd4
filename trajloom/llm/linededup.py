"""Line dedup: range-partitioned line hashes, streamed first occurrences, per-document keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower

#: Rows of one line hash are dealt over so many ranges (64 at most, the bits of a long), so a line that a third of all documents hold is no task's load.
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_hash(text: Column) -> Column:
    """Tells rows that share a key apart: a line's place is a place in one text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(df: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """doc, text_hash, n_lines, pos, h1, h2: one row for each long line of a row of df."""
    lines = df.select(F.col(key).alias("doc"), text_hash(F.col(text)).alias("text_hash"), lines_of(F.col(text)).alias("lines"))
    lines = lines.select("doc", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.char_length("line") >= least_chars)
    k = ascii_lower(F.col("line"))
    return lines.select("doc", "text_hash", "n_lines", "pos", F.xxhash64(k).alias("h1"), F.xxhash64(k, F.lit(1)).alias("h2"))


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """key, text_hash, n_lines, keep array<struct<word int, bits long>>: a row for each text of a key that loses lines.

    Bit b of the word w stands for line 64*w+b and is set if the line stays. The bitmap is compressed
    by leaving out the words whose lines all stay; a text without a row here keeps all its lines. A
    line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least
    `least_chars` code points in at least `least_docs` documents loses all its lines except in the
    largest `key` that holds it.

    A null text is one empty line. Rows with a null key count as one document before all others, rows
    that share a key as one; each of their texts has a bitmap of its own. An empty table gives no rows; other columns are ignored.

    The hashes (128 bits) are partitioned by range of (hash, salt) and sorted by document from the
    largest on, then by position, so the first row of a document in a run is its first occurrence,
    and counts follow from the stream. The salt comes from key and text, so neither a common line nor
    a shared key fills a range. The same ranges are read again for the bitmaps: lines are cut and
    hashed once (and for the sample that finds the ranges' bounds), and the texts aren't shuffled. Common
    lines come back to them by (hash, salt), with a row for each salt that holds the line.
    """
    occ = occurrences(df, key, text, least_chars)
    parts = occ.sparkSession.conf.get("spark.sql.shuffle.partitions")
    salted = occ.withColumn("salt", F.pmod(F.xxhash64("doc", "text_hash"), F.lit(SALTS)).cast("int"))
    salted = salted.repartitionByRange(int(parts), "h1", "h2", "salt")
    # the sort names all columns, so that Spark makes the exchange once for both of its readers
    stream = salted.sortWithinPartitions("h1", "h2", "salt", F.desc("doc"), "pos", "text_hash", "n_lines")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"), "pos", "text_hash", "n_lines")
    firsts = stream.withColumn("prev", F.lag("doc").over(run)).withColumn("n", F.row_number().over(run))
    firsts = firsts.filter((F.col("n") == 1) | ~F.col("prev").eqNullSafe(F.col("doc")))  # a row for each document of a run
    docs = firsts.groupBy("h1", "h2", "doc").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))  # a key whose texts lie in several runs counts once
    kept = docs.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count("*").alias("docs"), F.bit_or("salts").alias("salts")).filter(F.col("docs") >= least_docs)
    # a row for each run of a common line, so that the join too deals its rows by salt
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    kept = kept.select("h1", "h2", "keeper", F.explode(held).alias("salt"))
    lost = salted.join(kept, ["h1", "h2", "salt"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("doc", "text_hash", "n_lines", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    keep = F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))
    return words.groupBy("doc", "text_hash", "n_lines").agg(keep.alias("keep")).withColumnRenamed("doc", key)


def dropped_places(keep: Column) -> Column:
    """The places whose bits aren't set."""
    places = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * 64 + b)
    return F.flatten(F.transform(keep, places))


def n_dropped(keep: Column) -> Column:
    return F.coalesce(F.aggregate(keep, F.lit(0), lambda n, w: n + 64 - F.bit_count(w["bits"])), F.lit(0)).cast("long")


def kept_text(text: Column, keep: Column) -> Column:
    """The text's lines whose bits are set; where no bitmap is given, the text itself, and empty for null."""
    lines = lines_of(text)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped_places(keep))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))


def with_bitmaps(df: DataFrame, key: str, text: str, least_chars: int, least_docs: int) -> DataFrame:
    """df with its rows' keep bitmaps as `__keep`. Texts are shuffled once, by key and hash."""
    found = keep_bitmaps(df, key, text, least_chars, least_docs).select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"), F.col("keep").alias("__keep"))
    return df.join(found, F.col(key).eqNullSafe(F.col("__key")) & (text_hash(F.col(text)) == F.col("__hash")), "left").drop("__key", "__hash")


def cut_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """df with its text cut by keep_bitmaps(), where the cases are defined, and no column more. A null text becomes empty."""
    return with_bitmaps(df, key, text, least_chars, least_docs).withColumn(text, kept_text(F.col(text), F.col("__keep"))).drop("__keep")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """As cut_lines(), and with n_lines (before) and n_dropped (long), which replace columns of these names."""
    both = with_bitmaps(df, key, text, least_chars, least_docs)
    both = both.withColumn("n_lines", F.size(lines_of(F.col(text))).cast("long")).withColumn("n_dropped", n_dropped(F.col("__keep")))
    return both.withColumn(text, kept_text(F.col(text), F.col("__keep"))).drop("__keep")
