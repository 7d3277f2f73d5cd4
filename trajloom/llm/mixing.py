"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, seeded selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, each_row

#: A source's documents are spread over so many cells of the seeded order; sums over cells replace one long running sum.
CELLS = 4096
#: Blocks to the smallest target or mean document at least; quotas cost the same however many blocks there are.
FINE = 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: source, source_size, others; adds weight and target. There is one row for each source, not for each document.

    Sources in code-point order, null last, take the weights in turn and share `share` times all
    sizes; a target stops at `most` times its source's size and the excess is shared by weight again,
    until none is above. Filling in order of size to weight, a source is at its stop if the level
    reached with all before it at theirs would lift it over.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - (F.sum("stop").over(by) - F.col("stop")))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(every) - (F.sum("weight").over(by) - F.col("weight"))))
    s = s.withColumn("under", F.col("stop") > F.col("weight") * F.col("level"))
    s = s.withColumn("level", F.min_by(F.when(F.col("under"), F.col("level")), F.when(F.col("under"), F.col("stop") / F.col("weight"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("weight") * F.col("level")))
    return s.select(*sizes.columns, "weight", target.alias("target"))


def quotas(target: DataFrame, n_blocks: int | Column, n_shards: int) -> DataFrame:
    """source, block (tokens, double), quota (long), first (int), shard_quotas map<shard int, n long>, for each source with a target.

    Seats go to the highest quotients target/(2k+1), n_blocks in all. Rounding moves the divisor by
    half a seat a source at most, so only the seats between these bounds are ranked, a few for each
    source whatever n_blocks is. A source's seats go to the shards in turn, on from where the source
    before ended (its first seat is of shard `first`), so every shard gets whole blocks in about the same proportions.
    """
    every = Window.partitionBy()
    n = (F.lit(n_blocks) if isinstance(n_blocks, int) else n_blocks).cast("double")
    t = target.withColumn("n_blocks", n).filter("target > 0")
    t = t.withColumn("block", F.sum("target").over(every) / F.col("n_blocks")).withColumn("half", F.count("*").over(every) / 2)
    seats_at = lambda seats: F.floor(F.col("target") / F.col("block") * seats / F.col("n_blocks") + 0.5)
    t = t.withColumn("sure", F.greatest(F.lit(0).cast("long"), seats_at(F.col("n_blocks") - F.col("half")) - 1))
    t = t.withColumn("open", F.col("n_blocks") - F.sum("sure").over(every))
    seats = t.withColumn("k", F.explode(F.sequence("sure", seats_at(F.col("n_blocks") + F.col("half")) + 1)))
    seats = seats.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    seats = seats.withColumn("won", F.row_number().over(Window.orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "k")) <= F.col("open"))
    per = seats.groupBy("source", "block", "sure").agg(F.count_if("won").alias("won")).withColumn("quota", F.col("sure") + F.col("won"))
    first = F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last())) - F.col("quota")
    per = per.withColumn("first", F.pmod(first, F.lit(n_shards)))
    shard = lambda i: F.struct(i.alias("shard"), F.expr(f"quota div {n_shards}").alias("base"), F.pmod(i - F.col("first"), F.lit(n_shards)).alias("turn"))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), shard)
    dealt = F.transform(dealt, lambda x: F.struct(x["shard"].alias("shard"), (x["base"] + (x["turn"] < F.col("quota") % n_shards).cast("long")).alias("n")))
    return per.select("source", "block", "quota", F.col("first").cast("int").alias("first"), F.map_from_entries(F.filter(dealt, lambda x: x["n"] > 0)).alias("shard_quotas"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    n_blocks: int = 8192,
    n_shards: int = 8,
    seed: int = 17,
) -> DataFrame:
    """key, source, text_hash, size, source_size, target, quota, block_words, copies (int), taken, blocks array<long>, shards array<int>: a row for each row of df.

    Sizes are words (runs of anything but ASCII white space). A source's documents lie end to end in a
    seeded order, `most` laps over, from a seeded start on, and are cut into blocks of `block_words`
    words, numbered from there. Its quota takes the first blocks, of which each shard gets its
    quota. A document is taken once for each of its laps in which its middle lies in a block that is
    taken: `blocks` and `shards` say in which and where to. A source at its stop gives all blocks.
    There are `n_blocks` blocks at least, and more until a block is 1/FINE of the smallest target and
    of the smallest mean document of a source. So a source misses its target by about half a document, and reruns agree.

    A null text has no words and is never taken; a null source is a source of its own, after all
    others; rows that repeat or share a key are documents of their own; an empty table gives no rows.
    Other columns are ignored.

    Texts are read once and never shuffled: rows without them are, by all their columns, where rows
    that repeat are counted before and after the shuffle, then by (source, cell of the seeded
    order), and in parts before they are unfolded. So neither a source with a third of all rows nor a row as common as that is one task's load.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(text).alias("text_hash"), n_words(F.col(text)).alias("size"))
    docs = rows.groupBy("source", "key", "text_hash", "size").agg(F.count("*").alias("rows"))
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "key", "text_hash"))
    docs = docs.withColumn("cell", F.shiftright("h", 40).bitwiseAND(CELLS - 1).cast("int"))  # never null, so no filter sets the two uses of the shuffle apart
    cells = docs.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("rows")).alias("n"), F.sum(F.when(F.col("size") > 0, F.col("rows")).otherwise(0)).alias("n_docs"))
    start = F.sum(F.when(F.col("cell") < F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source"), F.lit(CELLS)), F.col("n")).otherwise(0))
    per_source = cells.groupBy("source").agg(F.sum("n").alias("source_size"), F.sum("n_docs").alias("n_docs"), start.alias("start"))
    goal = targets(per_source, weights, share, most)
    every = Window.partitionBy()
    finest = F.min(F.when(F.col("target") > 0, F.least(F.col("target"), F.col("source_size") / F.col("n_docs")))).over(every) / FINE
    goal = goal.withColumn("n_blocks", F.greatest(F.lit(n_blocks).cast("double"), F.ceil(F.sum("target").over(every) / finest).cast("double"))).drop("n_docs")
    q = quotas(goal, F.col("n_blocks"), n_shards).drop("shard_quotas")
    own = [F.coalesce(f"q.{c}", F.lit(none)).alias(c) for c, none in (("quota", 0), ("block", 0.0), ("first", 0))]
    goal = goal.drop("n_blocks").alias("g").join(q.alias("q"), F.col("g.source").eqNullSafe(F.col("q.source")), "left").select("g.*", *own)
    starts = cells.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("cell")) - F.col("n")).drop("n", "n_docs")
    starts = starts.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("g.*", "c.cell", "c.before")
    by = Window.partitionBy("source", "cell").orderBy("h", "key", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("at", F.sum(F.col("size") * F.col("rows")).over(by) - F.col("size") * F.col("rows"))
    out = docs.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.cell") == F.col("s.cell"))).drop(F.col("s.source"), F.col("s.cell"))
    out = each_row(out.withColumn("nth", F.lit(0).cast("long")), "rows", "nth", ["key", "text_hash"])
    middle = F.pmod(F.col("before") + F.col("at") + F.col("nth") * F.col("size") - F.col("start") + F.col("size") / 2, F.col("source_size").cast("double"))
    laps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda lap: F.floor((F.col("middle") + lap * F.col("source_size")) / F.col("block")))
    held = (F.col("size") > 0) & (F.col("block") > 0)
    out = out.withColumn("middle", middle).withColumn("blocks", F.when(held, F.filter(laps, lambda b: (b < F.col("quota")) | (F.col("target") >= most * F.col("source_size")))).otherwise(F.array().cast("array<bigint>")))
    copies = F.size("blocks")

    def shard(block: Column) -> Column:
        """Each shard's quota is a stretch of the source's blocks, from shard `first` on; the first quota % n_shards have one more."""
        b = F.least(block, F.col("quota") - 1)
        each, more = F.expr(f"quota div {n_shards}"), F.col("quota") % n_shards
        turn = F.when(b < more * (each + 1), F.floor(b / (each + 1))).otherwise(more + F.floor((b - more * (each + 1)) / each))
        return F.pmod(F.col("first") + turn, F.lit(n_shards)).cast("int")

    return out.select(
        F.col("key").alias(key), F.col("source").alias(source), "text_hash", "size", "source_size", "target", "quota", F.col("block").alias("block_words"),
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "blocks", F.transform("blocks", shard).alias("shards"),
    )
