"""Consistent-hash ring with virtual nodes and bounded loads, as joins and windows over bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import each_row

#: The ring has 2**RING_BITS cells; a key's cell is the top bits of its hash.
RING_BITS = 16


def key_hash(key: Column, text: Column) -> Column:
    """A key's place on the ring; rows without a key are spread by their text."""
    return F.when(key.isNull(), F.xxhash64(F.lit(1), text)).otherwise(F.xxhash64(F.lit(0), key))


def ring(spark: SparkSession, n_shards: int, vnodes: int) -> DataFrame:
    """cell int, arc int, shard int, pos int: each cell of the ring and the virtual node that follows it clockwise.

    An arc's number is its virtual node's place in ring order; pos is the cell's place in its arc. A
    shard's virtual nodes don't depend on how many shards there are. 2**RING_BITS rows.
    """
    top = 1 << RING_BITS
    nodes = spark.range(n_shards * vnodes).select(
        (F.col("id") % n_shards).cast("int").alias("shard"), F.expr(f"cast(id div {n_shards} as int)").alias("replica")
    )
    nodes = nodes.withColumn("h", F.xxhash64(F.lit("virtual node"), "shard", "replica")).withColumn("end", F.shiftrightunsigned("h", 64 - RING_BITS))
    nodes = nodes.groupBy("end").agg(F.min_by("shard", "h").alias("shard"))  # of two nodes in a cell the first has the keys
    by = Window.orderBy("end")
    nodes = nodes.select("shard", "end", (F.row_number().over(by) - 1).cast("int").alias("arc"), F.lag("end").over(by).alias("before"), F.max("end").over(Window.partitionBy()).alias("final"))
    begin = F.when(F.col("before").isNull(), F.col("final") - top).otherwise(F.col("before")) + 1
    cells = nodes.select("arc", "shard", F.posexplode(F.sequence(begin, F.col("end"))).alias("pos", "cell"))
    return cells.select(F.pmod("cell", F.lit(top)).cast("int").alias("cell"), "arc", "shard", "pos")


def pieces(cells: DataFrame, n_shards: int, slack: float) -> DataFrame:
    """Where each arc's keys go: arc, lo, hi, shard, base; its keys of rank lo to hi-1 get slots from base on.

    cells: cell, arc, shard, pos, n (keys). A shard holds ceil((1+slack) * mean) keys at most; with no
    slack the first shards hold one key more than the rest. Its own keys come first, in ring order;
    the others go on clockwise, first come first served, and take what room they pass. The tables here
    have a row for each arc, which the ring's parameters bound.
    """
    arcs = cells.groupBy("arc", "shard").agg(F.sum("n").alias("n"))
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    most = F.ceil(F.round(total * (1 + slack) / n_shards, 6)) if slack else F.expr(f"total div {n_shards}") + F.when(F.col("shard") < F.col("total") % n_shards, 1).otherwise(0)
    own = Window.partitionBy("shard")
    arcs = arcs.withColumn("total", total).withColumn("most", most.cast("long"))
    arcs = arcs.withColumn("came", F.sum("n").over(own.orderBy("arc")) - F.col("n"))
    arcs = arcs.withColumn("home", F.greatest(F.lit(0), F.least("n", F.col("most") - F.col("came"))).cast("long"))
    arcs = arcs.withColumn("over", F.col("n") - F.col("home")).withColumn("room", F.greatest(F.lit(0), F.col("most") - F.sum("n").over(own)).cast("long"))

    # a walk of two laps round the ring carries the keys on
    one = arcs.agg(
        F.array_sort(F.collect_list(F.struct("arc", "shard", "over"))).alias("lap"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("shard", "room")))).alias("rooms"),
    )
    one = one.select(
        F.concat("lap", F.transform("lap", lambda x: F.struct(x["arc"].alias("arc"), x["shard"].alias("shard"), F.lit(0).cast("long").alias("over")))).alias("laps"),
        F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.coalesce(F.element_at("rooms", s), F.lit(0).cast("long"))).alias("rooms"),
    )
    start = F.struct(F.lit(0).cast("long").alias("carried"), F.col("rooms").alias("rooms"), F.array().cast("array<struct<shard:int,n:bigint>>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        here, room = a["carried"] + x["over"], F.get(a["rooms"], x["shard"])
        take = F.least(here, room)
        return F.when(take > 0, F.struct(
            (here - take).alias("carried"),
            F.transform(a["rooms"], lambda r, i: F.when(i == x["shard"], r - take).otherwise(r)).alias("rooms"),
            F.concat(a["taken"], F.array(F.struct(x["shard"].alias("shard"), take.alias("n")))).alias("taken"),
        )).otherwise(F.struct(here.alias("carried"), a["rooms"].alias("rooms"), a["taken"].alias("taken")))

    taken = one.select(F.posexplode(F.aggregate("laps", start, step)["taken"]).alias("k", "x")).select("k", "x.shard", "x.n")
    # both sequences on one axis of carried keys: a segment starts where an arc or a taker starts
    order = lambda k: Window.orderBy(k)
    givers = arcs.withColumn("end", F.sum("over").over(every)).filter("over > 0").select((F.sum("over").over(order("arc")) - F.col("over")).alias("x"), "arc", F.lit(None).cast("int").alias("shard"), "home", "end", F.lit(0).alias("kind"))
    takers = taken.select((F.sum("n").over(order("k")) - F.col("n")).alias("x"), F.lit(None).cast("int").alias("arc"), "shard", F.lit(None).cast("long").alias("home"), F.lit(None).cast("long").alias("end"), F.lit(1).alias("kind"))
    both = givers.withColumn("begin", F.col("x")).unionByName(takers.withColumn("begin", F.lit(None).cast("long")))
    w = Window.orderBy("x", "kind")
    filled = both.select("x", F.lead("x").over(w).alias("next"), *(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("arc", "shard", "home", "begin", "end")))
    moved = filled.withColumn("next", F.coalesce("next", "end")).filter("next > x")
    moved = moved.select("arc", (F.col("home") + F.col("x") - F.col("begin")).alias("lo"), (F.col("home") + F.col("next") - F.col("begin")).alias("hi"), "shard")
    stay = arcs.filter("home > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("home").alias("hi"), "shard")
    out = stay.unionByName(moved)
    return out.withColumn("base", F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("shard").orderBy("arc", "lo")) - (F.col("hi") - F.col("lo")))


def ring_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Each row's key, size, text_crc32, home_shard, shard and slot: a bounded-load consistent-hash ring over `key`.

    slack 0: shards' row counts differ by one at most. slack > 0: none holds over (1+slack) times the
    mean, and fewer keys move when a shard is added. slot numbers a shard's rows without gaps from 0.
    size: UTF-8 bytes of the text plus 16. A null text counts as empty; rows with a null key are placed
    by their text; repeated rows and equal keys each take a place of their own; an empty table gives
    no rows. Other columns are ignored, so theirs can't clash.

    The rows are shuffled without their texts: by all their columns, where rows that repeat are
    counted before and after, by ring cell, and in parts before they are unfolded. So a row that a third
    of the table repeats is one row until the end, where its parts are dealt over the tasks. Tables that are broadcast have at most 2**RING_BITS rows.
    """
    spark = df.sparkSession
    k, whole = F.col(key), F.coalesce(F.col(text), F.lit(""))
    rows = df.select(k.alias("key"), key_hash(k, whole).alias("h"), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"))
    rows = rows.groupBy("key", "h", "size", "crc").agg(F.count("*").alias("m"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - RING_BITS).cast("int"))
    cells = ring(spark, n_shards, vnodes).join(rows.groupBy("cell").agg(F.sum("m").alias("n")), "cell", "left").fillna(0, ["n"])
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("pos")) - F.col("n")
    found = cells.select("cell", "arc", F.col("shard").alias("home_shard"), before.alias("before"))
    by = Window.partitionBy("cell").orderBy("h", "key", "crc", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("rank", F.sum("m").over(by) - F.col("m")).join(F.broadcast(found), "cell").withColumn("rank", F.col("rank") + F.col("before"))
    place = F.broadcast(pieces(cells, n_shards, slack))
    placed = ranked.join(place, "arc").filter("rank < hi and rank + m > lo")  # equal rows take the ranks from rank to rank + m - 1
    placed = placed.withColumn("nth", F.greatest("rank", "lo")).withColumn("m", F.least(F.col("rank") + F.col("m"), F.col("hi")) - F.col("nth"))
    placed = each_row(placed.select("key", "size", "crc", "home_shard", "shard", "base", "lo", "m", "nth"), "m", "nth", ["key", "crc"])
    return placed.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "home_shard", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("nth") - F.col("lo")).cast("long").alias("slot"))
