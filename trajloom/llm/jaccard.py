"""N-gram Jaccard join: parity sketches, a pigeonhole join on their blocks, exact verification.

A document is a set of hashed word shingles. XOR-ing the hashes that fall into each of K blocks gives
a sketch in which a token of the symmetric difference changes one block at most, so the number of
differing blocks bounds that difference from below. Two sets of at least the wanted similarity differ
in at most (|A|+|B|)/9 tokens (for 0.8), so with more blocks than that one block at least is equal,
and an equi-join on blocks finds every link. A finer sketch of parity bits then drops pairs whose
Hamming distance is too large, and the rest are verified on their whole sets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, lean, slices, small_batches

#: Odd multipliers that spread bits (fixed values: golden ratio, and two from the MurmurHash3 finalizer).
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: A size band ends at this many times its start.
BAND_RATIO = 1.5
#: Entries of the table of frequent shingles, and of what a task keeps for it. They only make keys more
#: selective: links are found whatever the table holds.
FREQUENT, FREQUENT_TASK = 1 << 16, 20_000
#: Bits of the filter of documents whose sets are fetched, 1 MB; a fuller one lets more sets through.
FILTER_BITS = 1 << 23
#: Up to so many classes of a block are compared as pairs of ids; larger blocks in tiles of so many sketches a side.
SMALL, TILE = 64, 1024
#: Hashes that a task holds, as whole sets, before it counts them (8 MB).
HELD = 1 << 20
#: Numbers of sets that a task remembers so as not to give them again; it then forgets them all, and gives some twice.
SEEN = 1 << 16
#: What the filter takes for a null key.
NO_KEY = -(1 << 63)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX_A
    h = (h ^ (h >> np.uint64(29))) * MIX_B
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles, A-Z lower-cased; of fewer words, of all as one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h *= GOLDEN
        h += w[k : len(w) - n + 1 + k]
    return np.unique(mix(h))


def class_id(h: np.ndarray) -> int:
    """A signed 64-bit number of the set: equal sets have equal numbers."""
    return int((mix(h ^ GOLDEN).sum(dtype=np.uint64) + np.uint64(len(h))).astype(np.int64))


def second_id(h: np.ndarray) -> int:
    """Another such number, independent of the first: sets are held for equal only if both agree, that is, in 128 bits."""
    return int((mix((h ^ MIX_B) * GOLDEN).sum(dtype=np.uint64) ^ np.uint64(len(h))).astype(np.int64))


def number(h: np.ndarray, shared: frozenset[int]) -> int:
    """The set's number: class_id(), or, where different sets share that, second_id()."""
    c = class_id(h)
    return second_id(h) if c in shared else c


class Seen:
    """Remembers numbers, a bounded lot of them."""

    def __init__(self):
        self.known: set[int] = set()

    def first(self, c: int) -> bool:
        """Whether c is new, as far as is remembered."""
        if c in self.known:
            return False
        if len(self.known) >= SEEN:
            self.known.clear()
        self.known.add(c)
        return True


def most_apart(total: int, percent: int) -> int:
    """The largest symmetric difference of two sets of `total` elements together that have the similarity."""
    return total * (100 - percent) // (100 + percent)


class Bands:
    """Size bands: band t holds sizes low[t] to low[t+1]-1, has blocks[t] blocks, of which apart[t] may differ."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND_RATIO)))
        self.apart = [most_apart(2 * (b - 1), percent) for b in self.low[1:]]
        self.spare = [1 + -(-(d + 1) * 15 // 100) for d in self.apart]
        self.blocks = [d + 1 + s for d, s in zip(self.apart, self.spare, strict=True)]

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n elements looks for partners: its own, and the next ones that its partners reach."""
        t = int(np.searchsorted(self.low, n, "right")) - 1
        out, largest = [t], n * 100 // self.percent
        while self.low[t + 1] <= largest:
            t += 1
            out.append(t)
        return [t for t in out if self.apart[t]]  # where none may differ, sets are equal and of one class


def block_keys(h: np.ndarray, rank: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of which two similar sets share one at least.

    rank: for each hash its place among the frequent shingles, -1 for the others. Only the others go
    into blocks: leaving the same tokens out of both sets can't raise their difference. Empty
    blocks give no key, so a set may have at most `spare` of them to be sure of a common key that isn't
    empty. A set with more also gives its rarest tokens as keys (a prefix filter); a pair that
    shares no block is of two such sets and shares one of those.
    """
    out, n, rare = [], len(h), h[rank < 0]
    for t in bands.of(n):
        k = np.uint64(bands.blocks[t])
        block = (rare >> np.uint64(20)) % k
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
        if len(starts):
            words = np.bitwise_xor.reduceat(rare[order], starts)
            out.append(mix(words ^ mix(block[starts] * GOLDEN + np.uint64(2 * t + 1))))
        if int(k) - len(starts) > bands.spare[t]:
            prefix = n - -(-n * bands.percent // 100) + 1
            rarest = h[np.lexsort((h, rank))[:prefix]]
            out.append(mix(rarest ^ mix(np.array([2 * t + 2], np.uint64) * GOLDEN)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def parity_bits(h: np.ndarray, words: int) -> np.ndarray:
    """A sketch of 64*words bits: each token flips one, so the Hamming distance is at most the symmetric difference."""
    bit = mix(h + GOLDEN) % np.uint64(64 * words)
    flips = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def sketch_words(n: int) -> int:
    """64-bit words of a set's sketch: a power of two, four to eight bits for each token, so few flips meet."""
    return 1 << max(0, (max(n, 1) - 1).bit_length() - 4)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (row, word) of half or a quarter the length, as the same tokens would give."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near_pairs(ids: np.ndarray, groups: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right row, of different groups, whose sizes and Hamming distance allow the similarity.

    left and right: numbers of rows. Where they share rows, pairs come in one order.
    """
    words = min(len(s) for s in sketches)
    bits = np.stack([folded(s[None], words)[0] for s in sketches]).view(np.uint64)
    out_a, out_b = [], []
    for i in left:
        total = sizes[i] + sizes[right]
        apart = np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1, dtype=np.int64)
        good = (apart * (100 + percent) <= total * (100 - percent)) & (groups[right] != groups[i]) & (100 * np.minimum(sizes[i], sizes[right]) >= percent * np.maximum(sizes[i], sizes[right])) & (ids[right] != ids[i])
        found = ids[right[good]]
        out_a.append(np.minimum(found, ids[i]))
        out_b.append(np.maximum(found, ids[i]))
    return np.concatenate(out_a), np.concatenate(out_b)


def ranks(h: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places of hashes in the frequent table (sorted hashes, their places), -1 for others."""
    if not len(frequent):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, place[at], -1)


def highest(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if len(values) <= most:
        return values, counts
    top = np.sort(np.argpartition(counts, -most)[-most:])
    return values[top], counts[top]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum two tables of counts and keep the highest."""
    values, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([a[1], b[1]]), minlength=len(values)).astype(np.int64)
    return highest(values, counts, most)


def repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of more than one set, and of how many."""
    values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
    many = counts > 1 + len(sets) // 2000
    return values[many], counts[many]


def documents_and_counts(docs: DataFrame, n: int) -> DataFrame:
    """id, text_hash, n, cid, cid2 of each document (docs: id, text, text_hash); and rows with these null: a shingle and in how many distinct sets of a task it is."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, rows = (np.empty(0, np.uint64), np.empty(0, np.int64)), Seen(), 0
        new: list[np.ndarray] = []
        names = ["id", "text_hash", "n", "cid", "cid2", "shingle", "count"]
        for batch in slices(batches, 1):
            sizes, ids, others = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t, n)
                sizes.append(len(h))
                ids.append(class_id(h) if len(h) else None)
                others.append(second_id(h) if len(h) else None)
                if len(h) and seen.first(ids[-1]):
                    new.append(h)
                    rows += 1
            if sum(map(len, new)) > HELD:
                table = merged(table, repeated(new), 4 * FREQUENT_TASK)
                new.clear()
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(others, pa.int64()), none, none], names=names)
        values, counts = merged(table, repeated(new), FREQUENT_TASK)
        many = counts > max(2, rows // 1000)
        none = pa.nulls(int(many.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(values[many].astype(np.int64)), pa.array(counts[many])], names=names)

    return docs.mapInArrow(lean(scan), "id long, text_hash long, n long, cid long, cid2 long, shingle long, count long")


def keyed(docs: DataFrame, n: int, percent: int, frequent: np.ndarray, place: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """key, cid: the block keys of each class, once or more for each task that meets it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), Seen()
        for batch in slices(batches, 1):
            keys, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for t in batch.column(1).to_pylist():
                h = shingles(t, n)
                if len(h) and seen.first(c := number(h, shared)):
                    k = block_keys(h, ranks(h, frequent, place), bands)
                    keys.append(k)
                    ids.append(np.full(len(k), c))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "cid"])

    return docs.mapInArrow(lean(scan), "key long, cid long")


def fetched(docs: DataFrame, n: int, bits: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """cid, size, sketch, tokens of the classes that the filter lets through, once or more for each task that meets one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in slices(batches, 1):
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = xxhash.xxh64_intdigest(struct.pack("<q", NO_KEY if i is None else i), 42) % FILTER_BITS
                if not bits[at >> 6] >> np.uint64(at & 63) & np.uint64(1):
                    continue
                h = shingles(t, n)
                if len(h) and seen.first(c := number(h, shared)):
                    out.append((c, len(h), parity_bits(h, sketch_words(len(h))), h.view(np.int64)))
            for k in range(0, len(out), 256):
                c, m, s, h = zip(*out[k : k + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.list_(pa.int64())), pa.array(h, pa.list_(pa.int64()))], names=["cid", "size", "sketch", "tokens"])

    return docs.mapInArrow(lean(scan), "cid long, size long, sketch array<long>, tokens array<long>")


def sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and Hamming distance allow the similarity; only sketches are joined."""
    left = sets.select(F.col("cid").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("s"))
    right = sets.select(F.col("cid").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("t"))
    both = pairs.join(left, "a").join(right, "b")
    sized = 100 * F.least("m", "n") >= percent * F.greatest("m", "n")
    # where lengths differ (by a factor of two), the longer one is folded by XOR
    fold = lambda u, v: F.when(F.size(u) > F.size(v), F.zip_with(F.slice(u, 1, F.size(v)), F.slice(u, F.size(v) + 1, F.size(v)), lambda p, q: p.bitwiseXOR(q))).otherwise(u)
    apart = F.aggregate(F.zip_with(fold(F.col("s"), F.col("t")), fold(F.col("t"), F.col("s")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    near = apart * (100 + percent) <= (F.col("m") + F.col("n")) * (100 - percent)
    return both.filter(F.when(sized, near).otherwise(F.lit(False))).select("a", "b").distinct()


def only(sets: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """The sets that pairs name and, if the filter is crowded, some more: so the rest isn't shuffled.

    The filter is a table of bits/64 words at most, which is broadcast; see filter_bits() for its bound.
    """
    at = F.pmod(F.xxhash64("cid"), F.lit(bits))
    named = pairs.select(F.explode(F.array("a", "b")).alias("cid")).select(at.alias("at"))
    words = named.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    marked = sets.withColumn("at", at).withColumn("word", F.expr("at div 64")).join(F.broadcast(words), "word")
    return marked.filter(F.getbit("bits", (F.col("at") % 64).cast("int")) == 1).select(*sets.columns)


def filter_bits(n: int) -> int:
    """A power of two, about 16 bits for each of n entries, 2**26 (a table of 16 MB) at most."""
    return 1 << min(26, max(16, (16 * n).bit_length()))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    left = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    return pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b").distinct()


def tiled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components in one block that sizes and Hamming distance allow. members: key, cid, own, n.

    A block is cut into chunks of about TILE rows by hash; every two chunks meet in a group of their
    own, so no task holds a block, and only near pairs leave it.
    """
    m = members.withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
    m = m.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).join(sets.select("cid", "size", "sketch"), "cid")
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    m = m.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "cid", "own", "size", "sketch")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        ids, own, sizes, chunk = (t[c].to_numpy() for c in ("cid", "own", "size", "chunk"))
        sketches = [np.asarray(x, np.int64) for x in t["sketch"].to_pylist()]
        lo, hi = np.flatnonzero(chunk == key[1].as_py()), np.flatnonzero(chunk == key[2].as_py())
        none = np.empty(0, np.int64)
        a, b = near_pairs(ids, own, sizes, sketches, lo, hi, percent) if len(lo) and len(hi) else (none, none)
        pairs = np.unique(np.stack([a, b]), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return m.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def mates(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different `own` in one block: all of the small blocks, near ones of the large. members: key, cid, own, n."""
    few = members.filter(F.col("n") <= SMALL)
    mate = few.select("key", F.col("cid").alias("mate"), F.col("own").alias("other"))
    pairs = few.join(mate, "key").filter("cid < mate and own <> other").select(F.col("cid").alias("a"), F.col("mate").alias("b"))
    return pairs, tiled(members.filter(F.col("n") > SMALL).select("key", "cid", "own", "n"), sets, percent)


def again(name: str) -> Column:
    """The long column as an expression: a join then deals its rows anew, so that Spark can split a hot key's (a star's centre, a large class)."""
    return F.col(name).bitwiseXOR(F.lit(0)).alias(name)


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """v, label: the smallest node that each linked node reaches. links: a, b.

    Stars in turn: every node hands its larger neighbours to the smallest one it knows, then its
    smaller ones, until nothing changes; a few rounds, each a written table.
    """
    edges = tables.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(again("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(again("u"), "m")
        small = large.select(again("u"), "v").join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = tables.write(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(edges.select(F.col("v"), F.col("v").alias("label")).distinct())
    return tables.write(found, "labels")


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links). documents: key, text_hash, component, n_shingles, class_id, component_id for each row of df; links: a, b, verified pairs of sets' numbers.

    Without every_link, links are spanning links: enough to connect each component, not all of it.
    With it they are all links between different sets, a group of k near copies having up to
    k(k-1)/2, and documents have n_links (long), the other sets that their set links with.

    A document's set is its distinct n-word shingles (words: runs of anything but ASCII white space,
    A-Z lower-cased), all words as one shingle if there are fewer. Documents link if 100 * common >=
    percent * all. component_id is the smallest key reachable by links, the own included; class_id
    is the smallest key with an equal set. component is a number of the component, for rows whose key is
    null or shared too (null without a set); text_hash is xxhash64(text). Such copies are one class, found by two 64-bit numbers of the set, and make no pairs.

    A null or empty text has no set, no class and no links, and is its own class and component. Rows with a null
    key take part like others; the component of such rows alone is null. Rows that repeat or share a
    key are documents of their own. An empty table gives no rows; other columns are ignored.

    A class is first compared with the most connected class it shares a block with, then with the
    leaders of the blocks whose classes are still in several components; only what is left open
    after that is compared within blocks, and by sketches before sets. So a large group of near
    copies costs about a verification each, and no link that joins components is lost. Texts aren't
    shuffled; sets are, of classes that share a block with another.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    scanned = tables.write(documents_and_counts(docs.withColumn("text_hash", F.xxhash64("text")), n), "documents")
    rows = scanned.filter("n is not null").select("id", "text_hash", "n", "cid", "cid2")
    total = max(1, rows.select("cid").count())
    # different sets that share a 64-bit number: total**2 / 2**65 are expected, 300 of 10**11
    twice = rows.groupBy("cid").agg(F.min("cid2").alias("lo"), F.max("cid2").alias("hi")).filter("lo < hi").select("cid").collect()
    same = frozenset(r["cid"] for r in twice)
    rows = rows.withColumn("cid", F.when(F.col("cid").isin(*same), F.col("cid2")).otherwise(F.col("cid"))) if same else rows
    rows = rows.drop("cid2")
    heavy = scanned.filter("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("c")).filter(F.col("c") > max(8, total // 1000))
    top = heavy.orderBy(F.desc("c"), "shingle").limit(FREQUENT).collect()  # bounded by FREQUENT
    hashes = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    frequent, place = hashes[order], (len(top) - order).astype(np.int64)  # the more frequent, the later

    by_key = Window.partitionBy("key")
    blocks = keyed(docs, n, percent, frequent, place, same)
    blocks = blocks.withColumn("lo", F.min("cid").over(by_key)).withColumn("hi", F.max("cid").over(by_key)).filter("lo < hi").select("key", "cid").distinct()
    shared = tables.write(blocks, "shared")
    reps = rows.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"))
    sought = shared.select("cid").distinct().join(reps, "cid")
    word = F.expr(f"pmod(hash64, {FILTER_BITS})")
    marks = sought.select(F.xxhash64(F.coalesce("rep", F.lit(NO_KEY))).alias("hash64")).select(word.alias("at"))
    # xxhash64 is signed here and unsigned in the scan; the filter's size divides 2**64, so the remainders agree
    marks = marks.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()  # bounded by FILTER_BITS
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in marks:
        bits[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    sets = tables.write(fetched(docs, n, bits, same), "sets")

    # of each block the most connected class leads; of its blocks' leaders a class is first compared with the most connected one
    pop = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("cid").agg(F.sum("n").alias("pop")).select(again("cid"), "pop")
    lead = shared.join(pop, "cid").groupBy("key").agg(F.max(F.struct("pop", "cid")).alias("lead"), F.count("*").alias("n")).select(again("key"), "lead", "n")
    ranked = tables.write(shared.join(lead, "key").select("key", "cid", F.col("lead.pop").alias("pop"), F.col("lead.cid").alias("leader"), "n"), "ranked")

    none = spark.createDataFrame([], "a long, b long")
    tested, links, labels = none, none, spark.createDataFrame([], "v long, label long")
    ordered = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    for step in ("best leader", "every leader", "the rest"):
        if step == "best leader":
            pairs = ranked.filter("cid <> leader").groupBy("cid").agg(F.max(F.struct("pop", "leader")).alias("x")).select(*ordered("cid", "x.leader"))
            near = none
        else:
            own = labels.select(F.col("v").alias("cid"), F.col("label").alias("own"))
            at = ranked.join(own, "cid", "left").withColumn("own", F.coalesce("own", "cid"))
            unsettled = at.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo < hi").select("key")
            at = tables.write(at.join(unsettled, "key", "left_semi"), "open")
            if at.isEmpty():
                break
            if step == "every leader":
                other = labels.select(F.col("v").alias("leader"), F.col("label").alias("other"))
                pairs = at.join(other, "leader", "left").filter("own <> coalesce(other, leader)").select(*ordered("cid", "leader"))
                near = none
            else:
                pairs, near = mates(at, sets, percent)
        pairs = tables.write(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        near = sketched(pairs, sets, percent).unionByName(near).distinct().join(tested, ["a", "b"], "left_anti")
        near = tables.write(near, "near")
        found = tables.write(verified(near, only(sets, near, filter_bits(near.count())), percent), "links")
        tested, links = tested.unionByName(pairs), links.unionByName(found)
        if found.isEmpty():
            continue
        stars = labels.filter("v <> label").select(F.col("v").alias("a"), F.col("label").alias("b"))
        labels = components(found.unionByName(stars), tables)

    if every_link:
        pairs, near = mates(ranked.withColumn("own", F.col("cid")), sets, percent)
        near = tables.write(sketched(tables.write(pairs.distinct(), "pairs"), sets, percent).unionByName(near).distinct(), "near")
        links = tables.write(verified(near, only(sets, near, filter_bits(near.count())), percent), "links")
    tables.remove("shared", "sets", "ranked", "edges", "open")
    least = labels.join(reps.withColumnRenamed("cid", "v"), "v").groupBy("label").agg(F.min("rep").alias("component_id"))
    of = labels.join(least, "label").select(F.col("v").alias("cid"), "label", "component_id")
    known = F.col("label").isNotNull()
    of = reps.join(of, "cid", "left").select("cid", "rep", F.coalesce("label", "cid").alias("component"), F.when(known, F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    of = tables.write(of, "components")
    alone = F.col("cid").isNull()
    out = rows.join(of, "cid", "left").select(
        "cid", F.col("id").alias(key), "text_hash", "component", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    if every_link:
        n_links = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
        out = out.join(n_links, "cid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return out.drop("cid"), links
