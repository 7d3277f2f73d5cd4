"""How sources differ from their language: terms counted in radix tries that are merged by ranges of prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, lean, slices, small_batches

#: What stands between terms: ASCII other than letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
#: Counters that a task's trie holds before it is written out and begun anew, and that a merge takes in at a time.
MOST = 700_000
#: Counts of terms by sources that a worker compares at a time.
CELLS = 1 << 18
LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
LEAF_DDL = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Names:
    """Numbers of strings that come again and again: languages and sources."""

    def __init__(self):
        self.of: dict[str, int] = {}

    def codes(self, texts: pa.Array) -> np.ndarray:
        coded = texts.dictionary_encode()
        own = np.array([self.of.setdefault(t, len(self.of)) for t in coded.dictionary.to_pylist()], np.int64)
        return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)

    def texts(self, codes: np.ndarray) -> pa.Array:
        return pa.array(list(self.of), pa.string()).take(pa.array(codes))


class Trie:
    """A radix trie of (language, term) in linear form: its leaves in byte order, from which neighbours' common beginnings give the inner nodes.

    Each leaf has the number of documents, and a counter for each source: those of leaf i are source[start[i] : start[i + 1]] and count[...].
    A term of no characters stands for a language itself, so that sources without terms are known.
    """

    def __init__(self, lang: np.ndarray, term: pa.Array, docs: np.ndarray, start: np.ndarray, source: np.ndarray, count: np.ndarray):
        self.lang, self.term, self.docs, self.start, self.source, self.count = lang, term, docs, start, source, count

    def shared(self) -> np.ndarray:
        """Bytes that each leaf's term has in common with the leaf before it: where the trie branches."""
        terms = [t.encode() for t in self.term.to_pylist()]
        same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return np.array([0] + [same(a, b) if self.lang[i] == self.lang[i + 1] else 0 for i, (a, b) in enumerate(zip(terms, terms[1:], strict=False))][: len(terms)])

    @staticmethod
    def of(lang: np.ndarray, term: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> Trie:
        """The trie of leaves in any order, repeated ones merged; leaf: the place in these of the one that a counter belongs to."""
        coded = term.dictionary_encode()
        n, order = len(coded.dictionary), pc.sort_indices(coded.dictionary).to_numpy()  # by bytes
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        key = lang * max(n, 1) + rank[coded.indices.to_numpy()]
        own, place = np.unique(key, return_inverse=True)
        width = int(source.max(initial=0)) + 1
        pair, at = np.unique(place[leaf] * width + source, return_inverse=True)
        total = lambda where, what, size: np.bincount(where, weights=what, minlength=size).astype(np.int64)  # noqa: E731  (exact below 2^53)
        start = np.searchsorted(pair // width, np.arange(len(own) + 1))
        names = coded.dictionary.take(pa.array(order)).take(pa.array(own % max(n, 1)))
        return Trie(own // max(n, 1), names, total(place, docs, len(own)), start, pair % width, total(at, count, len(pair)))

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        if len(tries) == 1:
            return tries[0]
        offset = np.cumsum([0, *(len(t.docs) for t in tries)])
        each = [np.repeat(np.arange(len(t.docs)) + o, np.diff(t.start)) for t, o in zip(tries, offset, strict=False)]
        join = lambda name: np.concatenate([getattr(t, name) for t in tries])
        return Trie.of(join("lang"), pa.concat_arrays([t.term for t in tries]), join("docs"), np.concatenate(each), join("source"), join("count"))

    def only(self, keep: np.ndarray) -> Trie:
        sizes = np.diff(self.start)
        inner = np.repeat(keep, sizes)
        return Trie(self.lang[keep], self.term.filter(pa.array(keep)), self.docs[keep], np.cumsum([0, *sizes[keep]]), self.source[inner], self.count[inner])

    def batches(self, langs: Names, sources: Names, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.docs), rows):
            end = min(at + rows, len(self.docs))
            a, b = int(self.start[at]), int(self.start[end])
            start = pa.array(self.start[at : end + 1] - a, pa.int32())
            columns = [langs.texts(self.lang[at:end]), self.term.slice(at, end - at), pa.array(self.docs[at:end]), pa.ListArray.from_arrays(start, sources.texts(self.source[a:b])), pa.ListArray.from_arrays(start, pa.array(self.count[a:b]))]
            yield pa.RecordBatch.from_arrays(columns, schema=LEAF)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def trie_of(lang: np.ndarray, source: np.ndarray, texts: pa.Array) -> Trie:
    """Terms of some texts, each counted once for each occurrence, and once for each document."""
    terms = pc.split_pattern_regex(texts, pattern=GAP)
    coded = pc.ascii_lower(terms.flatten()).dictionary_encode()
    names = coded.dictionary
    n = max(len(names), 1)
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), terms.value_lengths().to_numpy())
    empty = pc.index(names, "").as_py()
    if empty >= 0:
        code, doc = code[code != empty], doc[code != empty]
    each, times = np.unique(doc * n + code, return_counts=True)
    doc, code = each // n, each % n
    # a leaf for each document and term, and one without a term for each document
    everything = pa.concat_arrays([names.take(pa.array(code)), pa.array([""] * len(texts), pa.string())])
    of = np.concatenate([doc, np.arange(len(texts))])
    count = np.concatenate([times, np.zeros(len(texts), np.int64)])
    return Trie.of(lang[of], everything, np.ones(len(of), np.int64), np.arange(len(of)), source[of], count)


@lean
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to the leaves of the task's trie; whole texts, in tries of a bounded number of counters."""
    langs, sources = Names(), Names()
    held: list[Trie] = []
    size = 0
    for some in slices(batches, column=2, size=4 << 20):
        held.append(trie_of(langs.codes(some.column(0)), sources.codes(some.column(1)), some.column(2)))
        size += len(held[-1].count)
        if size > 2 * MOST or len(langs.of) + len(sources.of) > MOST:
            held = [Trie.merged(held)]
            size = len(held[0].count)
            if size > MOST or len(langs.of) + len(sources.of) > MOST:
                yield from held[0].batches(langs, sources)
                held, size, langs, sources = [], 0, Names(), Names()
    if held:
        yield from Trie.merged(held).batches(langs, sources)


def read_trie(batch: pa.RecordBatch, langs: Names, sources: Names) -> Trie:
    lists = batch.column(3)
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    return Trie(langs.codes(batch.column(0)), batch.column(1), batch.column(2).to_numpy(), np.cumsum([0, *sizes]), sources.codes(lists.flatten()), batch.column(4).flatten().to_numpy())


def merged(least: int):
    """Leaves in order of language and term, as one range of prefixes holds them, to merged ones with terms in at least so many documents."""

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, sources = Names(), Names()
        held: list[Trie] = []
        size = 0
        for batch in batches:
            held.append(read_trie(batch, langs, sources))
            size += len(held[-1].count)
            if size > MOST:
                one = Trie.merged(held)
                last = np.zeros(len(one.docs), bool)  # more of the last term may come
                last[np.flatnonzero((one.lang == held[-1].lang[-1]) & pc.equal(one.term, held[-1].term[-1]).to_numpy(zero_copy_only=False))] = True
                yield from one.only(~last & kept(one, least)).batches(langs, sources)
                held = [one.only(last)]
                size = len(held[0].count)
        if held:
            one = Trie.merged(held) if len(held) > 1 else Trie.merged([*held, held[0].only(np.zeros(len(held[0].docs), bool))])
            yield from one.only(kept(one, least)).batches(langs, sources)

    return merge


def kept(trie: Trie, least: int) -> np.ndarray:
    """Leaves in enough documents, and those that stand for languages."""
    return (trie.docs >= least) | pc.equal(trie.term, "").to_numpy(zero_copy_only=False)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total), exact also where the product leaves 64 bits."""
    if int(count.max(initial=0)) < ((1 << 63) - 1) // UNIT - 2:
        return 1 + UNIT * (count + 2) // total
    return (1 + UNIT * (count.astype(object) + 2) // total.astype(object)).astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Range:
    """One language's terms in one range of prefixes, as they come in UTF-8 order: sums of pairs, and each source's best terms."""

    def __init__(self, lang: str, top: int):
        self.lang, self.top, self.total, self.terms = lang, top, {}, 0
        self.held: list[tuple[str, list[str], list[int]]] = []
        self.names: list[str] | None = None

    def head(self, source: str, n: int, v: int) -> None:
        self.total[source], self.terms = n, v

    def begin(self) -> None:
        self.names = sorted(self.total)
        self.index = {s: i for i, s in enumerate(self.names)}
        n = [self.total[s] for s in self.names]
        self.each = np.array([x + 2 * self.terms for x in n], np.int64)
        self.whole = np.array([sum(n) + 2 * self.terms], np.int64)
        self.sums = np.zeros((len(n), len(n)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in n]

    def take(self, term: str, sources: list[str], counts: list[int]) -> None:
        if self.names is None:
            self.begin()
        self.held.append((term, sources, counts))
        if len(self.held) * len(self.names) >= CELLS:
            self.compare()

    def compare(self) -> None:
        count = np.zeros((len(self.held), len(self.names)), np.int64)
        for row, (_, sources, counts) in enumerate(self.held):
            count[row, [self.index[s] for s in sources]] = counts
        p = shares(count, self.each)
        for i in range(len(self.names) - 1):
            self.sums[i, i + 1 :] += apart(p[:, i : i + 1], p[:, i + 1 :]).sum(0)
        q = shares(count.sum(1), self.whole)[:, None]
        value = apart(p, q)
        over = (count > 0) & (p > q)
        for i in range(len(self.names)):
            rows = np.flatnonzero(over[:, i])
            rows = rows[np.argsort(-value[rows, i], kind="stable")[: self.top]]
            found = self.best[i] + [(int(value[r, i]), self.held[r][0]) for r in rows]
            self.best[i] = sorted(found, key=lambda x: -x[0])[: self.top]  # stable: of equal values the earlier term
        self.held = []

    def rows(self) -> Iterator[tuple]:
        if self.names is None:
            self.begin()
        if self.held:
            self.compare()
        for i, a in enumerate(self.names):
            for j, b in enumerate(self.names):
                if i != j:
                    yield self.lang, a, "pair", b, int(self.sums[min(i, j), max(i, j)])
            for value, term in self.best[i]:
                yield self.lang, a, "term", term, value


FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def compared(top: int):
    """Sorted rows range, lang, v (of heads), term, sources, counts to sums of pairs and candidate terms of each range and language."""

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        rows: list[tuple] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if len(rows) >= least:
                yield batch_of(rows, FOUND)
                rows = []

        for batch in batches:
            for where, lang, v, term, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (where, lang) != key:
                    for r in now.rows() if now else ():
                        rows.append(r)
                        yield from flush(20_000)
                    now, key = Range(lang, top), (where, lang)
                if v is None:
                    now.take(term, sources, counts)
                else:
                    now.head(sources[0], counts[0], v)
        for r in now.rows() if now else ():
            rows.append(r)
            yield from flush(20_000)
        yield from flush(1)

    return compare


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each (lang, source) group is from the language's other sources, and by which terms.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps those in at least `least_docs` of its documents
    (V of them). A group's share of a term is p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), N its count of kept terms; f(p, q) =
    floor((p - q)^2 / (p + q)). Part `pair`: for each other source of the language, f summed over all kept terms. Part `term`: the `top`
    terms that occur in the group, by f against the language's own share, where the group's is larger. Ranks from 1, value descending,
    item by UTF-8 ascending. All integers are exact.

    Tasks count in radix tries of a bounded number of counters, held in linear form; their leaves are dealt by ranges of (lang, term), merged, and walked in order:
    pairs are summed in each range and added up, a range offers `top` terms for each group. The tries' leaves, before and after the
    merge, are tables in the shared folder; the merged ones stay for the lazy result. A worker holds the square of a language's number
    of sources in sums, which is what the result has of rows.

    Null texts, languages and sources are empty ones; a group without terms has its pairs, of value 0 where V is 0; repeated rows
    count as documents of their own; an empty table gives an empty table; other columns of df are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).alias("text"))
    counts = tables.write(docs.mapInArrow(counted, LEAF_DDL), "counts")
    dealt = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = tables.write(dealt.mapInArrow(merged(least_docs), LEAF_DDL).withColumn("range", F.spark_partition_id()).drop("docs"), "kept")
    tables.remove("counts")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    terms = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"))
    heads = totals.join(terms, "lang").join(kept.select("range", "lang").distinct(), "lang")
    heads = heads.select("range", "lang", "v", F.lit("").alias("term"), F.array("source").alias("sources"), F.array("n").alias("counts"))
    rows = kept.filter("term <> ''").select("range", "lang", F.lit(None).cast("long").alias("v"), "term", "sources", "counts").unionByName(heads)
    rows = rows.repartition("range").sortWithinPartitions("range", "lang", "term")  # heads first: their term is empty
    found = rows.mapInArrow(compared(top), "lang string, source string, part string, item string, value long")
    return ranked(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), top)


def ranked(found: DataFrame, top: int) -> DataFrame:
    by: list[Column] = [F.desc("value"), F.asc("item")]
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*by)))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= top))
