"""Divergence of sources against a plain count in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from trajloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """rows: lang, source, text."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: [1 + 10**9 * (counts[lang, s][t] + 2) // (n[s] + 2 * len(kept)) for t in kept] for s in sources}
        q = [1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(a, b), t.encode(), t) for a, b, t in zip(p[s], q, kept, strict=True) if counts[lang, s][t] > 0 and a > b)[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    return sorted(out)


def found(spark, rows, least, top, parts=3):
    df = spark.createDataFrame([(a, b, c, 1, "r") for a, b, c in rows], "lang string, source string, text string, value int, range string").repartition(parts)
    return sorted(map(tuple, D.divergence(df, least_docs=least, top=top).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_as_a_plain_count(spark):
    rng = random.Random(11)
    words = ["the", "The", "é", "É", "ÀB", "x1y", "a", "ab", "abc", "b", "ß", "日本", "\U0001f600", "zz", "K", "ſ"]
    text = lambda: rng.choice(["", " ", ", ", "\x00", "-"]).join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 12))) if rng.random() < 0.8 else " ".join(rng.choices(words, k=30))
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), text()) for _ in range(300)]
    rows += [("en", "s1", "the the")] * 50 + [("de", "only", None), ("de", "other", "")] + [("es", "one", "abc " * 400)] + [("en", "s3", "the abc " * 30_000)]
    assert found(spark, rows, 4, 3) == plain(rows, 4, 3)
    assert found(spark, rows[:40], 1, 100, 5) == plain(rows[:40], 1, 100)
    assert found(spark, [], 1, 1) == []


def test_small_tries_and_many_chunks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("l", f"s{rng.randint(0, 6)}", " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(20))) for _ in range(200)]
    batch = lambda r: pa.RecordBatch.from_pydict({"lang": [x[0] for x in r], "source": [x[1] for x in r], "text": [x[2] for x in r]})
    monkeypatch.setattr(D, "MOST", 20)
    monkeypatch.setattr(D, "CELLS", 16)
    leaves = pa.Table.from_batches(D.counted(iter([batch(rows[i : i + 7]) for i in range(0, 200, 7)])), D.LEAF).sort_by([("lang", "ascending"), ("term", "ascending")])
    merged = pa.Table.from_batches(D.merged(15)(iter(leaves.to_batches(max_chunksize=3))), D.LEAF)
    want = Counter(t for r in rows for t in set(r[2].split()))
    assert {r["term"]: r["docs"] for r in merged.to_pylist() if r["term"]} == {t: n for t, n in want.items() if n >= 15}
    total = Counter((t, r[1]) for r in rows for t in r[2].split())
    assert {(r["term"], s): c for r in merged.to_pylist() if r["term"] for s, c in zip(r["sources"], r["counts"], strict=True)} == {k: n for k, n in total.items() if want[k[0]] >= 15}
    assert [r["docs"] for r in merged.to_pylist() if r["term"] == ""] == [200]
    whole = D.Range("l", 4)
    totals = Counter(k[1] for k, n in total.items() for _ in range(n) if want[k[0]] >= 15)
    for s in sorted({r[1] for r in rows}):
        whole.head(s, totals[s], len([t for t in want if want[t] >= 15]))
    for r in sorted(merged.to_pylist(), key=lambda r: r["term"].encode()):
        if r["term"]:
            whole.take(r["term"], r["sources"], r["counts"])
    expected = [x for x in plain(rows, 15, 4)]
    assert sorted((a, s, p, i, v) for a, s, p, i, v in whole.rows()) == [x[:5] for x in expected]


def test_linear_tries():
    trie = D.Trie.of(np.array([0, 0, 0, 1, 0]), pa.array(["to", "tea", "té", "tea", "tea"]), np.array([1, 1, 1, 1, 2]), np.array([0, 1, 2, 3, 4]), np.array([0, 1, 0, 0, 1]), np.array([5, 6, 7, 8, 9]))
    assert trie.term.to_pylist() == ["tea", "to", "té", "tea"] and trie.lang.tolist() == [0, 0, 0, 1] and trie.docs.tolist() == [3, 1, 1, 1]
    assert trie.count.tolist() == [15, 5, 7, 8] and trie.shared().tolist() == [0, 1, 1, 0]
    assert D.Trie.merged([trie, trie]).count.tolist() == [30, 10, 14, 16]


def test_shares_beyond_64_bits():
    count, total = np.array([10**13, 3, 0]), np.array([10**14])
    assert D.shares(count, total).tolist() == [1 + 10**9 * (c + 2) // 10**14 for c in (10**13, 3, 0)]
