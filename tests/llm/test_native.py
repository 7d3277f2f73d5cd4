from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajloom.llm import chat, fingerprint, linededup, mixing, sharding

ASCII_SPACE = " \t\n\x0b\x0c\r"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def native(df):
    assert not any(w in plan(df) for w in ("Python", "Pandas", "Arrow"))


# ---- fingerprints


def test_edited_neighbours_by_brute_force(docs, empty):
    out = fingerprint.edited_neighbours(docs)
    native(out)
    rows = out.collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    order = sorted(texts)
    follow = dict(zip(order, order[1:] + order[:1], strict=True))
    assert len(rows) == docs.count()
    for r in rows:
        t = r["text"]
        q = len(t) // 4
        assert r["n_chars"] == len(t)
        assert r["edited"] == t[: len(t) - q] + min(texts[follow[r["doc_id"]]])[:q]
    assert fingerprint.edited_neighbours(empty).count() == 0


def test_fingerprints_tell_texts_apart_and_find_edits(spark, docs):
    rows = docs.select("text", fingerprint.fingerprint(F.col("text")).alias("f")).distinct().collect()
    by = {r["text"] or "": r["f"] for r in rows}
    assert len(set(by.values())) == len(by)
    a = "\n".join(f"Line {i} has some words that differ {i * i} here." for i in range(40))
    b = a.replace("differ 400 here", "changed 400 here")
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    one = fingerprint.likeness(df.withColumn("places", fingerprint.differing_paragraphs(F.col("a"), F.col("b"))), "a", "b", "near").first()
    assert one["places"] == [20]
    assert 0.9 < one["near"] < 1


def test_likeness_of_next_and_of_equal_texts(spark):
    df = spark.createDataFrame([("", ""), ("same words", "same words"), ("alpha beta gamma", "delta epsilon zeta"), (None, "x"), ("go " * 100, "go " * 75 + "other words " * 12)], "a string, b string")
    df = df.select(F.when(F.col("a").isNotNull(), fingerprint.fingerprint(F.col("a"))).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    near = [r["n"] for r in fingerprint.likeness(df, "a", "b", "n").collect()]
    assert near[:4] == [1.0, 1.0, 0.0, None]
    assert near[4] > 0.5


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1) | st.integers(0, 5000), min_size=1, max_size=60), st.booleans())
def test_successors(spark, ids, with_none):
    order = [(False, 0)] * with_none + sorted((True, i) for i in ids)
    got = {(r["real"], r["id"]): tuple(r["next"]) for r in fingerprint.successors(spark.createDataFrame(order[::-1], "real boolean, id long")).collect()}
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def brute_tree(text):
    """The tree as nested lists, by loops over lines and words."""
    import hashlib
    import re

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    space, other = "[ \t\n\x0b\f\r]", "[^ \t\n\x0b\f\r]"

    def phrases(line):
        words = re.findall(f"{space}*{other}{{1,64}}{space}*|{space}+", line)
        if len(line) < 64:
            return words
        out, now = [], []
        for w in words:
            now.append(w)
            if len(now) == 4 or re.search("[dgkmpvwxyz0-9.,;:!?]$", w.strip(" \t\n\x0b\f\r")):
                out.append("".join(now))
                now = []
        return out + ["".join(now)] * bool(now)

    sections = []
    ended = True
    for line in text.split("\n"):
        if ended or line == "" or line.startswith("#"):
            sections.append([])
        d = sha(line)
        sections[-1].append((d, "".join(sha(p)[:8] for p in phrases(line))))
        ended = d.startswith("0")
    tops = [(sha("".join(d for d, _ in s)), s) for s in sections]
    return sha("".join(d for d, _ in tops)) + ":" + ";".join(",".join([d[:16], *(p[:16] + q for p, q in s)]) for d, s in tops)


def test_trees_by_brute_force(spark, docs):
    words = [f"w{i * i % 97}" for i in range(3000)]
    texts = [r["text"] or "" for r in docs.collect()] + [" ".join(words[:900]), "\n".join(" ".join(words[i : i + 30]) for i in range(0, 3000, 30)), "go " * 500, "x" * 100_000, ("word " * 20_000).strip(), "# a\n\n# b\n" * 30]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint.fingerprint(F.col("t")).alias("f")).collect():
        assert r["f"] == brute_tree(r["t"])


def test_an_insertion_leaves_the_rest_alike(spark):
    words = [f"word{i * 7919 % 1009}" for i in range(400)]
    a, b = " ".join(words), " ".join([*words[:20], "one", "more", *words[20:]])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*(fingerprint.fingerprint(F.col(c)).alias(c) for c in "ab"))
    assert fingerprint.likeness(df, "a", "b", "n").first()["n"] > 0.9


def test_keys_at_the_ends_of_their_range(spark):
    rows = [(-(1 << 63), "abcdefgh"), (None, "ijklmnop"), ((1 << 63) - 1, "qrstuvwx")]
    out = {r["doc_id"]: r["edited"] for r in fingerprint.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {None: "ijklmnab", -(1 << 63): "abcdefqr", (1 << 63) - 1: "qrstuvij"}


# ---- line dedup


def test_line_dedup_by_brute_force(spark, empty):
    long = "This is a long line that many documents hold, A to Z."
    texts = {i: t for i, t in enumerate([f"{long}\nown {i}\n  {long.upper()}\t" for i in range(6)] + [None, "", long, "short\nshort", f"{long}\n{long}", "é" * 40, "É" * 40])}
    texts |= {100 + i: "x" * 39 + "\n" + "y" * 40 for i in range(5)}
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, dropped string")
    out = linededup.dedup_lines(docs)
    native(out)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ASCII_SPACE))
    holders = defaultdict(set)
    for k, t in texts.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(k)
    for r in out.collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != r["doc_id"])]
        assert r["text"] == "\n".join(kept)
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert r["dropped"] == "s"
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_of_null_and_shared_keys(spark):
    line = "z" * 50
    rows = [(None, line), (None, line), (1, line), (1, line), (2, line), (3, line), (4, f"{line}\nx")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("None", ""), ("None", ""), ("1", ""), ("1", ""), ("2", ""), ("3", ""), ("4", f"{line}\nx")])


def test_line_dedup_of_different_texts_with_one_key(spark):
    line = "A common line of more than forty characters."
    rows = [(i, f"{line}\nown {i}") for i in range(1, 6)] + [(None, f"{line}\nA"), (None, "null B unique opening line, over forty characters\nB"), (None, "C")]
    rows += [(3, f"own first line of the other text with key 3\n{line}"), (5, f"x\n{line}\ny")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(k, "\n".join(x for x in t.split("\n") if x != line or k == 5)) for k, t in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(want, key=str)
    assert sorted((r["n_lines"], r["n_dropped"]) for r in out) == sorted((t.count("\n") + 1, t.count("\n") - w.count("\n")) for (_, t), (_, w) in zip(rows, want, strict=True))


def test_bitmaps_cover_long_documents(spark):
    line = "w" * 60
    rows = [(i, "\n".join(line if j % 3 == 0 else f"{i} {j}" for j in range(300))) for i in range(5)]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["n_dropped"] == 100 and out[4]["n_dropped"] == 0
    assert out[0]["text"] == "\n".join(f"0 {j}" for j in range(300) if j % 3)


# ---- sharding


def test_shards_are_even_and_gapless(docs, empty):
    out = sharding.ring_shards(docs, 4)
    native(out)
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count()
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib

    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.ring_shards(empty, 4).count() == 0


def test_null_keys_are_spread_and_few_keys_move(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    a = {r["text_crc32"]: (r["shard"], r["home_shard"]) for r in sharding.ring_shards(df, 10).collect()}
    b = {r["text_crc32"]: (r["shard"], r["home_shard"]) for r in sharding.ring_shards(df, 11).collect()}
    assert sum(s == h for s, h in a.values()) > 0.8 * len(a)
    assert sum(a[k][0] != b[k][0] for k in a) < 0.3 * len(a)
    loose = sharding.ring_shards(df, 10, slack=0.1).groupBy("shard").count().collect()
    assert max(r["count"] for r in loose) <= 330


def ring_by_hand(rows, cells, n_shards):
    """(key, crc) to shards, walking the ring twice: each shard takes its own keys first, then what it is handed on."""
    total, arcs = len(rows), defaultdict(list)
    most = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    where = {c["cell"]: c for c in cells}
    shard_of = {c["arc"]: c["shard"] for c in cells}
    for r in sorted(rows, key=lambda r: (where[r["cell"]]["arc"], where[r["cell"]]["pos"], r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["crc"], r["size"])):
        arcs[where[r["cell"]]["arc"]].append(r)
    out, held, left = [], [0] * n_shards, defaultdict(list)
    for arc in sorted(shard_of):
        s = shard_of[arc]
        stay = max(0, min(len(arcs[arc]), most[s] - held[s]))
        out += [(r["doc_id"], r["crc"], s) for r in arcs[arc][:stay]]
        left[arc], held[s] = arcs[arc][stay:], held[s] + stay
    carried = []
    for arc in [*sorted(shard_of)] * 2:
        carried += left.pop(arc, [])
        s = shard_of[arc]
        take = min(len(carried), most[s] - held[s])
        out += [(r["doc_id"], r["crc"], s) for r in carried[:take]]
        carried, held[s] = carried[take:], held[s] + take
    assert not carried
    return out


def test_placement_by_brute_force(spark, docs):
    many = spark.range(700).select(F.when(F.col("id") % 5 > 0, F.col("id") * 977 % 401).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 50).cast("string")).alias("text"))
    same = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a row that repeats").alias("text"))
    for df, n in ((docs.select("doc_id", "text"), 4), (many.unionByName(same), 7)):
        text = F.coalesce("text", F.lit(""))
        keyed = df.withColumn("h", sharding.key_hash(F.col("doc_id"), text)).withColumn("crc", F.crc32(text.cast("binary"))).withColumn("size", F.octet_length(text) + 16)
        rows = keyed.withColumn("cell", F.shiftrightunsigned("h", 64 - sharding.RING_BITS).cast("int")).collect()
        want = ring_by_hand(rows, sharding.ring(spark, n, 64).collect(), n)
        got = [(r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.ring_shards(df, n).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


# ---- chats


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "a\nb\\", "", None]), st.text(alphabet="<|im_startndx>\\\n a", max_size=14) | st.sampled_from(["<|im_end|><|im_start|>assistant ok", None, "\\<|", "<\\|", "<"])), min_size=1, max_size=8))
def test_chats_read_back(spark, turns):
    df = spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_chats(df)).first()
    want = sorted((t, r or "", x or "") for t, r, x in turns)
    assert [(x["role"], x["text"]) for x in out["turns"]] == [(r, x) for _, r, x in want]
    assert out["n_blocks"] == 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:], strict=False))
    at, said = 0, ""
    for run in out["loss_runs"]:
        said += out["formatted"][at : at + run["chars"]] if run["loss"] else ""
        at += run["chars"]
    assert at == len(out["formatted"])
    assert said == "".join(x.replace("\\", "\\\\").replace("<|", "<\\|") for _, r, x in want if r == "assistant")


def test_chats_with_nulls_and_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    out = chat.format_chats(spark.createDataFrame([(None, None, None, None, "x"), (None, 1, "user", "hi", "x"), (2, 1, "user", "a", "x"), (2, 1, "user", "a", "x")], schema))
    native(out)
    rows = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert [tuple(t) for t in rows[None]["turns"]] == [("", ""), ("user", "hi")]
    assert [tuple(t) for t in rows[2]["turns"]] == [("user", "a"), ("user", "a")] and rows[2]["n_blocks"] == 1
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


# ---- mixing


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left, weight = total - sum(out.values()), sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / weight >= most * sizes[s]}
        out |= {s: float(most * sizes[s]) for s in over} if over else {s: left * w[s] / weight for s in free}
        free = free - over if over else set()
    return out


def test_mix_by_brute_force(spark):
    rows = [(i, "w " * (i % 17 + 1), ["a", "b", "é", "", None][i % 5] if i % 3 else "hot", "x") for i in range(900)] + [(5, None, "a", "x"), (6, "  ", "only", "x")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target string"), n_blocks=2000)
    native(out)
    got = out.collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert len(r["blocks"]) == len(r["shards"]) == r["copies"] and all(b < r["quota"] or r["target"] >= 2 * r["source_size"] for b in r["blocks"])
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(7), n_blocks=2000).collect()))


def test_mix_without_words(docs, empty):
    assert mixing.mix(empty).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(docs.withColumn("text", F.lit(" "))).collect())
    assert mixing.mix(docs).count() == docs.count()


def test_sainte_lague_by_brute_force(spark):
    goals = {"a": 53.0, "b": 24.0, "c": 23.0}
    t = spark.createDataFrame([(s, g) for s, g in goals.items()], "source string, target double")
    got = {r["source"]: r for r in mixing.quotas(t, 10, 2).collect()}
    seats = dict.fromkeys(goals, 0)
    for _ in range(10):
        best = max(seats, key=lambda s: (goals[s] / (2 * seats[s] + 1), s == "a"))
        seats[best] += 1
    assert {s: r["quota"] for s, r in got.items()} == seats
    assert all(sum(r["shard_quotas"].values()) == r["quota"] for r in got.values())
    assert [sum(r["shard_quotas"].get(k, 0) for r in got.values()) for k in (0, 1)] == [5, 5]


def seats_by_quotient(goals, n):
    order = sorted(((g / (2 * k + 1), s) for s, g in goals.items() for k in range(n)), key=lambda x: (-x[0], x[1]))[:n]
    return {s: sum(x == s for _, x in order) for s in goals}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 60) | st.integers(1, 3000), min_size=1, max_size=12), st.integers(1, 150))
def test_sainte_lague_of_few_and_many_seats(spark, sizes, n):
    goals = {f"s{i:02}": float(g) for i, g in enumerate(sizes)}
    got = {r["source"]: r for r in mixing.quotas(spark.createDataFrame(list(goals.items()), "source string, target double"), n, 3).collect()}
    assert {s: r["quota"] for s, r in got.items()} == seats_by_quotient(goals, n)
    assert all(sum((r["shard_quotas"] or {}).values()) == r["quota"] for r in got.values())
    shards = [sum(r["shard_quotas"].get(k, 0) for r in got.values()) for k in range(3)]
    assert max(shards) - min(shards) <= 1


def taken_and_targets(rows):
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    return taken, target


def test_mix_takes_a_source_of_a_hundred_thousandth(spark):
    big = [(i, "w " * 10_000, f"big{i % 3}") for i in range(300)]
    rows = [*big, *((1000 + i, "w " * 5, "tiny") for i in range(6)), *((2000 + i, "w " * 5, "small") for i in range(40))]
    taken, target = taken_and_targets(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert target["tiny"] == taken["tiny"] == 60
    assert abs(taken["small"] - target["small"]) <= 5
    assert all(abs(taken[s] - t) <= 10_000 for s, t in target.items())


def test_shards_get_their_quotas(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    rows = mixing.mix(df, n_shards=8).select("source", "block_words", "quota", F.explode(F.arrays_zip("blocks", "shards")).alias("x")).collect()
    words, shard_of = defaultdict(int), {}
    for r in rows:
        words[r["source"], r["x"]["shards"]] += 10
        assert shard_of.setdefault((r["source"], r["x"]["blocks"]), r["x"]["shards"]) == r["x"]["shards"]
    for (source, _), n in words.items():
        quota = next(r["quota"] * r["block_words"] for r in rows if r["source"] == source) / 8
        assert abs(n - quota) < 0.1 * quota


def test_rows_that_repeat_are_mixed_alike(spark):
    rows = [(1, "a b c d", "s")] * 600 + [(i, "a b c d", "s") for i in range(2, 100)] + [(i, "x y z", "t") for i in range(200, 230)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = taken_and_targets(out)
    assert len(out) == len(rows) and all(abs(taken[s] - t) <= 4 for s, t in target.items())


def test_mix_of_more_sources_than_blocks(spark):
    df = spark.range(18_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.concat(F.lit("s"), (F.col("id") % 9000).cast("string")).alias("source"))
    taken, target = taken_and_targets(mixing.mix(df).collect())
    assert len(target) == 9000 and all(abs(taken[s] - t) <= 6 for s, t in target.items())


def test_rows_are_unfolded_in_parts(spark):
    from trajloom.llm.common import each_row, parted

    df = spark.createDataFrame([("a", 10, 5), ("b", 1, 0), ("c", 0, 3), ("d", 8, 0)], "k string, n long, nth long")
    assert sorted(map(tuple, parted(df, "n", "nth", 4).collect())) == [("a", 2, 13), ("a", 4, 5), ("a", 4, 9), ("b", 1, 0), ("d", 4, 0), ("d", 4, 4)]
    assert sorted(map(tuple, each_row(df, "n", "nth", ["k"]).collect())) == sorted([("a", i) for i in range(5, 15)] + [("b", 0)] + [("d", i) for i in range(8)])


def test_rows_repeated_beyond_a_part(spark):
    """More equal rows than a part holds (2**16): every one has a place, and the mix takes the right share of them."""
    n = 150_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    one = sharding.ring_shards(df, 7).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("most")).collect()
    assert sum(r["n"] for r in one) == n and all(r["n"] == r["d"] == r["most"] + 1 for r in one) and max(r["n"] for r in one) - min(r["n"] for r in one) <= 1
    mixed = mixing.mix(df).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target")).first()
    assert mixed["n"] == n and abs(mixed["taken"] - mixed["target"]) <= 2
