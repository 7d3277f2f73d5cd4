"""Each stage against a brute-force version on its own input, and the queries against their SQL."""

import json
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from trajloom.llm import queries
from trajloom.llm.quality import Rules, judged

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], docs.columns, after.columns))
        docs = after
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert all(a == b for _, _, a, b in stages[:-1])


def test_quality_stage(stages):
    before, after, _, _ = stages[0]
    want = {r["doc_id"]: j[-1] for r in before if (j := judged(r["text"] or "", Rules()))[6]}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_line_dedup_stage(stages):
    before, after, _, _ = stages[1]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in before:
        for line in r["text"].split("\n"):
            holders[key(line)].add(r["doc_id"])
    drop = lambda k, d: len(k) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != d
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not drop(key(x), r["doc_id"])) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want


def test_near_duplicate_stage(stages):
    from test_jaccard import brute

    before, after, _, _ = stages[2]
    want = {k for k, _, c in brute([(r["doc_id"], r["text"]) for r in before]) if k == c}
    assert {r["doc_id"] for r in after} == want


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, shared ids and null ids."""
    a, b = [" ".join(f"{p}{i}" for i in range(60)) for p in "ab"]
    near = lambda k: f"{a} z{k}"
    rows = [(3, near(0)), (7, near(1)), (7, "a text that is alone, with the key of another one"), (9, b), (9, b), (9, b)]
    rows += [(None, " ".join(f"n{i}" for i in range(80)) + f" end{k}") for k in range(20)] + [(None, "a lonely text without a key of its own"), (None, near(2))]
    rows += [(11, "x y"), (12, "x y"), (13, ""), (14, None)]
    docs = spark.createDataFrame([(k, t, "s", i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs.repartition(3), DATA).collect()
    nulls = [r["text"] for r in got if r["doc_id"] is None]
    assert sorted((r["doc_id"], r["text"] or "") for r in got if r["doc_id"] is not None) == [(3, near(0)), (7, rows[2][1]), (9, b), (11, "x y"), (13, ""), (14, "")]
    assert len(nulls) == 2 and rows[26][1] in nulls and any(x.startswith("n0 ") for x in nulls)
    assert [r["n_chars"] for r in got if r["doc_id"] == 9] == [3]


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_take_odd_rows_and_names(spark, stage):
    """Null, empty, very long and repeated texts, null keys and sources, and columns whose names the operators use too."""
    prose = " ".join(f"word{i * 31 % 997}" for i in range(70)) + "."
    rows = [(None, None, None), (None, "", None), (1, prose, "a"), (1, prose, "a"), (2, "long " * 40_000 + ".", None), (3, prose.upper(), "a"), (3, "other " + prose, None)]
    names = "quality long, n_lines long, n_dropped long, component long, copies long, size long, word long, keep long, h1 long, real boolean"
    docs = spark.createDataFrame([(*r, *range(9), True) for r in rows], f"doc_id long, text string, source string, {names}")
    out = stage(spark, docs, DATA)
    got = out.collect()
    if stage is not pipeline.best_fit_packing:
        assert out.columns == docs.columns and all(r["n_lines"] == 1 and r["size"] == 5 and r["quality"] == 0 for r in got)
    else:
        assert sum(r["start"] == 0 for r in got) == len(rows)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_mixing_stage(stages):
    from test_native import water

    before, after, _, _ = stages[3]
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    sizes, taken, largest, times = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    assert all(abs(taken[s] - t) <= largest[s] + 2 for s, t in water(sizes).items())


def test_packing_stage(stages):
    from trajloom.llm.packing import Encoder, cuts
    from trajloom.llm.tokens import tokenizer_path

    before, after, _, _ = stages[4]
    encoder, want = Encoder(tokenizer_path("byte_bpe_50k.json")), []
    for r in before:
        want += [(r["doc_id"], i, s, n) for i, (s, n) in enumerate(cuts(len(encoder.ids(r["text"])) + 1, 1024))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in after) == sorted(want)
    bins = defaultdict(list)
    for r in after:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024


def test_run_is_the_stages_in_turn(spark, stages):
    got = pipeline.run(spark, DATA)
    assert sorted(json.dumps(r.asDict(), sort_keys=True) for r in got.drop("sequence_id", "offset").collect()) == sorted(json.dumps({k: v for k, v in r.items() if k not in ("sequence_id", "offset")}, sort_keys=True) for r in stages[4][1])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_have_the_rows_of_their_sql(spark, name):
    assert oracle.differences(spark, DATA, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_every_operator_has_one_query():
    import re

    numbers = [re.match(r"op(\d+)_", n)[1] for n in queries.queries()]
    assert sorted(map(int, numbers)) == list(range(1, 11))


def test_shards_of_the_query(spark):
    q = queries.queries()["op5_sharding"](spark, DATA)
    counts = [r["n"] for r in q.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 40 and max(counts) - min(counts) <= 1
