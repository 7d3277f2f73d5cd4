"""Chains of sessions without branches are found by a window, those of all others by doubling; both are what doubling alone gives."""

import random

from pyspark.sql import functions as F

from trajloom.functions import shared
from trajloom.operators import convert_session as C

NODES = "session string, uuid string, parent string, lineno int"


def sessions():
    """Chains, gaps, missing and later parents, branches, cycles and leaves that are no node."""
    random.seed(7)
    nodes, leaf = [], []
    for s in range(60):
        n = random.randint(1, 9)
        for i in range(n):
            up = i - 1 if s < 20 else random.choice([i - 1, i - 1, i - 1, random.randrange(n), None])
            parent = None if up is None or up < 0 else "gone" if random.random() < 0.15 else f"m{up}"
            nodes.append((f"s{s}", f"m{i}", parent, 2 * i + 1))
        leaf.append((f"s{s}", random.choice(["m0", f"m{n - 1}", f"m{n - 1}", f"m{random.randrange(n)}", "none"])))
    return nodes, leaf


def test_runs_are_chains(spark, monkeypatch):
    """Every session went through all rounds of doubling."""
    shared.ensure_checkpoint_dir(spark)
    nodes, leaf = sessions()
    nodes, leaf = spark.createDataFrame(nodes, NODES), spark.createDataFrame(leaf, "session string, leaf string")
    whole = sorted(map(tuple, C.chains(nodes, leaf).select("session", "uuid", "depth").collect()))
    walked, chains = [], C.chains
    monkeypatch.setattr(C, "chains", lambda n, x: walked.extend(r.session for r in n.select("session").distinct().collect()) or chains(n, x))
    assert sorted(map(tuple, C._chained(nodes, leaf).select("session", "uuid", "depth").collect())) == whole
    assert walked and not {f"s{s}" for s in range(20)} & set(walked)


def test_a_line_of_records_takes_no_rounds(spark, monkeypatch):
    shared.ensure_checkpoint_dir(spark)
    rec = F.concat(F.lit('{"type":"user","uuid":"m'), F.col("id"), F.lit('","parentUuid":'), F.when(F.col("id") % 20 > 0, F.concat(F.lit('"m'), F.col("id") - 1, F.lit('"'))).otherwise("null"), F.lit(',"message":{"role":"user","content":"x"}}'))
    records = spark.range(60).select(F.concat(F.lit("s"), F.floor(F.col("id") / 20)).alias("session"), (F.col("id") % 20 + 1).cast("int").alias("lineno"), F.parse_json(rec).alias("rec"))
    walked, chains = [], C.chains
    monkeypatch.setattr(C, "chains", lambda n, x: walked.append(n.count()) or chains(n, x))
    assert C.linear(records).filter("pos = lineno").count() == 60
    assert walked == [0]
