"""Gates: results are written to a staging folder in one pass, checked, and take their place only if all gates hold."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rules
from ..sources import folders
from .audit import forbidden_hits, length_summary, repeats
from .render import CONDITIONS


@dataclass(frozen=True)
class RowGate:
    """A row breaks it where `broken` is true; detail says how. stops: whether one such row keeps the results back, or is only counted and listed."""

    name: str
    broken: Column
    detail: Column = field(default_factory=lambda: F.lit(""))
    stops: bool = True


@dataclass(frozen=True)
class TableGate:
    """find(rows) gives key and detail (strings) of each violation among all rows that aren't rejected."""

    name: str
    find: Callable[[DataFrame], DataFrame]
    stops: bool = True


@dataclass
class Outcome:
    """promoted: whether the rows are now at `path`; else they are at `staged`. rows, rejected and each gate's violations are counted.

    violations: gate, key, detail of all of them, rejected rows' errors too under the gate `error`; it reads where the rows are.
    """

    promoted: bool
    path: str
    counts: dict[str, int]
    violations: DataFrame


def rows_at(df: DataFrame, path: str) -> DataFrame:
    """Rows that publish() has written: those that weren't rejected, without its own columns."""
    return df.sparkSession.read.parquet(path).filter("not rejected").drop("rejected", "broken")


def publish(df: DataFrame, path: str, key: str, gates: Sequence[RowGate | TableGate], error: str | None = None, errors_stop: bool = False) -> Outcome:
    """Write df as Parquet to `path` if the gates hold: all rows once, good and rejected ones side by side, metrics counted on the way.

    key: the column that names a row in the list of violations. error: a column that is null for good rows; others are rejected, which
    means written to the partition rejected=true with what is wrong, left out by the gates over the whole table and, with errors_stop,
    enough to keep the results back. Rows' gates are counted by an observation while the rows are written, and their names kept with
    the row, so the violations can be listed without computing anything anew; gates over the table read what is staged. What was at `path` before
    stays until all gates hold, and is then replaced by a rename; otherwise what was staged stays beside it (<path>__staged-...) to be looked at.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    of_rows = [g for g in gates if isinstance(g, RowGate)]
    bad = F.col(error).isNotNull() if error else F.lit(False)
    hits = F.array_compact(F.array(*(F.when(~bad & F.coalesce(g.broken, F.lit(False)), F.struct(F.lit(g.name).alias("gate"), g.detail.cast("string").alias("detail"))) for g in of_rows)))
    none = F.array().cast("array<struct<gate:string,detail:string>>")
    rows = df.withColumn("broken", hits if of_rows else none).withColumn("rejected", bad)
    seen = Observation()
    has = lambda g: F.count_if(F.exists("broken", lambda x: x["gate"] == g.name))
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if("rejected").alias("rejected"), *(has(g).alias(f"gate {g.name}") for g in of_rows)]
    rows.observe(seen, *metrics).write.partitionBy("rejected").parquet(staged)
    counted = {k: int(v) for k, v in seen.get.items()}
    counts = {"rows": counted["rows"], "rejected": counted["rejected"]} | {g.name: counted[f"gate {g.name}"] for g in of_rows}

    def listed(where: str, some: Sequence[RowGate | TableGate]) -> DataFrame:
        back = spark.read.schema(rows.schema).parquet(where)
        named = F.col(key).cast("string").alias("key")
        found = [back.filter(F.size("broken") > 0).select(F.inline("broken"), named).select("gate", "key", "detail")]
        if error:
            found.append(back.filter("rejected").select(F.lit("error").alias("gate"), named, F.col(error).cast("string").alias("detail")))
        good = back.filter("not rejected").drop("rejected", "broken")
        found += [g.find(good).select(F.lit(g.name).alias("gate"), F.col("key").cast("string").alias("key"), F.col("detail").cast("string").alias("detail")) for g in some if isinstance(g, TableGate)]
        return reduce(DataFrame.unionByName, found)

    tables = [g for g in gates if isinstance(g, TableGate)]
    if tables:
        n = listed(staged, tables).filter(F.col("gate").isin(*(g.name for g in tables))).groupBy("gate").count().collect()  # a row for each gate
        counts |= {g.name: 0 for g in tables} | {r["gate"]: r["count"] for r in n}
    stopped = any(counts[g.name] for g in gates if g.stops) or (errors_stop and counts["rejected"] > 0)
    if stopped:
        return Outcome(False, staged, counts, listed(staged, gates))
    folders.swap(spark, staged, path)
    return Outcome(True, path, counts, listed(path, gates))


# ---- prompts


def prompt_path(root: str = "") -> Column:
    from ..functions import text

    own = F.concat_ws("/", text.safe_path_part(F.col("target_instance_id")), text.safe_path_part(F.col("condition")), F.lit("prompt.txt"))
    return F.concat(F.lit(root), own)


def prompt_gates(max_chars: int = 0, fail_on_forbidden: bool = True, conditions: Sequence[str] = CONDITIONS) -> list[RowGate | TableGate]:
    """What rendered prompts must be: all conditions of each target and no other, one issue text in them, paths of their own, not too long, nothing forbidden."""
    want = F.array(*map(F.lit, sorted(conditions)))
    by_target = lambda df, c: df.groupBy(F.col("target_instance_id").alias("key")).agg(F.array_sort(F.collect_set(c)).alias("x"))  # noqa: E731  a target has a few
    detail = F.array_join("x", ",").alias("detail")
    hits = lambda df: forbidden_hits(df, "run_id", "prompt", rules.PROMPT_FORBIDDEN)
    said = F.concat("pattern", F.lit("\tline="), F.col("line").cast("string"), F.lit("\t"), "excerpt")
    gates: list[RowGate | TableGate] = [
        TableGate("bad_condition_sets", lambda df: by_target(df, "condition").filter(F.col("x") != want).select("key", detail)),
        TableGate("inconsistent_target_issue_hashes", lambda df: by_target(df, "target_problem_statement_sha256").filter(F.size("x") != 1).select("key", detail)),
        TableGate("duplicate_prompt_paths", lambda df: repeats(df.withColumn("path", prompt_path()), "path", order=["run_id"]).select(F.col("path").alias("key"), F.col("run_id").alias("detail"))),
        TableGate("forbidden", lambda df: hits(df).select(F.col("run_id").alias("key"), said.alias("detail")), stops=fail_on_forbidden),
    ]
    if max_chars > 0:
        gates.append(RowGate("too_long", F.char_length("prompt") > max_chars, F.char_length("prompt").cast("string")))
    return gates


def publish_prompts(prompts: DataFrame, path: str, max_chars: int = 0, fail_on_forbidden: bool = True) -> Outcome:
    return publish(prompts, path, "run_id", prompt_gates(max_chars, fail_on_forbidden))


def prompt_report(outcome: Outcome, prompts: DataFrame) -> dict:
    """The report of a run of prompts: counts, violations by gate (at most 50 too long ones), lengths by condition with two decimals.

    It collects a row for each condition and one for each violation, of which a good run has none.
    """
    by = {r["condition"]: r for r in length_summary(prompts.withColumn("n", F.char_length("prompt")), "n", "condition").collect()}
    prior = {r["condition"]: r for r in length_summary(prompts, "prior_context_chars", "condition").collect()}
    shown = lambda r: {"count": r["count"], "min": r["min"], "max": r["max"], "mean": round(float(r["mean"]), 2), "median": round(float(r["median"]), 2)}
    found: dict[str, list] = {}
    for r in outcome.violations.orderBy("gate", "key", "detail").collect():
        found.setdefault(r["gate"], []).append([r["key"], r["detail"]])
    return {
        "prompt_count": outcome.counts["rows"],
        "unique_targets": prompts.select("target_instance_id").distinct().count(),
        "condition_counts": {c: by[c]["count"] for c in sorted(by)},
        "bad_condition_sets": {k: d.split(",") for k, d in found.get("bad_condition_sets", [])},
        "inconsistent_target_issue_hashes": {k: d.split(",") for k, d in found.get("inconsistent_target_issue_hashes", [])},
        "duplicate_prompt_paths": [k for k, _ in found.get("duplicate_prompt_paths", [])],
        "forbidden_hit_count": outcome.counts.get("forbidden", 0),
        "too_long_count": outcome.counts.get("too_long", 0),
        "too_long": [{"run_id": k, "prompt_chars": int(d)} for k, d in found.get("too_long", [])[:50]],
        "prompt_length_by_condition": {c: shown(by[c]) for c in sorted(by)},
        "prior_context_length_by_condition": {c: shown(prior[c]) for c in sorted(prior)},
        "promoted": outcome.promoted,
    }
