"""Pairs of a prior and a related task, runs by condition, plans and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shared, text
from .render import CONDITIONS

#: Columns a run row must have (fixed values).
RUN_FIELDS = ("run_id", "condition", "target_instance_id", "target_repo", "target_base_commit", "prompt_path", "sandbox_image", "output_dir")

#: Runs that count as done (fixed values).
SUCCESS = ("success", "success_empty_patch")


def need_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, but a key that comes twice fails the query and is named."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))).otherwise(F.col(key)))


def pairs(relationship: DataFrame, experience: DataFrame, related: DataFrame, index: DataFrame, one_per_target: bool = True) -> DataFrame:
    """experience_instance_id, related_instance_id and the columns of related (target_*) and index (prior_*).

    relationship rows with both ends known and an entry in index (prior_instance_id unique), without
    repeats; one_per_target: of a target's priors the first by id. The end tables prune the pairs by
    semi joins before anything wide is joined; of repeated related rows the last counts, by a column `row` that says
    their places in their file (see readers.lines); without one a related id that comes twice fails the query.
    """
    rel = need_columns(relationship, "experience_instance_id", "related_instance_id").select("experience_instance_id", "related_instance_id")
    rel = rel.join(experience.select(F.col("instance_id").alias("experience_instance_id")), "experience_instance_id", "left_semi")
    rel = rel.join(related.select(F.col("instance_id").alias("related_instance_id")), "related_instance_id", "left_semi")
    rel = rel.join(index.select(F.col("prior_instance_id").alias("experience_instance_id")), "experience_instance_id", "left_semi").distinct()
    if one_per_target:
        rel = rel.groupBy("related_instance_id").agg(F.min("experience_instance_id").alias("experience_instance_id"))
    own = [c for c in related.columns if c not in ("instance_id", "row")]
    if "row" in related.columns:
        last = related.groupBy("instance_id").agg(F.max_by(F.struct(*own), "row").alias("t")).select("instance_id", "t.*")
    else:
        last = unique(related, "instance_id")
    target = last.select(F.col("instance_id").alias("related_instance_id"), *(F.col(c).alias(f"target_{c}") for c in own))
    prior = unique(index, "prior_instance_id").withColumnRenamed("prior_instance_id", "experience_instance_id")
    return rel.join(target, "related_instance_id").join(prior, "experience_instance_id")


def first_pairs(pairs_: DataFrame, limit: int | None) -> DataFrame:
    """The first pairs by related and experience id, one at least; None: all of them. A top-k, not a sort."""
    if limit is None:
        return pairs_
    return pairs_.orderBy("related_instance_id", "experience_instance_id").limit(max(limit, 1))


def manifest_summary(pairs_: DataFrame, runs_: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row: pair_rows, unique_priors, unique_targets, run_rows, missing_targets (sorted; those of `expected`, column target_instance_id, that no pair has)."""
    n = pairs_.agg(F.count("*").alias("pair_rows"), F.count_distinct("experience_instance_id").alias("unique_priors"), F.count_distinct("related_instance_id").alias("unique_targets"))
    out = n.crossJoin(runs_.agg(F.count("*").alias("run_rows")))  # one row each
    if expected is None:
        return out.withColumn("missing_targets", F.array().cast("array<string>"))
    gone = expected.select("target_instance_id").distinct().join(pairs_.select(F.col("related_instance_id").alias("target_instance_id")), "target_instance_id", "left_anti")
    return out.crossJoin(gone.agg(F.array_sort(F.collect_list("target_instance_id")).alias("missing_targets")))


def injection_index(files: DataFrame) -> DataFrame:
    """key, path: for each long enough part of a file name (without extension) and each marked id in its text, the first path that has it.

    files: path, value. Markers are lines trajectory_id: x and instance_id: x.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    parts = F.filter(F.concat(F.array(stem), F.split(stem, "_(?!_)|__")), lambda p: F.length(p) >= 6)
    marked = F.regexp_extract_all(F.left("value", F.lit(12000)), F.lit(r"(?m)^\s*-?\s*(?:trajectory_id|instance_id):\s*(\S+)\s*$"), F.lit(1))
    keys = files.select("path", F.posexplode(F.concat(parts, marked)).alias("rank", "key"))
    return keys.groupBy("key").agg(F.min_by("path", F.struct("path", "rank")).alias("path"))


def with_injections(pairs_: DataFrame, indexes: dict[str, DataFrame]) -> DataFrame:
    """pairs with <condition>_file: by trajectory id, else by instance id; a pair without one fails the query."""
    out = pairs_
    for condition, index in indexes.items():
        a = index.select(F.col("key").alias("prior_trajectory_id"), F.col("path").alias("__a"))
        b = index.select(F.col("key").alias("experience_instance_id"), F.col("path").alias("__b"))
        out = out.join(a, "prior_trajectory_id", "left").join(b, "experience_instance_id", "left")
        missing = F.raise_error(F.concat(F.lit(f"no {condition} file for "), F.col("experience_instance_id")))
        out = out.withColumn(f"{condition}_file", F.coalesce("__a", "__b", missing)).drop("__a", "__b")
    return out


def runs(pairs_: DataFrame, one_per_target: bool = True, image: str = "tasks", root: str = "runs") -> DataFrame:
    """Four runs of each pair, one per condition; injection_file is null for no_memory."""
    r = pairs_.withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    middle = "__" if one_per_target else F.concat(F.lit("__from__"), F.col("experience_instance_id"), F.lit("__"))
    files = [f"{c}_file" for c in CONDITIONS if f"{c}_file" in pairs_.columns]
    injection = F.coalesce(*(F.when(F.col("condition") == f[:-5], F.col(f)) for f in files)) if files else F.lit(None).cast("string")
    r = r.withColumns(
        {
            "run_id": F.concat("related_instance_id", F.lit(middle) if isinstance(middle, str) else middle, "condition"),
            "injection_file": injection,
            "sandbox_image": F.concat(F.lit(f"{image}:"), text.docker_tag(F.col("related_instance_id"))),
            "output_dir": F.concat_ws("/", F.lit(root), "related_instance_id", "condition"),
            "status": F.lit("pending"),
        }
    )
    return r.withColumnsRenamed({"related_instance_id": "target_instance_id", "experience_instance_id": "prior_instance_id"}).drop(*files)


def incomplete_targets(prompts: DataFrame) -> DataFrame:
    """target_instance_id, conditions, issues: targets without exactly the four conditions, or with several issue texts."""
    g = prompts.groupBy("target_instance_id").agg(F.array_sort(F.collect_set("condition")).alias("conditions"), F.count_distinct("target_problem_statement_sha256").alias("issues"))
    want = F.array(*map(F.lit, sorted(CONDITIONS)))
    return g.filter((F.col("conditions") != want) | (F.col("issues") != 1))


def ordered_plan(rows: DataFrame, conditions: tuple[str, ...] = CONDITIONS, smoke_target: str | None = None, most: int | None = None) -> DataFrame:
    """The runs of some conditions by target, place of the condition in the list, and run id, numbered from 0."""
    p = need_columns(rows, "run_id", "condition", "target_instance_id").filter(F.col("condition").isin(*conditions))
    if smoke_target is not None:
        p = p.filter(F.col("target_instance_id") == smoke_target)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, conditions)), F.col("condition")), F.lit(0)), F.lit(999))
    p = shared.numbered(p, "plan_index", F.col("target_instance_id"), place, F.col("run_id"))
    return p.filter(F.col("plan_index") < most) if most is not None else p


def to_do(plan: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Runs that haven't succeeded. done: run_id, status."""
    return plan if force else plan.join(done.filter(F.col("status").isin(*SUCCESS)), "run_id", "left_anti")


def run_status(skipped: str = "skipped", exception: str = "exception", off_workspace: str = "off_workspace_writes", exit_code: str = "exit_code", patch: str = "patch", fail_on_off_workspace: bool = True) -> Column:
    """skipped_success, orchestrator_exception, workspace_guardrail_failed, success_empty_patch, success or openhands_failed; 'started' while there is no exit code.

    Columns: a boolean, the exception's text, the number of files written outside, the exit code, the patch.
    """
    outside = (F.coalesce(F.col(off_workspace), F.lit(0)) > 0) & F.lit(fail_on_off_workspace)
    ended = F.when(F.coalesce(patch, F.lit("")) == "", "success_empty_patch").otherwise("success")
    return (
        F.when(F.coalesce(skipped, F.lit(False)), "skipped_success").when(F.col(exception).isNotNull(), "orchestrator_exception").when(F.col(exit_code).isNull(), "started")
        .when(outside, "workspace_guardrail_failed").when(F.col(exit_code) == 0, ended).otherwise("openhands_failed")
    )


def runtime(requested: Column, image_ready: Column, host_ready: Column) -> Column:
    """struct<runtime, reason>: host or image if forced; auto: the image if it can, else the host. runtime is null where what is asked for isn't there, and reason says so."""
    of = lambda name, reason: F.struct((F.lit(name) if name else F.lit(None).cast("string")).alias("runtime"), F.lit(reason).alias("reason"))
    image = F.when(image_ready, of("image", "forced_image")).otherwise(of(None, "image_not_ready"))
    auto = F.when(image_ready, of("image", "auto_image_available")).when(host_ready, of("host", "auto_image_missing_program")).otherwise(of(None, "neither_ready"))
    return F.when(requested == "host", of("host", "forced_host")).when(requested == "image", image).when(requested == "auto", auto).otherwise(of(None, "unknown_runtime"))


def selection_problems(rows: DataFrame, conditions: tuple[str, ...] = CONDITIONS, smoke_target: str | None = None, confirmed: bool = True) -> DataFrame:
    """problem, detail: why a selection of runs must not start. No rows: it may.

    null_field: a required field is null (the run's id and the fields); smoke_conditions: the smoke target hasn't exactly the conditions;
    duplicate: a target has a condition more than once; empty: nothing is selected; unconfirmed: a full run nobody has confirmed.
    """
    spark = rows.sparkSession
    need_columns(rows, *RUN_FIELDS)
    blank = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in RUN_FIELDS)))
    found = rows.withColumn("__blank", blank).filter(F.size("__blank") > 0).select(F.lit("null_field").alias("problem"), F.concat_ws(": ", "run_id", F.array_join("__blank", ",")).alias("detail"))
    chosen = rows.filter(F.col("condition").isin(*conditions))
    if smoke_target is not None:
        chosen = chosen.filter(F.col("target_instance_id") == smoke_target)
        have = chosen.agg(F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("detail")).filter(F.col("detail") != ",".join(sorted(conditions)))
        found = found.unionByName(have.select(F.lit("smoke_conditions").alias("problem"), "detail"))
    elif not confirmed:
        found = found.unionByName(spark.createDataFrame([("unconfirmed", "")], "problem string, detail string"))
    twice = chosen.groupBy("target_instance_id", "condition").agg(F.count("*").alias("n")).filter("n > 1")
    found = found.unionByName(twice.select(F.lit("duplicate").alias("problem"), F.concat_ws(" ", "target_instance_id", "condition").alias("detail")))
    none = chosen.agg(F.count("*").alias("n")).filter("n = 0")
    return found.unionByName(none.select(F.lit("empty").alias("problem"), F.lit("").alias("detail")))


def select_runs(rows: DataFrame, conditions: tuple[str, ...] = CONDITIONS, smoke_target: str | None = None, confirmed: bool = True, most: int | None = None) -> DataFrame:
    """ordered_plan() of a selection without problems; else an error that names the first ten."""
    bad = selection_problems(rows, conditions, smoke_target, confirmed).limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['problem']} {r['detail']}".strip() for r in bad))
    return ordered_plan(rows, conditions, smoke_target, most)


@dataclass(frozen=True)
class Predictions:
    """strict: condition, plan_index, run_id, pred; audit: one row for each of these; missing: run_id, prediction_path; duplicates: condition, instance_ids."""

    strict: DataFrame
    audit: DataFrame
    missing: DataFrame
    duplicates: DataFrame


def predictions(plan: DataFrame, found: DataFrame, audits: DataFrame) -> Predictions:
    """What the runs of a plan (run_id, condition, target_instance_id, plan_index, run_dir) predicted.

    found, audits: folder, pred (VARIANT, null where there is no file or it is no object) of prediction.json and prediction_audit.json, see readers.predictions.
    A run without a prediction is missing; one without an audit has a row that says so; of each condition the instance ids that several runs predict are listed, and all their rows kept.
    """
    at = lambda c: F.regexp_replace(c, "^[a-z][a-z0-9+.-]*:(//[^/]*)?|/+$", "")
    own = lambda df, name: df.select(at("folder").alias("__dir"), F.col("pred").alias(name)).filter(f"{name} is not null")
    p = plan.withColumn("__dir", at("run_dir")).join(own(found, "pred"), "__dir", "left").join(own(audits, "audit"), "__dir", "left")
    have = p.filter("pred is not null")
    none = F.struct("run_id", "condition", "target_instance_id", F.lit(True).alias("prediction_missing_audit"))
    audit = have.select("plan_index", "run_id", "condition", F.coalesce(F.to_json("audit"), F.to_json(none)).alias("json"))
    missing = p.filter("pred is null").select("run_id", F.concat("run_dir", F.lit("/prediction.json")).alias("prediction_path"))
    strict = have.select("condition", "plan_index", "run_id", F.coalesce(F.try_variant_get("pred", "$.instance_id", "string"), F.lit("")).alias("instance_id"), F.to_json("pred").alias("json"))
    twice = strict.groupBy("condition", "instance_id").agg(F.count("*").alias("n")).filter("n > 1").groupBy("condition").agg(F.array_sort(F.collect_list("instance_id")).alias("instance_ids"))
    return Predictions(strict, audit, missing, twice)


def write_predictions(strict: DataFrame, path: str) -> None:
    """Lines of JSON in plan order, a folder for each condition, of which only those that `strict` has rows of are replaced."""
    rows = strict.repartitionByRange("condition", "plan_index").sortWithinPartitions("condition", "plan_index")
    rows.select("condition", F.col("json").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").text(path)


def report(plan: DataFrame, results: DataFrame) -> DataFrame:
    """One row: selected and finished runs, statuses and conditions as sorted maps."""
    both = plan.join(results.select("run_id", F.col("status").alias("result")), "run_id", "left")
    counted = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    s = both.groupBy("result").agg(F.count("*").alias("n")).filter("result is not null").agg(counted("result").alias("status_counts"))
    c = both.groupBy("condition").agg(F.count("*").alias("n")).agg(counted("condition").alias("condition_counts"))
    n = both.agg(F.count("*").alias("selected"), F.count("result").alias("finished"), F.count_distinct("target_instance_id").alias("targets"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    return one(n).join(one(s), "__k").join(one(c), "__k").drop("__k")


def ambiguous(relationship: DataFrame) -> DataFrame:
    """related_instance_id, candidates: related tasks with more than one prior."""
    g = relationship.select("related_instance_id", "experience_instance_id").distinct().groupBy("related_instance_id").agg(F.array_sort(F.collect_list("experience_instance_id")).alias("candidates"))
    return g.filter(F.size("candidates") > 1)
