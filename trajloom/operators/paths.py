"""Paths as data: prefixes matched by joins, several roots, allow-lists and skipped folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import folders

#: Files that a run may write beside its workspace (fixed values).
RUN_FILES = ("prompt.txt", "stdout.jsonl", "stderr.log", "run_meta.json", "command.json", "patch.diff", "prediction.json", "prediction_audit.json")


def clean(path: Column) -> Column:
    """The path without empty and '.' parts, and '..' taken back; as far as that goes: '/..' is '/', and '../x' stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    rooted = path.startswith("/")

    def step(acc: Column, p: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        up = F.when(top.isNull(), F.when(rooted, acc).otherwise(F.concat(acc, F.array(p)))).when(top == "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    kept = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), kept)).otherwise(F.when(kept == "", ".").otherwise(kept))


def prefixes(path: Column) -> Column:
    """The folders that a clean path lies in and the path itself, shortest first, '/' left out."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    lead = F.when(path.startswith("/"), "/").otherwise("")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(lead, F.array_join(F.slice(parts, F.lit(1), i), "/")))


def nearest_folder(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """files with `root`: of the given folders the deepest that a path lies in or is, null for none.

    Paths are exploded to their prefixes, which meet the folders in one equality join; no path is compared with every folder.
    """
    keyed = files.withColumn("__id", clean(F.col(path)))
    each = keyed.select("__id").distinct().select("__id", F.posexplode(prefixes(F.col("__id"))).alias("__depth", "__root"))
    own = roots.select(clean(F.col(root)).alias("__root")).distinct()
    found = each.join(own, "__root").groupBy("__id").agg(F.max_by("__root", "__depth").alias(root))
    return keyed.drop(root).join(found, "__id", "left").drop("__id")


def writes_outside(files: DataFrame, runs: DataFrame, scoped: Sequence[str] = (), most: int = 200, allowed: Sequence[str] = RUN_FILES) -> DataFrame:
    """run_id, path (below the folder that holds the run's): files changed during a run near it, but outside of where it may write; of each run the first `most`.

    files: path, modified. runs: run_id, run_dir, workspace_dir, since. A run may write its workspace, folders of its run_dir named in `scoped`, and
    the files in `allowed` in it. What lies above the run's parent folder isn't looked at.
    """
    r = runs.select("run_id", "since", clean(F.col("run_dir")).alias("dir"), clean(F.col("workspace_dir")).alias("work"))
    r = r.withColumn("parent", F.regexp_replace("dir", "/[^/]*$", ""))
    below = lambda folder: F.array(*(F.concat("dir", F.lit(f"/{n}")) for n in folder)) if folder else F.array().cast("array<string>")
    r = r.withColumns({"skip": F.concat(F.array("work"), below(scoped)), "may": below(allowed)})
    f = files.select(clean(F.col("path")).alias("path"), "modified")
    f = f.select("path", "modified", F.explode(prefixes(F.col("path"))).alias("parent")).filter("parent <> path")
    hit = f.join(r, "parent").filter(F.col("modified") >= F.col("since")).filter(~F.array_contains("may", F.col("path")))
    hit = hit.filter(~F.exists("skip", lambda s: (F.col("path") == s) | F.col("path").startswith(F.concat(s, F.lit("/")))))
    hit = hit.select("run_id", F.expr("substring(path, length(parent) + 2)").alias("path"))
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("path"))
    return hit.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def resolved(df: DataFrame, column: str, existing: DataFrame, roots: Sequence[str], strict: bool = True) -> DataFrame:
    """df with <column>_resolved: of the roots, in order, the first below which the path exists; an absolute path is itself if it exists.

    existing: path of files that are there (see readers.files_under). With strict a path that is nowhere fails the query, which names what was tried; else it is null.
    """
    p = F.col(column)
    tried = F.when(p.startswith("/"), F.array(clean(p))).otherwise(F.array(*(clean(F.concat(F.lit(r.rstrip("/") + "/"), p)) for r in roots)))
    names = df.select(column).filter(p.isNotNull()).distinct().select(column, F.posexplode(tried).alias("__rank", "__at"))
    have = existing.select(clean(F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")).alias("__at")).distinct()
    found = names.join(have, "__at").groupBy(column).agg(F.min_by("__at", "__rank").alias("__found"))
    out = df.join(found, column, "left")
    said = F.concat(F.lit("Could not resolve path: "), p, F.lit(". Tried: "), F.array_join(tried, ", "))
    missing = F.when(p.isNotNull() & F.col("__found").isNull(), F.raise_error(said).cast("string")).otherwise(F.col("__found")) if strict else F.col("__found")
    return out.withColumn(f"{column}_resolved", missing).drop("__found").select(*df.columns, f"{column}_resolved")


def relative(path: Column, root: Column | str) -> Column:
    """The path below a root, or the path itself where it lies elsewhere."""
    base = clean(F.lit(root) if isinstance(root, str) else root)
    here = clean(path)
    return F.when(here.startswith(F.concat(base, F.lit("/"))), F.substr(here, F.length(base) + 2)).when(here == base, ".").otherwise(path)


def first_folder(spark: SparkSession, explicit: str | None, *candidates: str) -> str:
    """An explicit folder as it is, else the first candidate that exists, else the first, so that a later error names it."""
    if explicit is not None:
        return explicit
    return next((c for c in candidates if folders.exists(spark, c)), candidates[0])
