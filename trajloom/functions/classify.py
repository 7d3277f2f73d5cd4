"""Ordered classifiers of paths, commands and observations, as CASE expressions over rule tables.

There are two policies: "strip" decides what may be shown to an agent, "memory" sorts what is
remembered. They differ in a few rules on purpose and are not to be unified.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, text


def chain(pairs: Sequence[tuple[str, Column]], default: str | None) -> Column:
    """The label of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, condition in pairs:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def holds_any(c: Column, tokens: Sequence[str]) -> Column:
    return any_of([c.contains(t) for t in tokens])


# ---- paths


def normalize_path(c: Column) -> Column:
    """A path in the repository: slashes, no leading ./, and no folders down to a testbed of an absolute or temporary path."""
    p = text.strip(text.normalize(c))
    p = F.regexp_replace(F.regexp_replace(p, r"[\\/]+", "/"), r"\A(?:\./)+", "")

    def below(p: Column) -> Column:
        inside = F.regexp_extract(p, r"(?:^|/)testbed/(.*)$", 1)
        return F.when(p.contains("testbed/") & p.rlike(r"(?:^|/)testbed/") & (p.startswith("/") | p.contains("/tmp/") | p.startswith("tmp/")), inside).otherwise(p)

    p = text.let(p, below)
    p = F.regexp_replace(p, r"\A(?:[^/]*swebench[^/]*/)+testbed/", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\Atestbed/", ""), r"\A(?:\./)+", ""), "/+", "/")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def extension(p: Column) -> Column:
    """What follows the last dot of the file name, lower-cased; '' without a dot."""
    return F.when(basename(p).contains("."), F.lower(F.substring_index(basename(p), ".", -1))).otherwise("")


#: Names of the workspace itself, in their normal form.
ROOTS = ("", ".", "./", "testbed", "./testbed")


def is_root(p: Column) -> Column:
    return F.lower(normalize_path(p)).isin(*ROOTS)


def _artifact(p: Column, policy: str) -> Column:
    name = basename(p)
    common = name.endswith("_preds.json") | name.isin(*rules.PREDICTION_FILES) | name.endswith(".patch") | name.endswith(".diff")
    return common | (p.startswith("output/") if policy == "strip" else p.startswith("output/") & name.endswith("preds.json"))


def _scratch(p: Column, policy: str) -> Column:
    name, words = basename(p), "|".join(rules.SCRATCH_WORDS[policy])
    return name.isin(*rules.SCRATCH_FILES[policy]) | name.rlike(rf"^(?:{words})[_-]") | name.rlike(rf"[_-](?:{words})\.[^.]+$") | F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, rules.SCRATCH_FOLDERS)))


def _test(p: Column) -> Column:
    name = basename(p)
    folders = F.split(F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(""), "/")
    return F.arrays_overlap(folders, F.array(*map(F.lit, rules.TEST_FOLDERS))) | name.startswith("test_") | any_of([name.endswith(e) for e in rules.TEST_ENDINGS])


def _harness(p: Column) -> Column:
    return basename(p).isin(*rules.HARNESS_FILES) | any_of([(p == f) | p.startswith(f + "/") for f in rules.HARNESS_FOLDERS])


def path_class(path: Column, policy: str = "strip") -> Column:
    """strip: empty_path, workspace_root, submission_artifact, harness, scratch, test, source, other. memory: the last five but harness.

    The memory policy looks at the path as it is, the strip policy at its normal form.
    """

    def of(raw: Column) -> Column:
        looked_at = lambda: text.let(F.lower(normalize_path(raw) if policy == "strip" else raw), lambda p: _path_class(raw, p, policy))
        return F.when(raw == "", "empty_path" if policy == "strip" else "other").otherwise(looked_at())  # most events have no path

    return text.let(F.coalesce(path, F.lit("")), of)


def _path_class(raw: Column, p: Column, policy: str) -> Column:
    """The class of a path that isn't empty, p being what the policy looks at."""
    tail = [("scratch", _scratch(p, policy)), ("test", _test(p)), ("source", extension(raw).isin(*rules.SOURCE_EXTENSIONS))]
    if policy == "memory":
        return chain([("submission_artifact", _artifact(p, policy)), *tail], "other")
    return chain([("workspace_root", p.isin(*ROOTS)), ("submission_artifact", _artifact(p, policy)), ("harness", _harness(p)), *tail], "other")


def primary_path(function: Column, file_path: Column, path: Column, notebook_path: Column, policy: str = "strip") -> Column:
    """The normal form of the first path argument that isn't blank; a Glob has its `path` or, for the memory policy, none."""
    filled = lambda c: text.let(c, lambda x: F.when(text.strip(x) != "", x))
    first = F.coalesce(filled(file_path), filled(path), filled(notebook_path))
    glob = filled(path) if policy == "strip" else F.lit(None).cast("string")
    normal = lambda c: text.let(c, lambda p: F.when(p.isNull(), F.lit("")).otherwise(normalize_path(p)))
    return normal(F.when(function == "Glob", glob).otherwise(first)) if policy == "strip" else F.when(function == "Glob", F.lit("")).otherwise(normal(first))


# ---- commands


def _one_line(c: Column) -> Column:
    """A command on one line, single blanks, without leading changes of folder."""
    return text.strip(F.regexp_replace(text.strip(F.regexp_replace(c, rf"(?U){text.SPACE}+", " ")), r"(?i)\A(?:cd\s+\S+\s*&&\s*)+", ""))


def _alone(command: Column, policy: str, pattern: str) -> Column:
    """Whether a command of one line fits the pattern."""
    c = text.strip(text.scrub(command) if policy == "strip" else text.normalize(command))
    return text.let(c, lambda x: F.when(x.contains("\n"), F.lit(False)).otherwise(_one_line(x).rlike(pattern)))


def is_git_state(command: Column, policy: str = "strip") -> Column:
    return _alone(command, policy, rules.GIT_STATE)


def is_probe(command: Column, policy: str = "strip") -> Column:
    return _alone(command, policy, rules.PROBE)


def command_class(command: Column, policy: str = "strip") -> Column:
    """strip: submission_artifact, harness, patch_dump_or_staging, diagnostic_environment_noise, then as memory:
    destructive, test, build_install, setup, diagnostic, other. The memory policy calls artifacts other and noise diagnostic.
    """
    return text.let(text.strip(text.normalize(command)), lambda c: _class_of(c, policy))


def _class_of(c: Column, policy: str) -> Column:
    """The class of a normalised command."""
    return text.let(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), lambda low: _class_by(c, low, policy))


def _class_by(c: Column, low: Column, policy: str) -> Column:
    artifact = holds_any(low, rules.ARTIFACT_TEXT) | low.rlike(rules.ARTIFACT[policy])
    clean = text.strip(text.scrub(c)) if policy == "strip" else c
    noise = text.let(clean, lambda x: F.when(x.contains("\n"), F.lit(False)).otherwise(text.let(_one_line(x), lambda y: y.rlike(rules.GIT_STATE) | y.rlike(rules.PROBE))))
    tail = [("destructive", c.rlike(rules.DESTRUCTIVE)), ("test", c.rlike(rules.TEST[policy])), ("build_install", c.rlike(rules.BUILD_INSTALL[policy])), ("setup", c.rlike(rules.SETUP)), ("diagnostic", c.rlike(rules.DIAGNOSTIC))]
    if policy == "memory":
        return chain([("other", artifact), ("diagnostic", noise), *tail], "other")
    return chain([("submission_artifact", artifact), ("harness", holds_any(low, rules.HARNESS_TEXT)), ("patch_dump_or_staging", c.rlike(rules.PATCH_STAGING)), ("diagnostic_environment_noise", noise), *tail], "other")


def is_patch_payload(command: Column) -> Column:
    """Whether a command holds a diff or forbidden token, or writes to a patch or diff file."""
    return text.let(text.normalize(command), lambda c: text.forbidden(c) | (c.contains(">") & _writes_patch(c)))


def _writes_patch(c: Column) -> Column:
    group = lambda k: F.nullif(F.regexp_extract(c, rules.PATCH_WRITE, k), F.lit(""))
    name = F.lower(basename(F.regexp_replace(text.strip(F.coalesce(group(1), group(2), group(3), F.lit(""))), r"""\A['"]+|['"]+\z""", "")))
    return text.let(name, lambda x: x.rlike(r"\A(?:patch|diff)(?:\..*)?\z|\.(?:patch|diff)\z"))


# ---- observations


def is_missing_path(c: Column, normal: bool = False) -> Column:
    gone = lambda low: low.isin(*rules.MISSING_ALONE) | holds_any(low, rules.MISSING_TEXT) | (low.contains("no such file or directory") & holds_any(low, rules.MISSING_PROGRAMS))
    return text.let(F.lower(text.strip(c if normal else text.normalize(c))), gone)


def is_setup_failure(c: Column, normal: bool = False) -> Column:
    return text.let(F.lower(c if normal else text.normalize(c)), lambda low: any_of([reduce(lambda a, b: a & b, [low.contains(t) for t in tokens]) for tokens in rules.SETUP_FAILURES]))


def is_listing(c: Column, normal: bool = False) -> Column:
    """Only a listing of the workspace's own files: few lines, and none that looks like a repository's. normal: c is normalised, as in the two above."""

    def listing(lines: Column) -> Column:
        def of(joined: Column) -> Column:
            alone = (F.size(lines) <= 3) & joined.isin(*rules.LISTING_ALONE)
            return alone | ((F.size(lines) <= 20) & holds_any(joined, rules.LISTING_TOKENS) & ~joined.rlike(rules.REPOSITORY_WORDS))

        return (F.size(lines) == 0) | text.let(F.lower(F.array_join(lines, "\n")), of)

    return text.let(F.filter(F.transform(F.split(c if normal else text.normalize(c), "\n"), text.strip), lambda x: x != ""), listing)


def is_noise(c: Column, policy: str = "strip") -> Column:
    def noise(t: Column) -> Column:
        of = is_missing_path(t, True) | is_setup_failure(t, True)
        return is_listing(t, True) | of if policy == "strip" else of

    return text.let(text.normalize(c), noise)


def failure_bucket(class_: Column, function: Column, action_class: Column) -> Column:
    """Where a failure line belongs, by the action before its observation."""
    return chain(
        [
            ("test_failures", action_class == "test"),
            ("install_failures", action_class == "build_install"),
            ("setup_failures", action_class.isin("setup", "destructive")),
            ("runtime_failures", action_class.isin("diagnostic", "other") | ((class_ == "api_action") & function.isin(*rules.INSPECT_TOOLS))),
        ],
        "other_failures",
    )


def observation_kind(class_: Column, function: Column, language: Column, action_class: Column) -> Column:
    """read_result, grep_result, glob_result, test_output, diagnostic_output or null."""
    api, bash = class_ == "api_action", (class_ == "code_action") & (language == "bash")
    pairs = [(f"{t.lower()}_result", api & (function == t)) for t in rules.INSPECT_TOOLS]
    return chain([*pairs, ("test_output", bash & (action_class == "test")), ("diagnostic_output", bash & (action_class == "diagnostic"))], None)
