"""Text functions on columns: normalising, scrubbing, truncating. All stay inside the JVM."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import rules

#: White space as Unicode and ASCII separators know it, without and with the line feed.
BLANK = r"[\s\x1c-\x1f\x85&&[^\n]]"
SPACE = r"[\s\x1c-\x1f\x85]"
#: The same of ASCII texts, a class that is matched by table.
ASCII_BLANK = r"[ \t\x0b\f\r\x1c-\x1f]"
#: The ASCII characters of SPACE, to be trimmed.
ASCII_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
#: Every text that scrub() changes, but for white space, has one of these in it.
TRACES = "(?i)```diff|diff --git|index\\s|---|\\+\\+\\+|@@|<system-reminder>|" + rules.HARNESS_LINE.removeprefix("(?i)")


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Remove white space at both ends. ASCII texts need no regular expression for it."""
    whole = lambda t: F.regexp_replace(t, rf"(?U)\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")
    return let(c, lambda t: F.when(F.char_length(t) == F.octet_length(t), F.btrim(t, F.lit(ASCII_SPACE))).otherwise(whole(t)))


def normalize(c: Column) -> Column:
    """Null to '', CR LF and CR to LF, no white space at line ends."""

    def ends(t: Column) -> Column:
        plain = F.regexp_replace(t, rf"(?<!{ASCII_BLANK}){ASCII_BLANK}++(?=\n|\z)", "")
        return F.when(F.char_length(t) == F.octet_length(t), plain).otherwise(F.regexp_replace(t, rf"(?U)(?<!{BLANK}){BLANK}++(?=\n|\z)", ""))

    feeds = let(F.coalesce(c, F.lit("")), lambda t: F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))
    return let(feeds, ends)


def normalize_whole(c: Column) -> Column:
    """As normalize(), and no white space at the ends of the text either."""
    return strip(normalize(c))


def without_lines(c: Column, pattern: str) -> Column:
    """The text without the lines in which the pattern is found."""
    kept = F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.rlike(pattern)), "\n")
    return F.when(c.rlike(pattern), kept).otherwise(c)


def without_diffs(c: Column) -> Column:
    """Remove fenced diff blocks and unified diffs.

    A unified diff begins at a header line and goes on over headers, empty lines and lines that
    start with a blank, tab, plus, minus or backslash: one match of a regular expression, however long.
    """
    return let(normalize(c), _no_diffs)


def without_reminders(c: Column) -> Column:
    return let(normalize(c), _no_reminders)


def _no_diffs(t: Column) -> Column:
    """without_diffs() of a normalised text; what a text doesn't hold isn't searched for."""
    fences = F.when(t.rlike("(?i)```diff"), normalize(F.regexp_replace(t, rules.DIFF_FENCE, "\n"))).otherwise(t)
    cut = lambda x: normalize(F.substr(F.regexp_replace(F.concat(F.lit("\n"), x), rules.DIFF_REGION, ""), F.lit(2)))
    return let(fences, lambda x: F.when(x.rlike(r"(?i)diff --git|index\s|---|\+\+\+|@@"), cut(x)).otherwise(x))


def _no_reminders(t: Column) -> Column:
    return F.when(t.rlike("(?i)<system-reminder>"), normalize(F.regexp_replace(t, rules.REMINDER, "\n"))).otherwise(t)


@functools.lru_cache(maxsize=256)
def _scrubbed(name: str, application: str) -> Column:
    return scrub(F.col(name))


def scrub(c: Column | str) -> Column:
    """Remove diffs, system reminders and harness lines. Most texts have no trace of these and are normalised only.

    A column's name instead of a column saves time on the driver: the expression, which takes a second to build, is kept for each name.
    """
    if isinstance(c, str):
        return _scrubbed(c, SparkSession.active().sparkContext.applicationId)

    def whole(t: Column) -> Column:
        return let(let(_no_diffs(t), _no_reminders), lambda x: without_lines(x, rules.HARNESS_LINE))

    return let(normalize(c), lambda t: F.when(t.rlike(TRACES), whole(t)).otherwise(t))


def may_scrub(json: Column) -> Column:
    """Whether scrubbing the strings of a JSON text could change one: a trace, a blank at a line's end, an escape or a character beyond ASCII."""
    return json.rlike(TRACES) | json.rlike(r'\\[rftu]|\s(?:\\n|")|[^\x00-\x7F]')


def forbidden(c: Column) -> Column:
    """Whether a token is found that must never reach an agent. White space doesn't matter to the tokens, nor line ends; null has none."""
    may = lambda t: let(F.lower(t), lambda low: functools.reduce(operator.or_, [low.contains(x) for x in rules.FORBIDDEN_PARTS]))
    return let(F.coalesce(c, F.lit("")), lambda t: may(t) & t.rlike(rules.HARD_FORBIDDEN))


def truncate(c: Column, most: int) -> Column:
    """struct<text, truncated>: at most `most` code points."""
    if most < 0:
        raise ValueError("a limit can't be negative")
    return F.struct(F.left(c, F.lit(most)).alias("text"), (F.char_length(c) > most).alias("truncated"))


def compact(parts: Column) -> Column:
    """Join an array's non-blank texts, stripped, by empty lines; null if there is none."""
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n"))


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column, n: int = 12) -> Column:
    return F.left(sha(c), F.lit(n))


def safe_name(c: Column, default: str = "unknown", most: int = 120) -> Column:
    """A file name: other characters than letters, digits, '.', '_' and '-' become '_'."""
    name = F.left(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit(most))
    return F.when(name == "", F.lit(default)).otherwise(name)


def safe_file_name(c: Column, default: str = "unknown", most: int = 120) -> Column:
    """A file name in which separators, wild cards, quotes and blanks are one '_'; letters of any script stay."""
    name = F.coalesce(F.nullif(strip(normalize(F.coalesce(c, F.lit("")))), F.lit("")), F.lit(default))
    name = F.regexp_replace(F.regexp_replace(name, r'(?U)[/\\:*?"<>|\s]+', "_"), "_+", "_")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(name, r"^[._]+|[._]+$", ""), F.lit(most)), F.lit("")), F.lit(default))


def safe_path_part(c: Column) -> Column:
    """A folder's name of letters, digits and . _ = -; 'unnamed' if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(normalize(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_.=-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed"))


def docker_tag(c: Column) -> Column:
    return F.replace(c, F.lit("__"), F.lit("."))


def first_filled(*names: str, required: bool = False, default: str = "") -> Column:
    """The first of several columns that isn't empty once normalised, else the default; required: a row without any fails the query."""
    missing = F.raise_error(F.lit(f"none of {', '.join(names)} is filled")).cast("string") if required else F.lit(default)
    return F.coalesce(*(F.nullif(normalize(F.col(n)), F.lit("")) for n in names), missing)


def utc_seconds(c: Column) -> Column:
    """A timestamp as 2024-01-31T08:00:00+00:00, whatever the session's time zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def issue_metadata(c: Column, plain: bool = False) -> Column:
    """struct<instance_id, repo, base_commit, problem_statement> from labelled lines; null where there is none. Lines end at line feeds only.

    plain: white space is blank, tab, line feed, form feed and carriage return; of a statement only space characters are taken off, and one that is labelled but empty is ''.
    """
    space = r"[ \t\n\f\r]" if plain else r"\s"
    line = lambda key: F.nullif(F.regexp_extract(c, rf"(?dm)^{space}*{key}:{space}*(.+?){space}*$", 1), F.lit(""))
    found = F.regexp_extract(c, rf"(?s)problem_statement:{space}*(.*)\z", 1)
    trimmed = F.regexp_replace(found, r"\A\p{Zs}++|(?<!\p{Zs})\p{Zs}++\z", "")
    rest = F.when(c.contains("problem_statement:"), trimmed) if plain else F.nullif(strip(found), F.lit(""))
    return F.struct(line("instance_id").alias("instance_id"), line("repo").alias("repo"), line("base_commit").alias("base_commit"), rest.alias("problem_statement"))


def failure_rule(line: Column) -> Column:
    """The first failure rule that a stripped line fits, null for none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in rules.FAILURES:
        out = out.when(line.rlike(pattern), F.lit(name))
    return out


def indent(c: Column, prefix: str) -> Column:
    """Put the prefix before each line; an empty text becomes the prefix without its blanks."""
    return F.when(c == "", F.lit(prefix.rstrip())).otherwise(F.regexp_replace(c, r"(?m)^", prefix))
