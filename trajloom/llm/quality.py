"""Line-first cleaning: rules fail single lines, documents that lose too much text go."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lean, slices, small_batches

SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(b.encode() for b in ("|", "||", ">", ">>", "/", "»", "›", "·", "•", "::"))
#: Prose has one of these at the end of the line or before a blank, closing quotes and brackets after them aside.
TERMINAL = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*(?:\Z|\x20)")
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under the|\bcopyright\b|©|terms of (?:use|service)|privacy policy|cookie policy|(?:use|accept)s? cookies"
    r"|javascript (?:is|must be)|enable javascript|subscribe to our|sign up for|click here|lorem ipsum|share (?:this|on) |follow us|powered by ",
    re.IGNORECASE,
)
#: Every match of BOILERPLATE has one of these in it; so has every fault of separators, marks or symbols a match of SUSPECT.
PHRASES = ("rights reserved", "licensed", "released", "copyright", "©", "terms of", "privacy", "cookie", "javascript", "subscribe", "sign up", "click here", "lorem", "share ", "follow us", "powered by")
SUSPECT = re.compile(r"[#*$%&|<>/»›·•]|::|!!")
CAPITALS, LETTERS, BEYOND = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), bytes(range(128, 256))
MARKED = re.compile(rb"[#*$%&|<>]{2,}|!!")


@dataclass(frozen=True)
class Rules:
    """least_words, most_repeated: base rules, in words and percent. The others hold for a line or, most_lost, for a document; parts are of 1."""

    least_words: int = 50
    most_repeated: int = 50
    separators: float = 0.2
    marked: float = 0.25
    symbols: float = 0.1
    capitals: float = 0.7
    most_lost: float = 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, n, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def mostly_capitals(line: str, rules: Rules) -> bool:
    data = line.encode()
    capitals, letters = (len(data) - len(data.translate(None, x)) for x in (CAPITALS, LETTERS))
    others = len(line) - len(data.translate(None, BEYOND))
    if capitals + others <= max(20, rules.capitals * letters):  # too few, even if all characters beyond ASCII were capitals
        return False
    upper = sum(map(str.isupper, line))
    return upper > 20 and upper > rules.capitals * sum(map(str.isalpha, line))


def line_fault(line: str, rules: Rules) -> str | None:
    """The first rule that a line with a word fails."""
    words = line.encode().split()
    n = len(words)
    if n == 0:
        return None
    if SUSPECT.search(line):
        if sum(w in SEPARATORS for w in words) >= max(1, rules.separators * n):
            return "navigation"
        if sum(MARKED.search(w) is not None for w in words) > rules.marked * n:
            return "marks"
        if sum(map(line.count, SYMBOLS)) > rules.symbols * sum(map(len, words)):
            return "symbols"
    low = line.lower()
    if any(p in low for p in PHRASES) and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 5 and mostly_capitals(line, rules):
        return "capitals"
    if not TERMINAL.search(line.rstrip(SPACE)):
        return "punctuation"
    return None


def judged(text: str, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, lost_chars, cleaned text."""
    words = text.encode().split()
    chars = lambda s: len(s) - sum(map(s.count, SPACE))
    word_chars, dup, seen, stay, failed, lost = chars(text), 0, set(), [], 0, 0
    for line in text.split("\n"):
        if n := chars(line):
            dup += line in seen
            seen.add(line)
            if line_fault(line, rules):
                failed += 1
                lost += n
                continue
        stay.append(line)
    repeat = repeated_words(words)
    base = len(words) < rules.least_words or 100 * repeat > rules.most_repeated * len(words)
    kept = not base and lost <= rules.most_lost * word_chars
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeat, base, kept, failed, lost, "\n".join(stay)


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_failed_lines", pa.int64()), ("lost_chars", pa.int64())]
SCHEMA = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,n_failed_lines:bigint,lost_chars:bigint>"


def judge(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """df with a struct column `quality`: the counts and the verdict `kept`.

    A null text counts as empty: it has no words, so it fails. Lines without a word never fail and
    stay. Rows are judged one by one and none is dropped here; repeated rows get equal verdicts; a
    column named quality is replaced; an empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    kinds = pa.struct(FIELDS)

    @F.arrow_udf(SCHEMA)
    @lean
    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [judged(t or "", rules)[:-1] for some in slices([batch]) for t in some.to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)], fields=list(kinds))

    return df.withColumn("quality", verdicts(F.col(text)))


def clean(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents that pass, with their failed lines taken out of the text; the cases are those of judge().

    No column is added, so none can clash. Rejected documents' texts don't come back from the workers.
    """
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, at):
            found = [judged(t or "", rules) for t in some.column(at).to_pylist()]
            keep = [r[6] for r in found]
            columns = some.filter(pa.array(keep, pa.bool_())).columns
            columns[at] = pa.array([r[-1] for r in found if r[6]], some.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=some.schema)

    return df.mapInArrow(lean(passed), df.schema)
