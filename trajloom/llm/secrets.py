"""Secrets in texts: patterns, and strings of which a vocabulary needs a token for every few characters."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, small_batches

Span = tuple[int, int, str]
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: One of these is in every text that ASSIGN finds something in.
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of the class, from their first character on: the matches of [0-9a-f]+ that are long enough.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9TZ_-]*)?")
ENCODED_DIGEST = re.compile(r"(?:md5|sha[0-9]{1,3})[-_/].*", re.IGNORECASE | re.DOTALL)
HUMP = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[A-Z]{2,}|[A-Za-z]")
PART = re.compile(r"([A-Za-z]*)[0-9]{0,4}|[0-9]+")


@dataclass(frozen=True)
class Rules:
    """ratio: characters a token, at most, of a random string. digests: lengths of the hexadecimal digests that are no secrets by themselves (MD5, SHA-1, the SHA-2 family). hump: letters that a word inside an identifier has on average, at least."""

    ratio: float = 2.0
    digests: tuple[int, ...] = (32, 40, 56, 64, 96, 128)
    hump: float = 3.0


def is_digest(s: str, rules: Rules) -> bool:
    return bool(len(s) in rules.digests and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) or ENCODED_DIGEST.fullmatch(s))


def is_identifier(s: str, rules: Rules) -> bool:
    """Numbers, UUIDs, dates, and names: parts between _ / + - that are words of one or several humps, with a short number after them, or numbers."""
    if UUID.fullmatch(s) or DATE.fullmatch(s):
        return True
    letters = humps = 0
    for part in re.split(r"[_/+=-]+", s):
        m = PART.fullmatch(part)
        if m is None:
            return False
        if word := m[1]:
            letters += len(word)
            humps += len(HUMP.findall(word))
    return letters >= rules.hump * humps


@functools.cache
def encoding(path: str):
    import tiktoken

    if not os.path.exists(path):  # on an executor that keeps its vocabularies elsewhere
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_in(s: str, vocabulary, step: int = 1024) -> int:
    """Tokens of a run, cut after every `step` characters, so that one of many MB takes time in proportion."""
    return sum(len(vocabulary.encode_ordinary(s[k : k + step])) for k in range(0, len(s), step))


def is_random(s: str, vocabulary, rules: Rules) -> bool:
    return not is_digest(s, rules) and not is_identifier(s, rules) and len(s) <= rules.ratio * tokens_in(s, vocabulary)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap; those that are too short are dropped and not tried again."""
    out: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def all_spans(text: str, vocabulary, rules: Rules = Rules()) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans: those, and random strings where none of them is."""
    own, added = base_spans(text), []
    runs = [m.span() for m in RUN.finditer(text)]
    if runs:
        ends: list[int] = []  # base spans joined where they overlap, to be walked along with the runs
        starts: list[int] = []
        for a, b, _ in own:
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        k = 0
        for a, b in runs:
            while k < len(ends) and ends[k] <= a:
                k += 1
            if not (k < len(starts) and starts[k] < b) and is_random(text[a:b], vocabulary, rules):
                added.append((a, b, "random"))
    return own, sorted(own + added, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FIELDS = [*((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("n_added", pa.int64())]


def find_secrets(df: DataFrame, path: str, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """df with n_assign, n_access, n_hex (of the patterns), base_sha256, spans, n_spans and n_added.

    path: ranks of a vocabulary as tiktoken reads them. spans: kind:start:end by start, then kind, comma-joined, in code points, ends
    exclusive: the patterns' matches (assignments to password, token and the like; access keys; long hexadecimal numbers), and kind
    random: runs of 16 or more letters, digits and + / _ - of which the vocabulary needs a token for every `rules.ratio` characters or
    fewer, and which are no digest, number, UUID, date or name. Names and single words are no candidates, so random letters of one
    case are not found. base_sha256 is the digest of the patterns' part.

    A null text counts as empty and has no spans. Whole texts are searched, row by row; none is dropped and repeated rows get equal
    results; columns with one of these names are replaced; an empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    kinds = pa.struct(FIELDS)
    schema = "struct<" + ",".join(f"{n}:{'string' if k == pa.string() else 'bigint'}" for n, k in FIELDS) + ">"

    @F.arrow_udf(schema)
    @lean
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = encoding(path)
        for batch in batches:
            rows = []
            for some in slices([batch], size=4 << 20):
                for t in some.to_pylist():
                    own, every = all_spans(t or "", vocabulary, rules)
                    rows.append((*(sum(k == s[2] for s in own) for k in BASE), hashlib.sha256(written(own).encode()).hexdigest(), written(every), len(every), len(every) - len(own)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)], fields=list(kinds))

    found = df.withColumn("__secrets", search(F.col(text)))
    return found.withColumns({n: F.col(f"__secrets.{n}") for n, _ in FIELDS}).drop("__secrets")
