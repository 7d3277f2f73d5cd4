"""Personal data: patterns with checks, and a character BiLSTM-CRF whose windows are reconciled over the text."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import Tagger, char_ids
from .common import lean, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of a window and of its overlap with the next, and windows that are read side by side.
WINDOW, OVERLAP, BATCH = 512, 64, 1024

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v // 5 + v * 2 % 10 for v in values[1::2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 14 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, from each @ and the run of name characters before it, so the time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at)
        if m and start < at:
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Matches that pass their checks, by start, then kind. Those of a kind don't overlap."""
    found = list(emails(text))
    found += [(*m.span(), "ip") for m in IP.finditer(text) if is_ip(m[0])]
    found += [(*m.span(), "card") for m in CARD.finditer(text) if is_card(m[0])]
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- labelled spans to train on


def invented(rng: random.Random) -> tuple[str, list[Span]]:
    """A text of made-up words with personal data, in plain and disguised forms, and with numbers that are none."""
    letters = rng.choice(["aeinorst", "abcdefghijklmnopqrstuvwxyz", "aeiouéèlmnrst", "aeiouüßchrnt"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    plain = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = rng.choice("3456") + (num(14) if rng.random() < 0.7 else "".join(rng.choice(num(2)) for _ in range(14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-", ".", ".", "_", "  ", " - ", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def personal() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), (" AT ", " DOT "), (" @ ", " . "), ("(at)", "."), ("{at}", "{dot}"), (" at ", ".")])
            long = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789._-") for _ in range(rng.randint(20, 60))).strip("._-") or "x"
            name = rng.choice([plain(), f"{plain()}.{plain()}", f"{plain()}{num(2)}", f"{plain()}.{num(2)}", f"{plain()}_{plain()}", f"{plain()}{dot}{plain()}", plain().capitalize(), long()])
            return f"{name}{at}{rng.choice(['mail', plain(), plain() + num(1), f'{plain()}-{plain()}'])}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'example' + dot + 'com'])}", kind
        if kind == "ip":
            return rng.choice([".", ".", "[.]", " . ", "(dot)", " dot "]).join(str(rng.randint(0, 255)) for _ in range(4)), kind
        if kind == "card":
            return card(), kind
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"{a}-{b}-{c} {num(2)}", f"+{num(2)} {a} {num(7)}", f"+{num(2)}{num(9)}", f"00{num(2)} {a} {num(6)}"]), kind

    def other() -> str:
        return rng.choice([
            num(rng.randint(1, 6)), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)},{num(3)}.{num(2)}", f"version {num(1)}.{num(2)}.{num(1)}",
            f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"#{num(5)}", f"({num(4)})", f"{num(2)}%", f"@{plain()}", f"{plain()}{num(3)}", f"[{num(2)}]", f"at {plain()}", f"{plain()} at {num(2)}:{num(2)}", f"dot {plain()}", f"https://www.{plain()}.com/{plain()}", f"{plain()}.{rng.choice(['py', 'txt', 'html'])}", f"© {num(4)} {plain()}", f"ISBN {num(3)}-{num(10)}",
            f"{num(4)}/{num(2)}/{num(2)} {num(2)}:{num(2)}:{num(2)}", f"<{plain()} {plain()}=\"{num(2)}\">", f"{num(3)}.{num(3)}.{num(3)}", "-" * rng.randint(3, 20), f"{num(20)}", f"look at {plain()}.{plain()}", f"{plain()} at {plain()}", f"{plain()}@{plain()}", f"{num(12)}", f"{num(2)}.{num(2)}.{num(4)}", f"(at) {plain()}",
        ])

    text, spans = "", []
    for _ in range(rng.randint(6, 26)):
        roll = rng.random()
        if roll < 0.18:
            s, kind = personal()
            if rng.random() < 0.2:
                text += rng.choice(["(", '"', "<", ""])
            spans.append((len(text), len(text) + len(s), kind))
            text += s + rng.choice(["", "", "", ".", ",", ";", "!!", "$$$", "###", '"', ")"])
        elif roll < 0.3:
            text += other()
        else:
            w = word()
            text += (w.upper() if rng.random() < 0.05 else w.capitalize() if rng.random() < 0.15 else w) + rng.choice(["", "", "", "", ",", "."])
        text += rng.choice([" ", " ", " ", " ", " ", " ", "\n", " | "])
    return text, spans


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    """0 outside, 1+2k at the start of kind k, 2+2k inside it."""
    out = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def labelled(n: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of `size` characters of invented texts, and their tags."""
    rng, ids, tags = random.Random(seed), np.zeros((n, size), np.int64), np.zeros((n, size), np.int64)
    for i in range(n):
        text, spans = invented(rng)
        start = max(0, rng.randint(-20, len(text) - size)) if len(text) > size else 0
        t = tags_of(len(text), spans)[start : start + size]
        ids[i, : len(t)], tags[i, : len(t)] = char_ids(text)[start : start + size], t
    return ids, tags


@functools.lru_cache(maxsize=2)
def trained(windows: int = 5000, epochs: int = 7, seed: int = 11) -> Tagger:
    """A tagger trained on this many invented windows; equal arguments give equal taggers."""
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(*labelled(windows, 88, seed), epochs)
    return tagger


# ---- decoding


def windows_of(length: int) -> list[tuple[int, int]]:
    """Windows of WINDOW characters over a whole text, each overlapping the next by OVERLAP; the last ends with the text."""
    out, a = [], 0
    while length - a > WINDOW:
        out.append((a, a + WINDOW))
        a += WINDOW - OVERLAP
    return [*out, (a, length)] if length else out


def runs(tags: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of the tagged stretches."""
    edges = np.flatnonzero(np.diff(tags != 0, prepend=False, append=False))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        t = start
        while t < end:
            k, first = (int(tags[t]) - 1) // 2, t
            t += 1
            while t < end and tags[t] == 2 + 2 * k:
                t += 1
            yield first, t, KINDS[k]


def candidates(length: int, decoded: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, str, float]]:
    """Spans of a text's decoded windows with their scores.

    A window gives the spans that neither of its ends cuts, unless it is the text's end. Where windows
    overlap, their tags are also joined in the middle of the overlap, so a span longer than any
    overlap, or window, comes out of the joined tags.
    """
    out = []
    whole, gains, order = np.zeros(length, np.int64), np.zeros(length, np.float32), sorted(decoded)
    for a, b in order:
        tags, gain = decoded[a, b]
        left, right = (a if a == 0 else a + OVERLAP // 2), (b if b == length else b - OVERLAP // 2)
        whole[left:right], gains[left:right] = tags[left - a : right - a], gain[left - a : right - a]
        out += [(a + s, a + e, k, float(gain[s:e].sum())) for s, e, k in runs(tags) if (s > 0 or a == 0) and (a + e < b or b == length)]
    if len(order) > 1:
        known = {x[:3] for x in out}
        out += [(s, e, k, float(gains[s:e].sum())) for s, e, k in runs(whole) if (s, e, k) not in known]
    return out


def reconciled(found: list[tuple[int, int, str, float]]) -> list[Span]:
    """Of all windows' spans, those without overlap whose scores have the largest sum."""
    spans = sorted({(a, b, k): s for a, b, k, s in sorted(found, key=lambda x: x[3]) if s > 0}.items(), key=lambda x: x[0][1])
    ends = [x[0][1] for x in spans]
    best: list[float] = [0.0]
    take: list[int] = []
    for (a, _, _), s in spans:
        before = int(np.searchsorted(ends[: len(take)], a, "right"))
        take.append(before if best[before] + s > best[-1] else -1)
        best.append(max(best[-1], best[before] + s))
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1][0])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def plausible(s: str, kind: str) -> bool:
    """Whether a span that the model found has at least the parts of its kind, however they are joined."""
    if kind == "email":
        return bool(re.search(r"[^\W_]\W*(?:@|\bat\b)\W*[^\W_]", s, re.IGNORECASE) and re.search(r"[^\W_](?:\.|\x20\.\x20|\W*\bdot\b\W*)[^\W_]{2}", s, re.IGNORECASE))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return is_card(s)
    return 9 <= len(digits_of(s)) <= 15 and not any(c.isalpha() for c in s)


def sane(s: str, kind: str) -> str | None:
    """The kind, or, of a number whose parts are another's, that one; null if they are none's."""
    return next((k for k in (kind, *(("card", "ip", "phone") if kind != "email" else ())) if plausible(s, k)), None)


def batches_of(where: list[tuple[int, tuple[int, int]]]) -> Iterator[list[tuple[int, tuple[int, int]]]]:
    """Windows, shortest first, in batches of about BATCH; those under half a window are apart, so less of what is read is padding."""
    half = sum(2 * (b - a) <= WINDOW for _, (a, b) in where)
    for part in (where[:half], where[half:]):
        n = max(1, round(len(part) / BATCH))
        yield from (x for x in (part[len(part) * k // n : len(part) * (k + 1) // n] for k in range(n)) if x)


def tagged(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """For each text the spans that the model finds, reconciled over the text. It reads all of every text."""
    ids = [char_ids(t) for t in texts]
    where = [(i, w) for i, t in enumerate(texts) for w in windows_of(len(t))]
    decoded: list[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]] = [{} for _ in texts]
    where.sort(key=lambda x: x[1][1] - x[1][0])  # windows of like length share a batch
    for some in batches_of(where):
        codes = np.zeros((len(some), max(b - a for _, (a, b) in some)), np.uint8)
        for row, (i, (a, b)) in enumerate(some):
            codes[row, : b - a] = ids[i][a:b]
        for row, tags, gain in zip(*tagger.decode(codes), strict=True):
            i, (a, b) = some[row]
            if tags[: b - a].any():
                decoded[i][a, b] = tags[: b - a], gain[: b - a]
    out = []
    for t, d in zip(texts, decoded, strict=True):
        found = candidates(len(t), d) if d else []
        out.append(reconciled([(a, b, k, score) for a, b, tag, score in found if (k := sane(t[a:b], tag))]))
    return out


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans: those and what the model adds where no base span is."""
    out = []
    for t, found in zip(texts, tagged(texts, tagger), strict=True):
        own = base_spans(t)
        taken = np.zeros(len(t) + 1 if found else 0, bool)
        for a, b, _ in own if found else []:
            taken[a:b] = True
        added = [s for s in found if not taken[s[0] : s[1]].any()]
        out.append((own, sorted(own + added, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FIELDS = [*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("n_added", pa.int64())]


def find_personal_data(df: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_spans and n_added.

    spans: kind:start:end by start, then kind, comma-joined, in code points, ends exclusive: the
    patterns' matches, and what the tagger adds elsewhere (disguised e-mail addresses, phone numbers
    without +, cards and addresses grouped otherwise), checked for their kind's parts. base_sha256 is the digest of the
    patterns' part of it. The tagger reads all of every text in overlapping windows, whose spans are
    joined and reconciled over the whole text. n_spans counts all spans, n_added those of the tagger.

    A null text counts as empty and has no spans. Rows are searched one by one, none is dropped and
    repeated rows get equal results; columns with one of these names are replaced; an empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    model = tagger or trained()
    kinds = pa.struct(FIELDS)
    schema = "struct<" + ",".join(f"{n}:{'string' if k == pa.string() else 'bigint'}" for n, k in FIELDS) + ">"

    @F.arrow_udf(schema)
    @lean
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for some in slices([batch], size=4 << 20):
                for own, every in all_spans([t or "" for t in some.to_pylist()], model):
                    counts = [sum(k == s[2] for s in own) for k in KINDS]
                    rows.append((*counts, hashlib.sha256(written(own).encode()).hexdigest(), written(every), len(every), len(every) - len(own)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)], fields=list(kinds))

    found = df.withColumn("__pii", search(F.col(text)))
    return found.withColumns({n: F.col(f"__pii.{n}") for n, _ in FIELDS}).drop("__pii")
