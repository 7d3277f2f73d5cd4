"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, small_batches

#: A single blank between two letters or digits: a pre-token always ends before it, on either side's own terms.
SAFE = re.compile(r"(?<=[^\W_])\x20(?=[^\W_])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(text: str, limit: int) -> list[str]:
    """Cut a text at the first safe boundary after each `limit` characters; where there is none, it stays whole."""
    out, start = [], 0
    while len(text) - start > limit:
        m = SAFE.search(text, start + limit)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


class Counter:
    """Counts by the library that a vocabulary file belongs to: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.json = path.endswith(".json")
        if self.json:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, texts: list[str]) -> list[int]:
        if self.json:
            return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(e) for e in self.model.encode(texts, num_threads=1)]


def batch_lengths(counter: Counter, texts: list[str | None], batch_bytes: int, piece_chars: int) -> list[int]:
    """Tokens of each text; the library gets batches of about `batch_bytes`, whatever rows they come from."""
    counts = [0] * len(texts)
    rows: list[int] = []
    batch: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for row, n in zip(rows, counter.lengths(batch), strict=True):
            counts[row] += n
        rows.clear()
        batch.clear()
        held = 0

    for row, text in enumerate(texts):
        # only byte-level files are known to have safe boundaries; others see whole texts
        for piece in pieces_of(text or "", piece_chars) if counter.json else [text or ""]:
            rows.append(row)
            batch.append(piece)
            held += len(piece) if piece.isascii() else len(piece.encode())
            if held >= batch_bytes:
                flush()
    if batch:
        flush()
    return counts


def token_count(text: Column, path: str, batch_bytes: int = 1 << 18, piece_chars: int = 1 << 15) -> Column:
    """Column with the number of tokens of `text`; a null text counts as empty.

    path: a vocabulary file, the same on every executor. piece_chars: byte-level texts longer than
    this are cut at safe boundaries (a blank between two letters or digits), which leaves counts as
    they are for vocabularies whose pre-tokenizer starts a word at its blank, as byte_bpe_50k does.
    """
    name = os.path.basename(path)

    @F.arrow_udf("long")
    @lean
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path if os.path.exists(path) else tokenizer_path(name))
        for texts in batches:
            counts = [n for some in slices([texts]) for n in batch_lengths(counter, some.to_pylist(), batch_bytes, piece_chars)]
            yield pa.array(counts, pa.int64())

    return count(text)


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to any table with a text column.

    Null and empty texts have no bytes and no tokens. Rows are neither merged nor dropped, so
    repeated rows keep their number; an empty table gives an empty table. Columns that already
    have one of the three names are replaced.
    """
    small_batches(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("n_tokens", token_count(whole, path)).withColumn("n_bytes", F.octet_length(whole).cast("long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
