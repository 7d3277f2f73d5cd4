"""Best-fit packing by sums of squares: each piece goes where the squared counts of open bins per gap become smallest."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, parted, slices, small_batches
from .tokens import pieces_of, tokenizer_path

SPECIAL = "<|endoftext|>"
#: One document of so many is encoded twice, to hold the fast encoder to the library's ids.
CHECKED = 64
#: So many equal pieces go to one group together at most.
LOT = 1 << 10


class Encoder:
    """Ids that `tokenizers` gives for a byte-level vocabulary, made by tiktoken from the same vocabulary's ranks.

    tiktoken needs a fourth of the time; a test holds both against each other. A text that it can't
    take (a run of white space beyond its regex's limits) goes to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = len(ranks)
        self.fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # tiktoken's panics are no Exceptions
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
        return self.whole(text)

    def whole(self, text: str) -> list[int]:
        """The ids as the library gives them."""
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(self.special)
            for piece in pieces_of(part, 1 << 16):
                out += self.plain(piece)
        return out


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: one up to `most`, else full ones after a first that may be shorter."""
    first = n if n <= most else n % most or most
    return [(0, first)] + [(k, most) for k in range(first, n, most)]


def token_pieces(df: DataFrame, path: str, key: str, text: str, most: int, end: int) -> DataFrame:
    """key, piece, start, length, ids_crc32 for each piece of each row of df; null texts are empty and hold the end id alone.

    Ids are made by Encoder; of every CHECKED documents of a task one is encoded by `tokenizers` too,
    and a difference ends the job rather than let a wrong id through.
    """
    small_batches(df.sparkSession)
    name = os.path.basename(path)
    names = [key, "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows = Encoder(path if os.path.exists(path) else tokenizer_path(name)), 0
        for batch in slices(batches, 1):
            found = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(t or "")
                if rows % CHECKED == 0 and ids != encoder.whole(t or ""):
                    raise ValueError(f"document {k}: the fast encoder's ids differ from those of tokenizers")
                rows += 1
                ids = np.array([*ids, end], dtype="<u4")
                for i, (start, n) in enumerate(cuts(len(ids), most)):
                    found.append((k, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lean(cut), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the order given.

    count[g] open bins have the gap g. A piece of length n in a bin of gap g takes one from count[g]
    and gives one to count[g-n]; a new bin gives one to count[most-n]. Full bins aren't counted. Of
    the places that make the sum of count[g]**2 smallest, the one with the smallest gap is taken.
    """
    count = np.zeros(most + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(most + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(map(int, lengths)):
        gaps = count[n:]
        rise = 2 * count[: most - n + 1] + 1  # of the gap that the piece leaves
        rise[0] = 0
        delta = np.where(gaps > 0, rise - 2 * gaps + 1, np.iinfo(np.int64).max)
        delta[-1] = rise[-1]  # gap `most`: a new bin
        g = n + int(np.argmin(delta))
        if g == most:
            b, made = made, made + 1
        else:
            b = open_bins[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, most - g
        if g > n:
            open_bins[g - n].append(b)
            count[g - n] += 1
    return bins, offsets


def packed(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """sum_of_squares(), and again over what lies in bins that it left open, as long as that takes fewer."""
    bins, offsets = sum_of_squares(lengths, most)
    while True:
        fill = np.bincount(bins, lengths, minlength=1)
        loose = fill[bins] < most
        again, places = sum_of_squares(lengths[loose], most)
        if not len(again) or again.max() + 1 >= ((fill > 0) & (fill < most)).sum():
            return bins, offsets
        bins[loose], offsets[loose] = len(fill) + again, places


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = 1024, end: int = 2, group_docs: int = 20_000) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of df.

    A document is its ids and `end`; a longer one than `most` is cut into pieces of `most`, only the
    first of which may be shorter. Pieces are dealt into groups of about `group_docs` documents'
    pieces; a group's pieces are placed from the longest on by packed(), and a group wastes a few
    open bins at its end. No piece is split or dropped.

    Null and empty texts hold the end id alone; rows that repeat or share a key are packed as
    documents of their own; null keys are kept; an empty table gives no rows; other columns are ignored.

    Only the pieces' lengths and checksums are shuffled, never their ids. Equal pieces are counted and
    parted into lots of at most LOT; groups are dealt by hash of a piece's values and its lot's number.
    So no document, key or lot of equal rows fills a group, and a task that is run again, on rows in
    whatever order, sends every piece where it was sent before. The number of groups grows with the rows.
    """
    pieces = token_pieces(df, path, key, text, most, end)
    groups = max(1, -(-df.count() // group_docs))
    names = pieces.columns

    def place(t: pa.Table) -> pa.Table:
        t = t.take(np.repeat(np.arange(len(t)), t["rows"].to_numpy()))
        t = t.sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = packed(t["length"].to_numpy(), most)
        ids = (t["grp"][0].as_py() << 32) + bins
        return t.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    kind = df.schema[key].dataType.simpleString()
    lots = parted(pieces.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count("*").alias("rows")).withColumn("lot", F.lit(0).cast("long")), "rows", "lot", LOT)
    dealt = lots.withColumn("grp", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece", "start", "length", "ids_crc32", "lot"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
