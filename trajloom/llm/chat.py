"""Chat formatting with Spark expressions only: sorted turn structs, merged blocks, reversible escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajloom.functions.text import let

#: Code points of the pieces by which a long string is cut, and lengths that are summed up in one go.
PIECE, STRETCH = 256, 64
#: The template: a block is START role newline text [NEXT text]* END newline.
START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"


def escape(c: Column) -> Column:
    r"""Double every backslash, then write "<|" as "<\|": no control string is left and unescape() gets the text back."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    r"""As escape(), with line feeds as "\n", since a line feed ends the role."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column, role: bool = False) -> Column:
    """Undo escape(): between doubled backslashes, a single one belongs to a mark."""

    def part(p: Column) -> Column:
        p = F.replace(p, F.lit("<\\|"), F.lit("<|"))
        return F.replace(p, F.lit("\\n"), F.lit("\n")) if role else p

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted string, loss_runs array<struct<chars int, loss boolean>>, n_blocks long.

    Turns are sorted by (turn, role, text), nulls first, so ties have one order; adjacent turns of one
    role share a block. loss_runs cuts `formatted` from its start into runs of code points; those with
    loss=true are the escaped texts of `loss_role`. A null role or text counts as empty; rows with a
    null conversation form one conversation; repeated rows stay; an empty table gives no rows. Other
    columns are ignored. A conversation is one output string, so its turns meet in one task.
    """
    s = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    s = s.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    size = F.size("ts")
    at = lambda i: F.get("ts", i)["role"]
    first = lambda t, i: (i == 0) | (t["role"] != F.coalesce(at(i - 1), F.lit("")))
    last = lambda t, i: (i == size - 1) | (t["role"] != F.coalesce(at(i + 1), F.lit("")))
    s = s.withColumn(
        "parts",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                F.when(first(t, i), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(NEXT)).alias("head"),
                escape(t["text"]).alias("body"),
                F.when(last(t, i), F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"),
                (t["role"] == loss_role).alias("loss"),
            ),
        ),
    )
    run = lambda c, loss: F.struct(F.char_length(c).alias("chars"), loss.alias("loss"))
    runs = F.flatten(F.transform("parts", lambda p: F.array(run(p["head"], F.lit(False)), run(p["body"], p["loss"]), run(p["tail"], F.lit(False)))))
    return s.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.filter(runs, lambda r: r["chars"] > 0).alias("loss_runs"),
        F.size(F.filter("parts", lambda p: p["tail"] != "")).cast("long").alias("n_blocks"),
    )


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Parse format_chats() strings: adds turns array<struct<role,text>> as they were, in order."""
    blocks = F.slice(F.split(F.col(column), r"<\|im_start\|>"), 2, F.lit(1 << 30))

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        rest = F.substr(b, F.char_length(head) + 2, F.char_length(b) - F.char_length(head) - 1 - len(END + "\n"))
        return F.transform(F.split(rest, r"<\|im_next\|>"), lambda x: F.struct(unescape(head, role=True).alias("role"), unescape(x).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def starts_of(lengths: Column) -> Column:
    """Where each of the lengths laid end to end starts. Sums run within stretches and over them, so no long array is copied for each element."""

    def sums(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    long = lambda x: x.cast("long")
    total = lambda xs: F.aggregate(xs, long(F.lit(0)), lambda a, x: a + x)
    numbers = lambda xs: F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int"))
    stretches = lambda xs: F.transform(numbers(xs), lambda i: F.slice(xs, i * STRETCH + 1, STRETCH))
    within = lambda xs, start: F.slice(sums(xs, start), 1, F.size(xs))
    each = lambda parts: let(sums(F.transform(parts, total), long(F.lit(0))), lambda begin: F.flatten(F.transform(parts, lambda xs, i: within(xs, F.get(begin, i)))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(F.transform(lengths, long), lambda xs: let(stretches(xs), each)))


def loss_text(formatted: Column, loss_runs: Column) -> Column:
    """What a formatted string says under its loss mask, without escapes: the runs with loss=true in order, nothing between.

    Nothing but the mask decides what is cut. The string is taken apart into pieces once, and a run is
    cut from the few pieces that it lies in, so the time doesn't grow with runs times length.
    """

    def cut(pieces: Column, at: Column, chars: Column) -> Column:
        first, last = F.floor(at / PIECE).cast("int"), F.floor((at + chars - 1) / PIECE).cast("int")
        return F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (at - first.cast("long") * PIECE + 1).cast("int"), chars)

    def said(pieces: Column) -> Column:
        placed = F.zip_with(loss_runs, starts_of(F.transform(loss_runs, lambda r: r["chars"])), lambda r, at: F.struct(r["loss"].alias("loss"), r["chars"].alias("chars"), at.alias("at")))
        return F.array_join(F.transform(F.filter(placed, lambda r: r["loss"]), lambda r: unescape(cut(pieces, r["at"], r["chars"]))), "")

    return let(F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}+" % PIECE), F.lit(0)), said)  # noqa: UP031
