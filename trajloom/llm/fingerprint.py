"""Document fingerprints: Merkle trees over phrases, paragraphs and sections, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajloom.functions.text import let

#: A word with the white space around it, cut at 64 code points; a stretch without words is one too.
WORD = r"\s*+\S{1,64}+\s*+|\s++"
#: A phrase: one to four words. It ends early after a word with one of these at its end, so that borders follow the content.
ENDS = "dgkmpvwxyz0-9.,;:!?"
PHRASE = rf"\s*+(?:(?:\S{{1,64}}+(?<![{ENDS}])\s*+){{1,3}}+(?:\S{{1,64}}+\s*+)?+|\S{{1,64}}+\s*+)|\s++"
#: In paragraphs under so many code points every word is a phrase.
SHORT = 64
#: Hex digits that are stored of a phrase's digest and of a paragraph's or section's; parents are made from whole digests.
PHRASE_HEX, NODE_HEX = 8, 16
#: A paragraph ends its section if its digest starts with 0 (one of 16), so that section borders follow the content.
SECTION_END = "0"


def phrases_of(line: Column) -> Column:
    """The phrases of a line, cut where its content says so: an insertion changes phrases up to the next such cut, and no later one."""
    return F.when(F.char_length(line) < SHORT, F.regexp_extract_all(line, F.lit(WORD), F.lit(0))).otherwise(F.regexp_extract_all(line, F.lit(PHRASE), F.lit(0)))


def paragraph(text: Column) -> Column:
    """Digest and phrase digests of a paragraph, as one string: 64 hex digits, then PHRASE_HEX for each phrase."""
    leaves = F.array_join(F.transform(phrases_of(text), lambda p: F.left(F.sha2(p, 256), F.lit(PHRASE_HEX))), "")
    return F.concat(F.sha2(text, 256), leaves)


def fingerprint(text: Column) -> Column:
    """The tree as a string: root:section;section;..., a section being its digest and its paragraphs, with commas between.

    Paragraphs are the lines of the text. A section ends before a heading (a line that starts with #)
    or an empty line, and after a paragraph whose digest says so. The root is the SHA-256 of the
    sections' digests, these of their paragraphs', these of the paragraphs' texts, each whole (256
    bits), so equal roots mean equal texts. Of inner digests only a part is stored: from a differing
    root the differing sections, paragraphs and phrases are found by descending. A null text counts
    as empty; texts differ if any character does.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def node(line: Column) -> Column:
        opens = F.when(line.startswith("#") | (line == ""), F.lit("\n")).otherwise(F.lit(""))
        return let(paragraph(line), lambda own: F.concat(opens, own, F.when(own.startswith(SECTION_END), F.lit("\n")).otherwise(F.lit(","))))

    nodes = F.array_join(F.transform(lines, node), "")
    sections = F.transform(F.filter(F.split(nodes, "\n"), lambda s: s != ""), lambda s: F.split(F.rtrim(s, F.lit(",")), ","))

    def section(paragraphs: Column) -> Column:
        own = F.sha2(F.array_join(F.transform(paragraphs, lambda p: F.left(p, F.lit(64))), ""), 256)
        stored = F.transform(paragraphs, lambda p: F.concat(F.left(p, F.lit(NODE_HEX)), F.substr(p, F.lit(65))))
        return F.concat(own, F.lit(","), F.array_join(stored, ","))

    def tree(tops: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(tops, lambda s: F.left(s, F.lit(64))), ""), 256)
        return F.concat(root, F.lit(":"), F.array_join(F.transform(tops, lambda s: F.concat(F.left(s, F.lit(NODE_HEX)), F.substr(s, F.lit(65)))), ";"))

    return let(F.transform(sections, section), tree)


def root(tree: Column) -> Column:
    return F.left(tree, F.lit(64))


def sections_of(tree: Column) -> Column:
    return F.split(F.substr(tree, F.lit(66)), ";")


def paragraphs_of(sections: Column) -> Column:
    """The paragraphs of sections; a section's own digest ends with its first comma."""
    return F.flatten(F.transform(sections, lambda s: F.slice(F.split(s, ","), 2, F.lit(1 << 30))))


def leaves_of(paragraphs: Column) -> Column:
    """The phrase digests of paragraphs, in order."""
    leaf = lambda p: F.regexp_extract_all(F.substr(p, F.lit(NODE_HEX + 1)), F.lit("[0-9a-f]{%d}" % PHRASE_HEX), F.lit(0))  # noqa: E731, UP031
    return F.flatten(F.transform(paragraphs, leaf))


def n_leaves(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + ((F.length(p) - NODE_HEX) / PHRASE_HEX).cast("int"))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add `name`: the part of both trees' phrases that they share, 0 to 1, found by descending from the roots.

    Equal roots: 1. Else sections in both trees count as shared with all they hold, the paragraphs of
    the others are compared, and only paragraphs of one tree alone are opened. Of their phrases those are
    shared that stand in both or, if that gives more (as in texts that repeat themselves), at equal
    places. What repeats in a tree counts once on each level. Null where a fingerprint is.
    """
    cols = ("__sx", "__sy", "__px", "__py", "__qx", "__qy", "__same")
    out = df.withColumns({"__sx": F.array_distinct(sections_of(F.col(a))), "__sy": F.array_distinct(sections_of(F.col(b)))})
    out = out.withColumns({
        "__px": F.array_distinct(paragraphs_of(F.array_except("__sx", "__sy"))),
        "__py": F.array_distinct(paragraphs_of(F.array_except("__sy", "__sx"))),
        "__same": n_leaves(paragraphs_of(F.array_intersect("__sx", "__sy"))),
    })
    out = out.withColumns({
        "__qx": leaves_of(F.array_except("__px", "__py")),
        "__qy": leaves_of(F.array_except("__py", "__px")),
        "__same": F.col("__same") + n_leaves(F.array_intersect("__px", "__py")),
    })
    x, y, same = F.col("__qx"), F.col("__qy"), F.col("__same")
    part = lambda n, of: F.when(of + same == 0, F.lit(0.0)).otherwise((2.0 * n + 2.0 * same) / (of + 2 * same))
    sets = part(F.size(F.array_intersect(x, y)), F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)))
    short = F.least(F.size(x), F.size(y))
    placed = F.zip_with(F.slice(x, 1, short), F.slice(y, 1, short), lambda p, q: p == q)
    places = part(F.size(F.filter(placed, lambda e: e)), F.size(x) + F.size(y))
    equal = root(F.col(a)) == root(F.col(b))
    return out.withColumn(name, F.when(equal, F.lit(1.0)).when(equal.isNotNull(), F.greatest(sets, places))).drop(*cols)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) of b's paragraphs that a doesn't have: an edit's location. Empty where the roots are equal."""
    # sections that a has too are passed over, and a paragraph's stored digest says whether a has it
    have = F.transform(paragraphs_of(F.array_except(sections_of(a), sections_of(b))), lambda p: F.left(p, F.lit(NODE_HEX)))
    known = sections_of(a)
    own = F.flatten(F.transform(sections_of(b), lambda s: F.transform(F.slice(F.split(s, ","), 2, F.lit(1 << 30)), lambda p: F.when(F.array_contains(known, s), F.lit("")).otherwise(F.left(p, F.lit(NODE_HEX))))))
    places = F.transform(own, lambda p, i: F.when((p == "") | F.array_contains(have, p), F.lit(-1)).otherwise(i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: i >= 0))


#: Bits by which groups of ids grow from level to level; together all 64.
LEVELS = (10, 13, 13, 14, 14)


def successors(ids: DataFrame) -> DataFrame:
    """ids: real boolean, id long, distinct; adds `next`, the struct of the two that follows in order, the smallest for the largest.

    Ids are grouped by their leading bits, and a group's last one takes the first of the next group,
    found alike among the groups: no window has over 2**14 rows, however the ids are spread, and
    each level has a row for each group of the one below.
    """

    def level(rows: DataFrame, k: int) -> DataFrame:
        """rows: real, g (group), first (its least member); adds next: the least one after the group."""
        if k == len(LEVELS):  # three groups at most: what isn't real, ids below zero, and the others
            by = Window.orderBy("real", "g")
            return rows.withColumn("next", F.coalesce(F.lead("first").over(by), F.first("first").over(by)))
        rows = rows.withColumn("up", F.shiftright("g", LEVELS[k]))
        above = level(rows.groupBy("real", F.col("up").alias("g")).agg(F.min("first").alias("first")), k + 1)
        near = rows.withColumn("near", F.lead("first").over(Window.partitionBy("real", "up").orderBy("g")))
        far = above.select("real", F.col("g").alias("up"), F.col("next").alias("far"))
        return near.join(far, ["real", "up"]).select("real", "g", "first", F.coalesce("near", "far").alias("next"))

    return level(ids.select("real", F.col("id").alias("g"), F.struct("real", "id").alias("first")), 0).select("real", F.col("g").alias("id"), "next")


def edited_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint for each row of df.

    `edited` is the text with its last floor(n_chars/4) code points replaced by the first as many (or
    all) of the next document's, in ascending order of the key; after the last comes the first. Null
    texts are empty. Rows that share a key have the same next document, and the first of them by text
    is the one that stands before the next; rows with a null key are one such group, before all
    others. A table of one key is its own next. Other columns are ignored.

    Texts are shuffled once, by key; of a document, at most the part that its neighbour takes goes to
    it. Rows that share a key meet in one task: keys are taken for about distinct.
    """
    # a key is (real, id): a null one is (false, 0), and so before all others
    docs = df.select(F.col(key).isNotNull().alias("real"), F.coalesce(F.col(key), F.lit(0)).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select("real", "id", F.char_length("text").alias("n")).groupBy("real", "id").agg(F.max("n").alias("n"))
    wanted = successors(ids.select("real", "id")).join(ids, ["real", "id"])
    wanted = wanted.select(F.col("real").alias("for_real"), F.col("id").alias("for"), "next.real", "next.id", F.expr("cast(n div 4 as int)").alias("quarter"))
    # both uses of this exchange need the same columns, so that Spark makes it once
    docs = docs.repartition("real", "id")
    leads = docs.withColumn("rn", F.row_number().over(Window.partitionBy("real", "id").orderBy("text"))).filter("rn = 1")
    heads = leads.join(wanted, ["real", "id"]).select(F.col("for_real").alias("real"), F.col("for").alias("id"), F.expr("left(text, quarter)").alias("head"), fingerprint(F.col("text")).alias("next_fingerprint"))
    both = docs.join(heads, ["real", "id"])
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("q", F.expr("n_chars div 4").cast("int"))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - q), left(head, q))"))
    return both.select(F.when(F.col("real"), F.col("id")).cast(df.schema[key].dataType).alias(key), F.col("text").alias(text), "n_chars", "edited", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
