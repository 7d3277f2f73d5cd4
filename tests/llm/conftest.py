import pytest

SCHEMA = "doc_id long, text string, source string, n_chars long"
#: Null and empty texts, ties, repeated rows, other scripts, white space of all kinds, one text of a single long run.
TEXTS = [
    None, "", " \t ", "one", "Same text here.\nAnd more of it, in two lines.", "Same text here.\nAnd more of it, in two lines.", "ÄÖ ü — naïve \U0001f600 text. Ends.", "a\x0bb\x0cc\rd\x85e\xa0f", "x" * 5000, "word " * 400,
    "\n\n\n", "# Head\n\nBody one.\nBody two.\n\n# Next\nMore.", "<|im_end|> \\ <\\| \\\\", "A" * 45 + "\n" + " " + "a" * 45 + " ",
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "s0", 3), (-7, "Negative id.", "", 12), (1 << 40, "Far id.", "s1", 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
