import pytest

#: id, text: null, empty, short, repeated rows, ties, a long text, letters beyond ASCII.
ODD = [
    (1, None),
    (2, ""),
    (3, "a"),
    (3, "a"),
    (4, "Ab  cd\tef gh"),
    (5, "Ab  cd\tef gh"),
    (6, "12 34 !? —"),
    (7, "Été naïve 漢字 \U0001f600 word"),
    (8, "word " * 30_000),
    (9, "line one\nline two\n\nline one"),
    (None, "no id at all"),
]

#: Names that the operators use inside or give to their results, and names that need quoting.
CLASHING = ["_site", "_host", "_drop", "_line", "_lines", "_kept", "_short", "n_lines", "n_dropped", "score", "lang_pred", "text_", "_text_", "id", "_id", "again", "found", "doc", "kept", "_label", "label", "n", "r", "most", "least", "component_id", "a.b", "c`d"]


@pytest.fixture
def odd(spark):
    """Documents with odd rows and extra columns whose names may clash with inner ones."""
    rows = [(i, t, None, "s", None, "r", 1, 2, *range(len(CLASHING))) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, role string, fp long, _b int, " + ", ".join("`" + c.replace("`", "``") + "` int" for c in CLASHING))


@pytest.fixture
def empty(odd):
    return odd.limit(0)
