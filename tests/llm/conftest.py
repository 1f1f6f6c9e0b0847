import os

import pytest

# Workers find the package wherever the tests are started from.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.abspath(os.path.join(os.path.dirname(__file__), "..", "..")), os.environ.get("PYTHONPATH", "")]
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with two extra columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "mine", 7) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Nulls in ids and texts, empty texts, repeated rows, ties, a very long text.
HARD = [
    (None, "a b c d e f"),
    (None, None),
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "a b c d e f"),
    (4, "a b c d e f"),
    (5, "A b C d e F"),
    (6, "x" * 3000 + " y" * 40_000),
    (7, "é" * 60 + " ende"),
    (8, "é" * 60 + " anders"),
]
