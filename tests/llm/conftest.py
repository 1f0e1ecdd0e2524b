import random

import pytest
from pyspark.sql import DataFrame

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string, _id int, _key int, cell int, h int, _doc string, _lines string"


@pytest.fixture
def make(spark):
    """Documents from (id, text) or (id, text, lang, source), with further columns whose names
    are those that an operator might use itself."""

    def of(rows) -> DataFrame:
        full = [(*r, *("en", "s0")[len(r) - 2 :]) if len(r) < 4 else tuple(r) for r in rows]
        return spark.createDataFrame([(i, t, la, so, None if t is None else len(t), 7, "x", None, 1, 2, 3, 4, "d", "l") for i, t, la, so in full], DOCS)

    return of


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, odd characters, and a long text."""
    r = random.Random(5)
    word = lambda: r.choice("alpha beta gamma delta Épsilon zeta eta theta iota kappa".split()) + r.choice(["", "s", "."])
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(4000))
    base = " ".join(word() for _ in range(80))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, base), (5, base), (5, base), (None, base), (6, long), (7, "\n\n"), (8, "x"), (9, "1234 !!"), (10, "nul\x00 byte \x1c sep nbsp"),
        (11, base.upper()), (12, "one two three"), (13, long), (14, None, None, None), (15, base + " more words here", None, "s1"), (-3, base, "fr", "s1"),
    ]
