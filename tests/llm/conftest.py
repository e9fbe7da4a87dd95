import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, anchor long, text_a string"


def words(rng, n, size=60):
    return " ".join(rng.choice(["".join(rng.choice("abcdeghinorst") for _ in range(k % 7 + 1)) for k in range(size)]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Hard cases: nulls, empty and long texts, copies, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = "a passage of more than a hundred bytes that several of these documents share with each other, word for word, and no less"
    line = "This very line is found in MANY documents."
    out = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "short"), (6, "short"), (7, f"x {passage} y\n{line}"), (8, f"{passage}{passage}\n  {line.upper()}\t\nend"), (9, f"{line}\n{line}"),
        (10, "naïve Ünïcödé ▁ text\r\n中文字 😀\n\n  double  spaces "), (11, "ab" * 400), (12, "\n\n\n"), (13, " "), (14, words(rng, 4000, 300)), (15, "<s> 'll it's 12 3.5 ñandú\x1c\x00 end"),
        (20, words(rng, 300)), (20, words(rng, 5)), (21, "same row"), (21, "same row"), (-3, "negative id " * 12), (10**12, "far id " * 20), (None, base),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None, "clash", "clash", k, "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
