import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, shard int, keep_id long"


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids, clashing column names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, line = text(120), "This very line is in many documents, word for word."
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, base), (5, base.upper()), (6, base.replace(" ", "  ")), (7, base + " more"), (7, base + " more"), (8, text(30_000))]
    rows += [(None, base), (None, None), (10, "one two"), (11, "One TWO"), (12, "é ñ 漢字   x"), (13, f"{line}\n{text(8)}\n{line} "), (14, f"{text(5)}\n  {line}"), (15, line.upper())]
    rows += [(20 + i, text(40) + (f"\n{line}" if i % 2 else "")) for i in range(12)]
    rows += [(40, "12345 !!! 67"), (41, "a\r\nb\x0bc\x0cd"), (10**12, "big id, small text")]
    return [(i, t, "en", "s", None, "x", 5, 6) for i, t in rows]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
