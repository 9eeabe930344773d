from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, key long, _id string, fp string, words string, id string"


def prose(rng, n, start=0):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: nulls, empty and very long ones, copies, near copies, shared passages, repeats, other scripts."""
    rng = random.Random(5)
    shared, base = prose(rng, 30), prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, base), (6, base), (7, " ".join(near)), (8, base), (8, base), (9, prose(rng, 6000)), (None, base), (None, None)]
    rows += [(10 + i, f"{prose(rng, 40)} {shared} {prose(rng, 40)}") for i in range(8)]
    rows += [(30, "ab " * 400), (31, "the same line of words\n" * 30 + "tail"), (32, "Größe 日本語 😀 é " * 12), (33, "Größe 日本語 😀 é " * 12 + "x"), (34, "a" * 300), (35, "a" * 280 + "b")]
    rows += [(40 + i, prose(rng, rng.randint(0, 60))) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", "z", "w") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
