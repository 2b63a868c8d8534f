import random

import pytest
from hypothesis import settings

settings.register_profile("same", derandomize=True, deadline=None)
settings.load_profile("same")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty, blank and very long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(5)
    shared, base = passage(rng, 70), passage(rng, 120)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two words"), (5, passage(rng, 40_000)), (None, base), (6, base), (7, base), (7, base), (8, base.upper()), (9, shared), (10, f"{passage(rng, 30)} {shared} {passage(rng, 20)}"), (11, f"{passage(rng, 10)} {shared}"), (3, "another one"), (None, None)]
    for k in range(12):
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(3))
        rows.append((20 + k, " ".join(w)))
    rows += [(40 + k, f"é à {passage(rng, 60)}\n\nzwei  Wörter\tß 日本 {passage(rng, 5)}!") for k in range(5)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en" if t else None, None, None if t is None else len(t), "x", 1, 2.0, [1]) for i, t in odd_rows]
    return spark.createDataFrame(rows, f"{SCHEMA}, id string, v int, label double, bands array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
