import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n invented words, the common ones common."""
    rng = random.Random(5)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(words[min(int(r.expovariate(0.012)), 399)] for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edge_rows(prose):
    """doc_id, text: nulls, empty and blank texts, one word, a very long text, copies, ties, letters beyond ASCII."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(1, 30_000)), (6, prose(2, 80)), (7, prose(2, 80)), (8, "Éé ßẞ İı 漢字 🙂   é"), (9, "\x00\x07 a\x00b"),
        (10, "a\n\n\nb\n"), (11, "x" * 50_000), (12, "[|]{}<>&amp; \\ \" '"), (-5, "negative id"), (2**60, "large id"), (13, "﻿​  nbsp　wide"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """edge_rows with the other columns of documents, NULL in places, and extra columns named like the operators' own."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", None, 1.0, 2, "x", [1]) for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words int, _id string, w array<int>").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def sf():
    import os

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("needs the driver's tables")
    return at
