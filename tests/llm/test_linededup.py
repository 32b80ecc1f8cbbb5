import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import linededup as d

from . import brute


def edited(rng, s, n):
    for _ in range(n):
        k, c = rng.randrange(len(s) + 1), rng.choice("abcxyz é漢")
        s = rng.choice([s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :]])
    return s


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_distance(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(300):
        a = "".join(rng.choice("ab漢🙂") for _ in range(rng.randint(0, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, threshold + 2))))
    pairs += [("", ""), ("", "a"), ("a" * 300, "a" * 299 + "b"), ("ab" * 40, "ba" * 40)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = {r["k"] for r in d.verified(df, "a", "b", threshold).select("k").collect()}
    assert got == {k for k, (a, b) in enumerate(pairs) if brute.distance(a, b) <= threshold}


def reworded(rng, s, n):
    """n edits of words: put in, left out, replaced, joined."""
    w = s.split(" ")
    for _ in range(n):
        k = rng.randrange(len(w) - 1)
        w[k : k + 1] = rng.choice([[], [w[k], "new"], ["other"], [w[k] + "x"]])
        if rng.random() < 0.2:
            w[k : k + 2] = ["".join(w[k : k + 2])]
    return " ".join(w)


def left(rows, min_chars=d.MIN_CHARS):
    return brute.lines_left(rows, d.THRESHOLD, min_chars, d.LONG)


@pytest.fixture(scope="module")
def corpus(prose):
    """Lines around the length from which words are compared, edited a little more and a little less than it allows."""
    rng = random.Random(8)
    lines = [prose(k, rng.randint(2, 12)) for k in range(50)] + [prose(100 + k, rng.choice([17, 18, 19, 20, 21, 22, 23, 24, 40, 90])) for k in range(60)]
    rows = []
    for i in range(140):
        mine = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(lines)
            if rng.random() < 0.2:
                line = prose(rng.random(), rng.choice([8, 25]))
            elif rng.random() < 0.7:
                line = reworded(rng, line, rng.randint(0, 6)) if len(line.split(" ")) > 15 and rng.random() < 0.7 else edited(rng, line, rng.choice([0, 1, 2, 3, 4]))
            mine.append(line)
        rows.append((i, "\n".join([*mine, *rng.choice([[], [""], ["short"], ["  "]])])))
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, corpus, monkeypatch, broadcast):
    monkeypatch.setattr(d, "small", lambda df, otherwise=None: F.broadcast(df) if broadcast else df.hint(otherwise))
    got = d.dedup(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3))
    want = left(corpus)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {i: r["text"] for i, r in rows.items()} == want
    for i, t in corpus:
        n = len(t.split("\n"))
        assert rows[i]["n_lines"] == n and rows[i]["n_dropped"] >= 0
    assert sum(r["n_dropped"] for r in rows.values()) > 50


def test_long_lines_by_words(spark, prose):
    """A passage with one word replaced goes; with too many it stays."""
    line = prose(3, 57)
    w = line.split(" ")
    docs = [(1, line), (2, " ".join([*w[:30], "replacement", *w[31:]])), (3, " ".join(w[:10] + w[12:])), (4, " ".join("z" if k % 10 == 0 else x for k, x in enumerate(w)))]
    got = {r["doc_id"]: r["text"] for r in d.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: line, 2: "", 3: "", 4: docs[3][1]}


def test_a_chain_leaves_its_first_line(spark):
    a = "abcdefghijklmnopqrstuvwxyz"
    docs = [(1, a), (2, a[:-2]), (3, a[:-4])]
    assert {r["doc_id"]: r["text"] for r in d.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == {1: a, 2: "", 3: ""}


def test_shorter_minimum(spark):
    docs = [(1, "Les.\nLes.\nOf"), (2, "Les.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in d.dedup(df, min_chars=4).collect()} == {1: "Les.\nOf", 2: ""} == left(docs, 4)
    assert {r["doc_id"]: r["text"] for r in d.dedup(df).collect()} == dict(docs)


def test_edges(edge_docs, edge_rows, no_docs):
    got = {r["doc_id"]: r for r in d.dedup(edge_docs).collect()}
    want = left(edge_rows)
    assert {i: r["text"] for i, r in got.items() if i != 1} == want and got[1]["text"] is None
    assert got[7]["text"] == "" and got[7]["n_dropped"] == 1 and got[6]["n_dropped"] == 0
    assert got[1]["n_lines"] == 0 and got[2]["n_lines"] == 1
    assert set(edge_docs.columns) <= set(got[4].asDict()) and got[4]["_id"] == "x" and got[4]["w"] == [1]
    assert d.dedup(no_docs).count() == 0
    few = d.dedup(edge_docs.select("text", "doc_id"))
    assert {r["doc_id"]: r["text"] for r in few.collect()} == {i: r["text"] for i, r in got.items()}


def test_repeated_rows_are_one_document(spark):
    line = "a line that is long enough to be judged"
    df = spark.createDataFrame([(1, line, "a"), (1, line, "b"), (2, line, "c"), (None, line, "d")], "doc_id bigint, text string, x string")
    got = sorted((r["x"], r["text"]) for r in d.dedup(df).collect())
    assert got[:3] == [("a", line), ("b", line), ("c", "")] and got[3][0] == "d"


def test_no_python_in_the_plan(spark, corpus):
    df = d.dedup(spark.createDataFrame(corpus, "doc_id bigint, text string").where(F.col("doc_id") >= 0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
