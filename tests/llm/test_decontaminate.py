import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate as d

from . import brute


@pytest.fixture(scope="module")
def planted(prose):
    rng = random.Random(3)
    tests = [(k, prose(1000 + k, n)) for k, n in enumerate((40, 25, 10, 9, 3, 1, 12))] + [(20, None), (21, ""), (22, " -- "), (23, prose(1000, 40)), (24, "aa aa aa aa aa aa aa aa aa aa aa aa")]
    docs = []
    for i in range(60):
        w = prose(i, rng.randint(0, 150)).split()
        for _ in range(rng.randint(0, 2)):
            p = (rng.choice(tests)[1] or "").split()
            a = rng.randint(0, max(0, len(p) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = p[a : a + rng.randint(8, 20)]
        docs.append((i, rng.choice([" ", ", ", "-"]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    return [*docs, (100, None), (101, ""), (102, "aa " * 40), (103, prose(7, 20_000) + " " + tests[0][1])], tests


def rows_of(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in df.collect()}


@pytest.mark.parametrize("window", [10, 4, 1])
@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, planted, monkeypatch, window, broadcast):
    monkeypatch.setattr(d, "fits", lambda df: broadcast)
    monkeypatch.setattr(d, "small", lambda df: F.broadcast(df) if broadcast else df)
    docs, tests = planted
    got = rows_of(d.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string"), window))
    want = brute.contamination(docs, tests, window)
    assert got == want and sum(n > 0 for _, n, _ in want.values()) > 10


def test_edges(edge_docs, edge_rows, no_docs, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(d.contamination(edge_docs, none)) == {i: (len(brute.alnum(t)), 0, []) for i, t in edge_rows}
    tests = spark.createDataFrame([("t1", "One", 5), ("t2", "a b", 5), ("t2", "a b", 5), (None, "漢字", 1)], "item_id string, text string, doc_id int")
    got = rows_of(d.contamination(edge_docs, tests))
    assert got[4] == (1, 1, ["t1"]) and got[10] == (2, 2, ["t2"]) and got[8][1] == 1
    assert d.contamination(no_docs, tests).count() == 0


def near_places(docs, tests, window, share, reach):
    """Every stretch of ``reach`` words that begins with a word of the window and holds enough of its words."""
    out = set()
    for item, t in tests:
        w = brute.alnum(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            words = set(w[s : s + window])
            for i, text in docs:
                x = brute.alnum(text)
                out |= {(i, item, tuple(w[s : s + window]), p) for p in range(len(x)) if x[p] in words and len(words & set(x[p : p + reach])) >= share * len(words) - 1e-9}
    return out


@pytest.mark.parametrize("share", [0.8, 0.6, 1.0])
def test_proximity_against_brute_force(spark, planted, share):
    """Passages with words changed, the rarest ones too, put in another order or left out."""
    docs, tests = planted
    rng, more = random.Random(8), []
    for k in range(20):
        w = (tests[k % 3][1]).split()[2:12]
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "other"
        if k % 5 == 0:
            rng.shuffle(w)
        more.append((1000 + k, f"before it {' '.join(w)} behind it"))
    docs = [*docs[:30], *more, (2000, None)]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(tests, "item_id bigint, text string")
    keys = d.keys_of(a, b, 10, share)
    got = d.proximity_matches(d.build_index(a, keys, 11), keys, share, 12)
    found = [(r["doc_id"], r["item_id"], tuple(r["win"]), r["first"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == near_places(docs, tests, 10, share, 12) and found
    phrases = d.phrase_matches(d.build_index(a, keys, 9), keys).select("doc_id").distinct().count()
    assert phrases == sum(n > 0 for _, n, _ in brute.contamination(docs, tests, 10).values())


def test_the_index_holds_rare_terms_only(spark, planted):
    docs, tests = (spark.createDataFrame(x, f"{n} bigint, text string") for x, n in zip(planted, ("doc_id", "item_id"), strict=True))
    wins = d.windows(tests)
    keys = d.keyed(wins, d.term_counts(docs, wins))
    index = d.build_index(docs, keys)
    assert index.select("term").distinct().count() <= keys.select("term").distinct().count() + 1
    assert index.where(F.size("near") > 19).count() == 0


def test_query_is_the_oracle(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(tuple(r) for r in d.query(spark, sf).collect())
    assert got == sorted(con.execute(d.ORACLE).fetchall())
    assert any(r[5] for r in got) and all(len(r[4]) == 64 for r in got)
    assert {r[4] for r in got if not r[5]} == {hashlib.sha256(b"").hexdigest()}
