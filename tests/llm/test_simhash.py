import random

import pytest

from chronoweave.llm import components, simhash

from . import brute


def test_fingerprints(edge_rows, prose):
    for k in (4, 5, 1):
        for _, t in [*edge_rows, *[(0, prose(s, 3 + s)) for s in range(20)], (0, "A b\x0bC\x0cd  e f g h")]:
            assert simhash.fingerprint(t, k) == brute.fingerprint(t, k)


@pytest.mark.parametrize("most,segments", [(4, 3), (5, 3), (4, 2), (1, 2), (0, 1), (7, 4)])
def test_links_are_all_pairs_once(spark, most, segments):
    rng, fps = random.Random(most), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for n in range(9):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            fps.add(simhash.signed(y))
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f, i) for i, f in rows], "fp bigint, node bigint")
    got = sorted((min(r), max(r)) for r in simhash.links(df, most, segments).collect())
    assert got == [(i, j) for i, f in rows for j, g in rows if i < j and (((f ^ g) & (2**64 - 1)).bit_count()) <= most]


@pytest.mark.parametrize("shape", ["chain", "star", "ring", "random", "none", "loops"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {
        "chain": [(k, k + 1) for k in range(60)], "star": [(50, k) for k in range(40)], "ring": [(k, (k + 1) % 30) for k in range(30)], "none": [], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    }[shape]
    nodes = {x for p in links for x in p}
    want = {k: v for k, v in brute.roots(nodes, links).items() if k != v}
    got = components.components(spark.createDataFrame(links, "u bigint, v bigint"))
    assert {r["u"]: r["v"] for r in got.collect()} == want


def test_near_duplicates_of_edges(edge_docs, edge_rows, no_docs, prose):
    want = brute.simhash(edge_rows, 4, 4)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(edge_docs).collect()}
    assert got == want and got[1] == (0, 1) and got[3][1] == 1 and got[7][1] == 6
    assert simhash.near_duplicates(edge_docs.union(edge_docs)).count() == 2 * len(edge_rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_against_all_pairs(spark, prose):
    rng, rows = random.Random(1), []
    for s in range(25):
        words = prose(s, 120).split()
        for c in range(4):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = "changed"
            rows.append((s * 4 + c, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5, distance=5).collect()
    want = brute.simhash(rows, 5, 5)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}
    assert len(set(c for _, c in want.values())) < 90


def test_two_segments_find_the_same(spark, prose, monkeypatch):
    rows = [(i, prose(i // 3, 60) + " more" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(tuple(r) for r in simhash.near_duplicates(df).collect())
    monkeypatch.setattr(simhash, "TWO_SEGMENTS_FROM", 1)
    assert sorted(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
