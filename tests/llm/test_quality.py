import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import quality as q
from chronoweave.llm.common import table


@pytest.fixture()
def as_text(monkeypatch):
    """The classifier's answer is the number that the text is."""
    monkeypatch.setattr(q, "with_probability", lambda docs, model, text_col: docs.withColumn("_p", F.coalesce(F.col(text_col).cast("double"), F.lit(0.5))))


@pytest.fixture(scope="module")
def rows():
    import random

    rng, out = random.Random(1), []
    for i in range(200):
        host = rng.choice(["good", "bad", "mixed", None])
        path = rng.choice(["a", "b", None]) if host != "mixed" else f"p{i}"
        p = min(0.99, max(0.01, {"good": 0.8, "bad": 0.2}.get(host, 0.5) + rng.uniform(-0.15, 0.15)))
        out.append((i, str(round(p, 3)), host, path))
    return [*out, (200, None, "single", "x")]


def strength(groups, mean):
    many = [g for g in groups if g["n"] >= 2]
    n, k = sum(g["n"] for g in many), len(many)
    if k < 2 or n <= k:
        return 50.0
    between = sum(g["n"] * (g["s"] / g["n"] - (mean if isinstance(mean, float) else g["prior"])) ** 2 for g in many)
    within = max(sum(g["q"] - g["s"] ** 2 / g["n"] for g in many) / (n - k), 1e-6)
    return min(max(within / max((between - (k - 1) * within) / n, 1e-9), 2.0), 10_000.0)


@pytest.mark.parametrize("broadcast", [True, False])
def test_posteriors_against_loops(spark, rows, monkeypatch, as_text, broadcast):
    monkeypatch.setattr(q, "fits", lambda df: broadcast)
    groups = defaultdict(lambda: {"n": 0, "s": 0.0, "q": 0.0})
    p = {i: float(t or 0.5) for i, t, _, _ in rows}
    for i, _, host, path in rows:
        for key in ((host,), (host, path)):
            g = groups[key]
            g["n"] += 1
            g["s"] += p[i]
            g["q"] += p[i] ** 2
    hosts = {k: g for k, g in groups.items() if len(k) == 1}
    paths = {k: g for k, g in groups.items() if len(k) == 2}
    mean = sum(p.values()) / len(p)
    a = strength(hosts.values(), mean)
    for (host, _), g in paths.items():
        h = hosts[host,]
        g["prior"] = (h["s"] + a * mean) / (h["n"] + a)
    b = strength(paths.values(), None)
    logit = lambda x: math.log(min(max(x, 0.002), 0.998) / (1 - min(max(x, 0.002), 0.998)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in q.score(df, None).collect()}
    assert len(got) == len(rows)
    for i, _, host, path in rows:
        g = paths[host, path]
        rate = (g["s"] - p[i] + b * g["prior"]) / (g["n"] - 1 + b)
        total = logit(p[i]) + q.SITE_WEIGHT * (logit(rate) - logit(mean))
        assert got[i]["path_rate"] == pytest.approx(rate) and got[i]["score"] == pytest.approx(1 / (1 + math.exp(-total)))
        assert got[i]["keep"] == (got[i]["score"] >= q.THRESHOLD)


def test_sparse_sites_shrink_toward_the_whole(spark, rows, as_text):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r["doc_id"]: r["path_rate"] for r in q.score(df, None).collect()}
    mean = sum(float(t or 0.5) for _, t, _, _ in rows) / len(rows)
    good = next(i for i, _, h, p in rows if h == "good" and p == "a")
    assert abs(got[200] - mean) < 0.1 < abs(got[good] - mean)


def test_edges(edge_docs, no_docs, edge_rows, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = q.fit(edge_docs, none)
    got = {r["doc_id"]: r for r in q.score(edge_docs, model).collect()}
    assert len(got) == len(edge_rows) and all(r["keep"] for r in got.values())
    assert set(edge_docs.columns) <= set(got[4].asDict()) and got[6]["text"] == got[7]["text"]
    assert q.score(no_docs, model).count() == 0
    both = spark.createDataFrame([(4, 0), (6, 1), (7, 1), (5, 1), (2, 0)], "doc_id bigint, quality int")
    assert q.score(edge_docs.union(edge_docs), q.fit(edge_docs, both)).count() == 2 * len(edge_rows)
    assert "text" not in q.score(edge_docs, model, keep_text=False).columns


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    got = q.query(spark, sf).where("held_out").join(table(spark, sf, "labels").where("quality is not null"), "doc_id")
    r = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("keep").cast("int"))).alias("bad")).first()
    assert r["good"] > 0.95 and r["bad"] < 0.1
