import pytest
from pyspark.sql import functions as F

from chronoweave.llm import licenses

from . import brute

PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


@pytest.fixture(scope="module")
def rows(prose):
    notice = licenses.NOTICES[0].text.split()
    cut = [w for k, w in enumerate(notice) if k % 12 != 5]  # words left out
    more = notice[:10] + ["really"] + notice[10:]
    return [
        (1, "Released UNDER the MIT-License; under the mit license."), (2, "apache license, version 2.0 and CC BY-NC"), (3, "cc by nc cc by nc by nc"), (4, "under the mit"), (5, None), (6, ""),
        (7, " ".join([*prose(1, 50).split(), *cut, "end"])), (8, " ".join(more)), (9, " ".join(notice[:12])), (10, "all rights reserved"), (11, prose(2, 20_000) + " under the mit license"),
        (12, "the mit license under"), (13, "Under The Mit Licensé"), (14, "under\x00the\x7fmit license"),
    ]


def test_base_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, label string, pos string").repartition(3)
    got = {r["doc_id"]: r for r in licenses.report(df).collect()}
    for i, t in rows:
        n, places = brute.base_places(t, PHRASES)
        r, at = got[i], sorted(s for _, s in places)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), at[0] if at else None, at[-1] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for x, _ in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[7]["labels"] == "mit" and got[8]["labels"] == "mit" and got[8]["score"] > 0.8 and got[9]["labels"] == ""
    assert got[10]["labels"] == "proprietary" and got[10]["n_base"] == 0


def test_spans_say_where(spark, rows):
    spans = licenses.scan(spark.createDataFrame([r for r in rows if r[0] in (6, 7, 8)], "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in spans.where("template >= 3").collect()}
    assert got[7]["first"] == 50 and got[8]["first"] == 0 and got[8]["last"] == len(licenses.NOTICES[0].text.split())
    assert got[7]["label"] == "mit" and not got[7]["exact"] and set(got) == {7, 8}


def test_one_id_with_two_texts(spark):
    """Votes of one text don't help another, and each row has its own row."""
    rows = [(1, "foo under the mit bar"), (1, "foo xx the mit license zz"), (1, "under the mit license"), (None, "cc by nc"), (None, None), (2, "x"), (2, "x")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["labels"]) for r in licenses.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect())
    assert got == [(0, 0, 0, ""), (0, 3, 1, "cc-by-nc"), (1, 4, 1, "mit"), (1, 5, 0, ""), (1, 6, 0, ""), (2, 1, 0, ""), (2, 1, 0, "")]


def test_votes_are_verified_by_their_words(spark, monkeypatch):
    """With a hash that maps all words to one value only true places are left."""
    real = F.xxhash64
    monkeypatch.setattr(licenses.F, "xxhash64", lambda *c: real(*c) if len(c) == 1 else F.when(real(*c).isNotNull(), F.lit(5).cast("long")) if len(c) == 3 else real(*c))
    got = licenses.report(spark.createDataFrame([(1, "a b c under the mit license d e f g")], "doc_id bigint, text string")).first()
    assert (got["n_base"], got["first_word"], got["labels"]) == (1, 3, "mit")


def test_long_templates_take_several_masks(spark, prose):
    text = prose(5, 200)
    mine = (licenses.Template("long", text),)
    words = text.split()
    docs = [(1, "x " + text + " y"), (2, " ".join(words[:100])), (3, " ".join(words[:70] + words[90:]))]
    got = {r["doc_id"]: r for r in licenses.report(spark.createDataFrame(docs, "doc_id bigint, text string"), (), mine).collect()}
    assert got[1]["score"] == 1 and got[1]["labels"] == "long" and got[2]["labels"] == ""
    assert len(licenses._masks(F.lit(1), mine[0].size)) == 4


def test_edges(edge_docs, edge_rows, no_docs):
    got = {r["doc_id"]: r for r in licenses.report(edge_docs).collect()}
    assert {i: r["n_words"] for i, r in got.items()} == {i: len(brute.alnum(t)) for i, t in edge_rows}
    assert licenses.report(no_docs).count() == 0
    assert licenses.report(edge_docs.union(edge_docs)).count() == 2 * len(edge_rows)


def test_own_templates(spark):
    mine = (licenses.Template("own", "you may copy this text freely", True),)
    got = licenses.report(spark.createDataFrame([(1, "you may copy this text freely")], "doc_id bigint, text string"), mine, ()).first()
    assert (got["base_labels"], got["first_word"], got["score"]) == ("own", 0, 1.0)
