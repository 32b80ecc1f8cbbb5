"""Every operator over rows with null ids and columns that carry the names the operators use inside."""

import pytest

from chronoweave.llm import bpe, decontaminate, html, jpeg, langid, licenses, linededup, quality, simhash, similar, toxicity

NAMES = "s n a prior _p _salt _salt2 c0 c1 keep score p_doc path_rate _host _path fp node u v root least h pos term near at _id _th _w _no _key _lines _text rows template span component_id first hs word tpos".split()


@pytest.fixture(scope="module")
def odd(spark, prose):
    texts = [prose(k, 60) for k in range(6)]
    rows = [(k if k < 5 else None, t, "en", "src") for k, t in enumerate(texts)]
    rows += [(None, None, None, None), (None, "", "de", "src"), (7, texts[5], None, "src"), (8, texts[5] + " more", "en", None), (2**40, None, "en", "src")]
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in NAMES)).repartition(3).cache()


LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None)]
RUNS = {
    "bpe": lambda d, labels, tests: bpe.round_trip(d),
    "bpe encode": lambda d, labels, tests: bpe.encode(d),
    "jpeg": lambda d, labels, tests: jpeg.media(d),
    "langid": lambda d, labels, tests: langid.predict(d, langid.fit(d)),
    "html": lambda d, labels, tests: html.extract(d, "doc_id", "source", "text"),
    "toxicity": lambda d, labels, tests: toxicity.score(d, toxicity.fit(d, labels)),
    "licenses": lambda d, labels, tests: licenses.report(d),
    "quality": lambda d, labels, tests: quality.score(d, quality.fit(d, labels)),
    "quality kept": lambda d, labels, tests: quality.kept(d, quality.QualityModel(None, None, 0.9)),
    "simhash": lambda d, labels, tests: simhash.near_duplicates(d),
    "line dedup": lambda d, labels, tests: linededup.dedup(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_each_row_has_a_row(spark, odd, name):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    tests = spark.createDataFrame([(1, "x y")], "item_id bigint, text string")
    got = RUNS[name](odd, labels, tests)
    assert got.count() == odd.count()
    if name == "quality kept":
        assert got.columns == odd.columns and {r["_p"] for r in got.collect()} == {NAMES.index("_p")}
    if name == "quality":
        assert {r["prior"] for r in got.collect()} == {NAMES.index("prior")}


def test_ids_are_keys_of_documents(spark, odd):
    """Decontamination takes the rows of an id together, those without one too."""
    got = {r["doc_id"]: r["n_words"] for r in decontaminate.contamination(odd, spark.createDataFrame([(1, "x y")], "item_id bigint, text string")).collect()}
    assert got[None] == 60 and len(got) == odd.select("doc_id").distinct().count()


def test_null_ids_link_others(spark, prose):
    t = prose(1, 80)
    docs = spark.createDataFrame([(None, t), (5, t), (3, t), (None, prose(2, 70))], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"] or r["component_id"])
    assert got == [(0, 3), (3, 3), (5, 3)]
    got = similar.near_duplicates(docs.where("doc_id is not null")).collect()
    assert {r["component_id"] for r in got} == {3}
