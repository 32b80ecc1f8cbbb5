import os

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import common, html, linededup, quality, simhash, similar


def held(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith("."))


@pytest.fixture()
def folder(monkeypatch, tmp_path):
    common.release()
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    yield str(tmp_path)


def test_scratch_deletes_all_but_what_is_kept(spark, folder):
    with common.scratch() as s:
        a, b = common.materialize(spark.range(3), "a"), s.keep(common.materialize(spark.range(4), "b"))
        with common.scratch() as inner:
            c = inner.keep(common.materialize(spark.range(5), "c"))
            common.materialize(spark.range(6), "d")
        assert len(held(folder)) == 3 and c.count() == 5 and a.count() == 3
        common.discard(a)
        assert len(held(folder)) == 2
    assert b.count() == 4 and len(held(folder)) == 1
    with pytest.raises(KeyError), common.scratch() as s:
        s.keep(common.materialize(spark.range(3), "e"))
        raise KeyError
    assert len(held(folder)) == 1
    common.release()
    assert held(folder) == []


@pytest.mark.parametrize("run", [
    lambda d: linededup.dedup(d), lambda d: similar.near_duplicates(d), lambda d: simhash.near_duplicates(d),
    lambda d: quality.score(d, quality.QualityModel(None, None, 0.9)), lambda d: html.extract(d, "doc_id", "source", "text"),
])
def test_results_leave_little_and_release_leaves_nothing(spark, folder, prose, run):
    docs = spark.createDataFrame([(k, prose(k % 7, 60), "en", "s") for k in range(20)], "doc_id bigint, text string, lang string, source string")
    out = run(docs)
    assert out.count() == 20 and len(held(folder)) <= 4
    common.release()
    assert held(folder) == []


def test_sizes_are_measured(spark):
    df = spark.createDataFrame([(1, "x" * 1000, ["ab", "c"], [1, 2])], "a bigint, b string, c array<string>, d array<bigint>")
    assert common.fits(df) and common.fits(df, 1200) and not common.fits(df, 1000)
    assert common.fits(df.where("false"), 0)
    assert common.small(df)._jdf.queryExecution().logical().toString().count("broadcast") == 1
    assert not common.fits(df.withColumn("b", F.repeat("b", 1 << 14)))
