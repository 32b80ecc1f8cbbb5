"""The pipeline against the plain version of each stage, stage by stage on what the stage before has left."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from chronoweave.llm import bpe, linededup, quality  # noqa: E402
from chronoweave.llm.common import table  # noqa: E402

from . import brute  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    """Good and bad documents, copies, near copies, repeated lines, benchmark passages, nulls."""
    rng, docs, labels = random.Random(6), [], []
    tests = [(k, prose(900 + k, 30)) for k in range(5)]
    shared = [prose(800 + k, 12) for k in range(4)]
    for i in range(300):
        if i % 6 == 5:
            text = " ".join("#$%|" * 3 + str(rng.random()) for _ in range(40))
        else:
            lines = [prose(i * 10 + k, 25) + "." for k in range(4)]
            if i % 4 == 0:
                lines.insert(2, rng.choice(shared))
            if i % 10 == 1:
                lines.append(tests[i % 5][1])
            text = "\n".join(lines)
        labels.append((i, 0 if i % 6 == 5 else 1, 0))
        docs.append((i, text, rng.choice(["en", None]), f"src{i % 3}", len(text)))
    for i in range(300, 330):  # exact copies, and near ones with a word added
        t = docs[i - 300][1] + (" word" if i % 2 else "")
        docs.append((i, t, None, None, len(t)))
    docs += [(400, None, None, None, None), (401, "", "en", "src0", 0)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(tests, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), tests


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_each_stage(spark, folder):
    at, tests = folder
    docs = table(spark, at, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        out = stage(spark, docs, at)
        if k < 4:
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        got = out.cache()
        if name == "quality classifier":
            keep = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, table(spark, at, "labels"))).where("keep").collect()}
            assert texts(got) == [x for x in before if x[0] in keep]
            assert {i for i in range(300) if i % 6 != 5} <= keep and not {i for i in range(300) if i % 6 == 5} & keep
        elif name == "line dedup":
            left = brute.lines_left(before, linededup.THRESHOLD, linededup.MIN_CHARS, linededup.LONG)
            assert texts(got) == [(i, left.get(i)) for i, _ in before]
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())
            assert sum(len(t or "") for _, t in before) > sum(len(t or "") for _, t in texts(got))
        elif name == "SimHash near-dedup":
            of = brute.similar(before, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)
            assert texts(got) == [x for x in before if of[x[0]] == x[0]] and len(before) > got.count()
        elif name == "benchmark decontamination":
            found = brute.contamination(before, tests, 10)
            assert texts(got) == [x for x in before if not found[x[0]][1]] and len(before) > got.count()
        else:
            coder = bpe.BytePairCoder(bpe.tokenizer_path())
            assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == [(i, coder.encode(t)) for i, t in before]
            assert all(r["n_tokens"] == len(r["ids"]) for r in got.collect())
        docs = got
    run = corpus_pipeline.run(spark, at)
    assert sorted((r["doc_id"], r["ids"]) for r in run.collect()) == sorted((r["doc_id"], r["ids"]) for r in docs.collect())


def test_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    for t in ("documents", "labels", "benchmark"):
        table(spark, at, t).where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
