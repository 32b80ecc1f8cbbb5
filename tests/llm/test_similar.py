import random

import pytest

from chronoweave.llm import similar

from . import brute


@pytest.fixture(scope="module")
def corpus(prose):
    """Copies with up to nine words changed, lone pairs at similarities around 0.8, a passage that many texts hold."""
    rng, rows, passage = random.Random(3), [], prose(999, 60)
    for s in range(40):
        words = prose(s, rng.choice([8, 60, 150, 300])).split()
        for c in range(4):
            w = list(words)
            for _ in range(3 * c):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(9)}"
            rows.append((s * 10 + c, " ".join(w)))
        rows.append((s * 10 + 5, prose(1000 + s, 30) + " " + passage))
        rows.append((s * 10 + 6, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, "a c")]


@pytest.mark.parametrize("common", [5, 10**9])
def test_all_pairs_are_found(spark, corpus, monkeypatch, common):
    monkeypatch.setattr(similar, "COMMON", common)
    got = similar.near_duplicates(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3))
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert found == brute.similar(corpus)
    # more than fingerprints five bits apart link
    by_bits = {i: c for i, (_, c) in brute.simhash(corpus, 5, 5).items()}
    assert len(set(found.values())) < len(set(by_bits.values()))


def test_pipeline_stage(spark, corpus):
    import corpus_pipeline

    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == set(brute.similar(corpus).values())
