import math
import random
import zlib
from collections import Counter

import pytest

from chronoweave.llm import langid
from chronoweave.llm.common import held_out, table


def test_codes_are_a_distribution():
    tree = langid.ContextTree()
    for w, n in ((b"banana", 3), (b"bandana", 1), (b"an", 2)):
        tree.add(w, n)
    for context in (b"", b"a", b"an", b" ba", b"zzz"):
        assert sum(2 ** -tree.bits(context, s) for s in range(256)) == pytest.approx(1)


def test_escapes_by_hand():
    tree = langid.ContextTree()
    tree.add(b"ab", 1)  # " ab ": a after " ", b after "a", " " after "b"
    assert tree.bits(b"a", ord("b")) == pytest.approx(-math.log2(1 / 2))
    # not b: escape 1/2, then order 0 without b: a and " " once each of 4 slots
    assert tree.bits(b"a", ord("a")) == pytest.approx(1 + 2)
    assert tree.bits(b"a", ord("z")) == pytest.approx(1 - math.log2(2 / 4) + math.log2(253))


def plain_bits(trees, text):
    """Byte by byte, with nothing kept."""
    words = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in text.lower().split()]
    return [sum(t.bits(w[max(0, i - langid.ORDER) : i], w[i]) for w in words for i in range(1, len(w))) for t in trees]


def trees_of(*texts):
    trees = []
    for text in texts:
        tree = langid.ContextTree()
        for w, n in Counter(text.lower().split()).items():
            tree.add(w.encode("utf-8", "surrogatepass"), n)
        trees.append(tree)
    return trees


def test_kept_costs_change_nothing(monkeypatch, edge_rows):
    trees = trees_of("the cat sat on the mat", "der hund lief in das haus")
    texts = ["the haus on der mat " * 30, "x", *[t for _, t in edge_rows if t and t.strip()]]
    want = [plain_bits(trees, t) for t in texts]
    for kept, chunk in ((300_000, 1 << 18), (2, 7), (50, 1000)):
        monkeypatch.setattr(langid, "KEPT_GRAMS", kept)
        monkeypatch.setattr(langid, "CHUNK", chunk)
        monkeypatch.setattr(langid, "SLOTS", 1 << 14)
        model = langid.LanguageModel(["a", "b"], trees)
        got = model.bits(texts if chunk > 100 else texts[:2])
        for g, w in zip(got.tolist(), want, strict=False):
            assert g == pytest.approx(w, rel=1e-6)
        assert model.bits(texts[:2]).tolist() == model.bits(texts[1::-1]).tolist()[::-1]


def test_the_query_against_a_plain_version(spark, tmp_path, prose):
    """Learned from the rows that aren't held out, each document scored byte by byte."""
    rng = random.Random(2)
    voice = {"aa": prose(1, 400), "bb": " ".join(w[::-1] + "o" for w in prose(2, 400).split()), "cc": prose(3, 300).upper().replace("E", "É")}
    rows = [(i, " ".join(rng.sample(voice[lang].split(), rng.randint(1, 40))), lang if i % 5 else None) for i in range(80) for lang in [rng.choice(sorted(voice))]]
    rows += [(200, None, "aa"), (201, "12 34", "bb"), (202, "", None), (203, prose(9, 3), "dd"), (203, prose(9, 3), "dd")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    train = {}
    for i, t, lang in dict.fromkeys(rows):
        if lang and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            train.setdefault(lang, []).append(t)
    langs = sorted(train)
    trees = trees_of(*[" ".join(train[x]) for x in langs])
    got = sorted(map(tuple, langid.query(spark, str(tmp_path)).collect()))
    assert len(got) == len(rows)
    for (i, t, _), (j, held, pred, score) in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        assert i == j and held == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not t or not any(c.isalpha() for c in t):
            assert (pred, score) == ("und", 0.0)
            continue
        bits = plain_bits(trees, t)
        assert pred == langs[bits.index(min(bits))]
        assert score == pytest.approx(1 / sum(2 ** max(min(bits) - b, -1000) for b in bits), rel=1e-3)


def test_long_texts_are_learned_from(spark, prose):
    model = langid.fit(spark.createDataFrame([(1, prose(1, 40_000), "xx"), (2, "a b", "yy")], "doc_id bigint, text string, lang string"))
    assert model.langs == ["xx", "yy"] and model.predict([prose(1, 50)])[0][0] == "xx"


def test_edges(edge_docs, no_docs, spark):
    model = langid.fit(spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund lief", "de"), (3, None, "de"), (4, "x", None)], "doc_id bigint, text string, lang string"))
    assert model.langs == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.predict(edge_docs, model).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 12} - ({12} if got[12]["lang_pred"] != "und" else set())
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[6]["lang_pred"] == got[7]["lang_pred"]
    assert langid.predict(no_docs, model).count() == 0
    none = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.predict(edge_docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    got = langid.query(spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert n > 20 and right / n > 0.95
    assert got.where(~held_out(got["doc_id"])).count() == 0
