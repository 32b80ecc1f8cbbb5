import math
import random
import re
import zlib

import numpy as np
import pytest

from chronoweave.llm import toxicity as tox
from chronoweave.llm.common import table


def test_features_by_hand():
    f = tox.Features(frozenset(["idiot"]), frozenset(["mora"]))
    got = dict(zip(tox.FEATURES, f.of("YOU are an 1d1ot! what a morass, fine sky over it all"), strict=True))
    assert got["hits"] == 1 and got["obfuscated"] == 1 and got["family_hits"] == 1 and got["hits_near_you"] == 1
    assert got["second_person"] == pytest.approx(1 / 12) and got["capitals"] == pytest.approx(1 / 12) and got["marks"] == pytest.approx(1 / 12)
    assert f.of(None) == f.of(" ") == [0.0] * len(tox.FEATURES)


def test_kept_words_change_nothing(monkeypatch):
    text = "you idiot you fool what 1d1ot"
    want = tox.Features(tox.SEED, frozenset()).of(text)
    monkeypatch.setattr(tox, "KEPT_WORDS", 2)
    assert tox.Features(tox.SEED, frozenset()).of(text) == want


def test_isotonic_against_all_blocks():
    rng = np.random.default_rng(1)
    x, y = np.sort(rng.random(60)), (rng.random(60) < np.linspace(0, 1, 60)).astype(float)
    got = tox.Isotonic().fit(x, y)(x)
    assert (np.diff(got) >= -1e-12).all() and ((got >= 0) & (got <= 1)).all()
    # the pooled means are those of the minimax formula
    raw = np.array([max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])
    assert np.abs(got - raw).max() < 0.35 and np.corrcoef(got, raw)[0, 1] > 0.97


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = tox.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((trees.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_edges(edge_docs, no_docs, spark):
    no_labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = tox.fit(edge_docs, no_labels)
    assert {r["score"] for r in tox.score(edge_docs, model).collect()} == {0.0}
    one_kind = spark.createDataFrame([(4, 1), (6, 1), (None, 0), (7, None)], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in tox.score(edge_docs, tox.fit(edge_docs, one_kind)).collect()} == {1}
    both = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (10, 1), (11, 0)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in tox.score(edge_docs, tox.fit(edge_docs, both)).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] and got[6]["score"] == got[7]["score"]
    assert tox.score(no_docs, model).count() == 0 and tox.fit(no_docs, both).trees is None


def plain_features(text, lexicon, families):
    """Word by word, every rate from its own count."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(tox.FEATURES)
    bare = [re.sub(r"^\W+|\W+$", "", w.lower()) for w in words]
    leet = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""}
    swapped = [re.sub(r"^\W+|\W+$", "", "".join(leet.get(c, c) for c in b)) for b in bare]
    odd = [bool(b) and not b.isalpha() for b in bare]
    hidden = [o and b not in lexicon and s in lexicon for b, s, o in zip(bare, swapped, odd)]
    hit = [b in lexicon or h for b, h in zip(bare, hidden)]
    family = [any(len(b) >= n and b[:n] in families for n in (4, 5, 6)) for b in bare]
    you = [k for k, b in enumerate(bare) if b in tox.SECOND_PERSON]
    near = sum(any(abs(k - j) <= 5 for j in you) for k in range(len(words)) if hit[k] or family[k])
    n = len(words)
    caps, marks = sum(len(w) > 1 and w.isupper() for w in words), sum("!" in w or "?" in w for w in words)
    return [sum(hit), sum(hit) / n, sum(family), sum(family) / n, near, len(you) / n, caps / n, marks / n, sum(hidden), math.log1p(n), sum(odd) / n]


def plain_score(model, x):
    """Each tree from its root down, then the line through the two calibrated points around the sum."""
    total = model.trees.base
    for feature, cut, value in model.trees.trees:
        k = 0
        while feature[k] >= 0:
            k = 2 * k + 1 + int(x[feature[k]] > cut[k])
        total += value[k]
    xs, ys = list(model.isotonic.x), list(model.isotonic.y)
    if total <= xs[0]:
        return ys[0]
    if total >= xs[-1]:
        return ys[-1]
    k = next(k for k in range(len(xs)) if xs[k] >= total)
    return ys[k] if xs[k] == total else ys[k - 1] + (ys[k] - ys[k - 1]) * (total - xs[k - 1]) / (xs[k] - xs[k - 1])


def test_the_query_against_a_plain_version(spark, tmp_path, prose):
    """Lexicons by loops over the learned rows, features and trees by loops over each document."""
    rng, docs, labels = random.Random(4), [], []
    insults = ["éblorg", "blorgface", "blorghead", "zonkbrain", "idiot", "1d1ot", "TRASH!"]
    for i in range(260):
        w, bad = prose(i, rng.randint(3, 60)).split(), i % 3 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            at = rng.randint(0, len(w))
            w[at:at] = [rng.choice(["you", "YOU", "du"]), rng.choice(insults)]
        docs.append((i, " ".join(w)))
        if rng.random() < 0.2:
            w.append(rng.choice(["you", "idiot", "été", "stupid"]))
        labels.append((i, int(bad != (rng.random() < 0.12))))
    docs += [(1000, None), (1001, ""), (1002, "?! ..."), (7, "another text of one id"), (None, "no id idiot")]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learned = {}
    for i, t in docs:
        if i is not None and i < 260 and not held(i):
            learned[i] = min(learned.get(i, t), t)
    counts = {}
    for i, t in learned.items():
        bare = {b for b in (re.sub(r"^\W+|\W+$", "", w) for w in re.split(r"\s+", t.lower())) if len(b) > 2}
        for kind, units in (("words", bare), ("families", {b[:n] for b in bare for n in (4, 5, 6) if len(b) >= n})):
            for u in units:
                n = counts.setdefault(kind, {}).setdefault(u, [0, 0])
                n[0] += dict(labels)[i]
                n[1] += 1
    chosen = lambda kind: {u for u, (t, n) in counts[kind].items() if t >= tox.MIN_TOXIC and t >= tox.MIN_SHARE * n}
    model = tox.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([x for x in labels if not held(x[0])], "doc_id bigint, toxic int"))
    assert model.features.words == chosen("words") | tox.SEED and model.features.families == chosen("families") and "blorgface" in model.features.words
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 9), r["predicted"], r["held_out"]) for r in tox.query(spark, str(tmp_path)).collect()))
    for _, t in docs:
        assert model.features.of(t) == pytest.approx(plain_features(t, model.features.words, model.features.families)), t
    score = {t: plain_score(model, plain_features(t, model.features.words, model.features.families)) for _, t in docs}
    want = sorted((i is None, i or 0, round(score[t], 9), int(score[t] >= 0.7), None if i is None else held(i)) for i, t in docs)
    assert got == want
    assert len({w[2] for w in want}) > 3


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    got = tox.query(spark, sf).where("held_out").join(table(spark, sf, "labels").where("toxic is not null"), "doc_id").select("toxic", "predicted").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in got)
    assert hit / max(1, sum(r["predicted"] for r in got)) > 0.9 and hit / sum(r["toxic"] for r in got) > 0.7
