"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Lexicons (words, and beginnings of words for families of insults) are learned from labelled documents by grouped
counts. Each text then becomes a dozen numbers: lexicon densities, lexicon hits near a second-person word, capitals,
punctuation and obfuscation rates. Trees are grown on histograms of these; isotonic regression over rows the trees
have not seen turns their sum into a probability.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_texts, held_out, materialize, scratch, table

#: Labelled rows that lexicons and trees are learned from, at most about so many (chosen by a hash of the id).
TRAIN_ROWS = 8000
#: Entries of a lexicon, strongest first; the rows with a label 1 and the share of them an entry needs.
LEXICON, MIN_TOXIC, MIN_SHARE = 4000, 4, 0.75
BEGINNINGS = (4, 5, 6)
KEPT_WORDS = 300_000
NEAR = 5
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure sie tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split()
)
#: Words that count as insults whatever the labels say.
SEED = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile jerk "
    "trottel dummkopf abschaum versager vollidiot ekelhaft imbécile crétin abruti connard salaud ordure estúpido imbécil basura escoria asqueroso".split()
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": None, ".": None, "-": None, "_": None, "!": "i", "|": "l"})
EDGE = re.compile(r"^\W+|\W+$")
FEATURES = ("hits", "hit_rate", "family_hits", "family_rate", "hits_near_you", "second_person", "capitals", "marks", "obfuscated", "log_words", "odd_words")
HIT, FAMILY, YOU, CAPS, MARK, OBFUSCATED, ODD = (1 << k for k in range(7))


def plain(word: str) -> str:
    return EDGE.sub("", word.lower())


class Features:
    def __init__(self, words: frozenset[str], families: frozenset[str]):
        self.words, self.families = words, families
        self.kept: dict[str, int] = {}

    def __getstate__(self):
        return self.words, self.families

    def __setstate__(self, state):
        self.__init__(*state)

    def kind(self, word: str) -> int:
        p, out = plain(word), 0
        if p in self.words:
            out |= HIT
        if any(p[:n] in self.families for n in BEGINNINGS if len(p) >= n):
            out |= FAMILY
        if p in SECOND_PERSON:
            out |= YOU
        if len(word) > 1 and word.isupper():
            out |= CAPS
        if "!" in word or "?" in word:
            out |= MARK
        if p and not p.isalpha():
            out |= ODD
            if not out & HIT and (q := plain(p.translate(LEET))) in self.words:
                out |= HIT | OBFUSCATED
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        self.kept[word] = out
        return out

    def of(self, text: str | None) -> list[float]:
        words = (text or "").split()
        if not words:
            return [0.0] * len(FEATURES)
        get, kind = self.kept.get, self.kind
        codes = np.frombuffer(bytes([c if (c := get(w)) is not None else kind(w) for w in words]), np.uint8)
        n = len(codes)
        count = lambda bit: int(np.count_nonzero(codes & bit))
        rate = lambda bit: count(bit) / n
        bad, you = np.flatnonzero(codes & (HIT | FAMILY)), np.flatnonzero(codes & YOU)
        near = 0
        if len(bad) and len(you):
            at = np.searchsorted(you, bad)
            before, after = bad - you[np.maximum(at - 1, 0)], you[np.minimum(at, len(you) - 1)] - bad
            near = int(np.count_nonzero((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)))
        hits, family = count(HIT), count(FAMILY)
        return [hits, hits / n, family, family / n, near, rate(YOU), rate(CAPS), rate(MARK), count(OBFUSCATED), math.log1p(n), rate(ODD)]


class BoostedTrees:
    """Histogram-grown regression trees on the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        cuts = []
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            cuts.append((v[:-1] + v[1:]) / 2 if len(v) <= self.bins else np.unique(np.quantile(v, np.arange(1, self.bins) / self.bins)))
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, cuts, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, binned, cuts, g, h):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for k in range(size):
            mine = np.flatnonzero(node == k)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[k] = self.rate * gs / (hs + self.l2)
            best = 1e-3
            if 2 * k + 2 >= size or len(mine) < 10:
                continue
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[mine, j]
                gl = np.cumsum(np.bincount(b, g[mine], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[mine], len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                m = int(gain.argmax())
                if gain[m] > best:
                    best, feature[k], cut[k] = gain[m], j, c[m]
            if feature[k] >= 0:
                right = binned[mine, feature[k]] > np.searchsorted(cuts[feature[k]], cut[k], side="left")
                node[mine] = 2 * k + 1 + right
        return feature, cut, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._apply(tree, x)
        return out


class Isotonic:
    """Pool adjacent violators; equal scores are one from the start; values between two blocks are interpolated."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        at, first, n = np.unique(score[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(y[order].astype(float), first) if len(first) else []
        for s, v, k in zip(at.tolist(), sums, n.tolist(), strict=True):
            blocks.append([float(v), float(k), s, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                v2, n2, _, hi = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
        # shrunk by half a row, so that no block says 0 or 1 on a few rows
        self.x = np.array([e for b in blocks for e in (b[2], b[3])])
        self.y = np.array([v for b in blocks for v in [(b[0] + 0.25) / (b[1] + 0.5)] * 2])
        self.y = np.maximum.accumulate(self.y) if len(self.y) else self.y
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.full(len(score), 0.5)


class ToxicityModel:
    def __init__(self, features: Features, trees: BoostedTrees | None, isotonic: Isotonic | None, share: float):
        self.features, self.trees, self.isotonic, self.share = features, trees, isotonic, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return self.isotonic(self.trees.raw(np.array([self.features.of(t) for t in texts]).reshape(-1, len(FEATURES))))


def _beginnings(words, n: int):
    return F.transform(F.filter(words, lambda x: F.length(x) >= n), lambda x: F.substring(x, 1, n))


def _lexicon(sample: DataFrame, unit) -> frozenset[str]:
    """The strongest entries among the units of the sample, by grouped counts."""
    words = F.filter(F.transform(F.split(F.lower("text"), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)^\W+|\W+$", "")), lambda w: F.length(w) > 2)
    rows = (
        sample.select("toxic", F.explode(F.array_distinct(unit(words))).alias("u"))
        .groupBy("u")
        .agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        .where((F.col("t") >= MIN_TOXIC) & (F.col("t") >= MIN_SHARE * F.col("n")))
        .orderBy(F.desc("t"), "u")
        .limit(LEXICON)
        .collect()
    )
    return frozenset(r["u"] for r in rows)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic. Rows held out by the caller must be gone from labels."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = labels.count()
    at = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id").cast("string")), F.lit(1_000_000))
    chosen = labels.where(at < int(1_000_000 * min(1.0, TRAIN_ROWS / max(n, 1))) + 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about TRAIN_ROWS rows of two numbers, so a broadcast is bounded; one row an id, so the sample is, too
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch():
        sample = materialize(sample, "toxic-sample")  # read three times below
        words = SEED | _lexicon(sample, lambda w: w)
        families = _lexicon(sample, lambda w: F.flatten(F.array(*[_beginnings(w, n) for n in BEGINNINGS])))
        features = Features(words, families)

        def run(it):
            import pyarrow as pa

            for b in it:
                x = [features.of(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

        rows = sorted(sample.mapInArrow(run, f"doc_id {kind}, toxic int, x array<double>").collect())
    y = np.array([r[1] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return ToxicityModel(features, None, None, float(y.mean()) if len(rows) else 0.0)
    x = np.array([r[2] for r in rows])
    part = np.arange(len(rows)) % 10 >= 7  # rows for the calibration
    if len(rows) < 200 or y[~part].min() == y[~part].max():
        part[:] = True
        trees = BoostedTrees().fit(x, y)
    else:
        trees = BoostedTrees().fit(x[~part], y[~part])
    return ToxicityModel(features, trees, Isotonic().fit(trees.raw(x[part]), y[part]), float(y.mean()))


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score, predicted for each whole text.

    Defined results: null and empty texts get the score of a text without words; without usable labels the score is
    the share of label 1 (0 if there is none); repeated ids give one row each; a null id gives a row like any other
    (the query's held_out is null there, and the row isn't learned from); no other column is read."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and the number of trees

    def run(it):
        import pyarrow as pa

        for keys, texts in grouped_texts(it):
            s = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
