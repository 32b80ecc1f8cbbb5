"""Quality classifier: hierarchical empirical Bayes.

A document classifier (boosted trees on surface features, calibrated) gives each document a probability of being
good. Hosts and paths get posteriors by grouped sums of these: a path's rate is shrunk toward its host's and a host's
toward that of all documents, by a strength that the spread between groups itself sets (method of moments). A
document's score joins both: its own log-odds plus those of its path, without the document itself, against the whole.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, grouped_texts, held_out, materialize, table, utf8
from .toxicity import BoostedTrees, Isotonic

#: Labelled rows to learn from, about; groups that are too large for a broadcast are joined with SALT copies.
TRAIN_ROWS, SALT = 8000, 32
#: A score from here on keeps the document.
THRESHOLD = 0.5
#: The weight of the site's log-odds against the document's own.
SITE_WEIGHT = 0.5
FEATURES = ("log_words", "word_chars", "distinct", "repeats", "upper", "digits", "symbols", "bars", "bangs", "ends", "words_a_line", "common_line")

_SYMBOL = np.array([1 if c < 128 and not chr(c).isalnum() and chr(c) not in " \n\t.,;:'\"()-?!\r" else 0 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)]).astype(int)
_DIGIT = np.array([48 <= c <= 57 for c in range(256)]).astype(int)
_LETTER = np.array([chr(c).isalpha() if c < 128 else c >= 192 for c in range(256)]).astype(int)


def features(text: str | None) -> list[float]:
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = utf8(text)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    letters = max(1, int(c @ _LETTER))
    lines = text.split("\n")
    return [
        math.log1p(n),
        size / n,
        len(set(words)) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        float(c @ _UPPER) / letters,
        float(c @ _DIGIT) / size,
        float(c @ _SYMBOL) / size,
        float(c[124]) / n,
        float(c[33]) / n,
        float(c[46]) / n,
        min(n / len(lines), 500.0),
        1 - len(set(lines)) / len(lines),
    ]


class QualityModel:
    def __init__(self, trees: BoostedTrees | None, isotonic: Isotonic | None, share: float):
        self.trees, self.isotonic, self.share = trees, isotonic, share

    def probability(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        return np.clip(self.isotonic(self.trees.raw(x)), 0.002, 0.998)


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1). Without labels of both kinds every document is as good
    as the mean, or good if there is no label at all."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = labels.count()
    at = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")), F.lit(1_000_000))
    chosen = labels.where(at < int(1_000_000 * min(1.0, TRAIN_ROWS / max(n, 1))) + 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # about TRAIN_ROWS rows of two numbers, so a broadcast is bounded; one row an id, so the sample is, too
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(it):
        import pyarrow as pa

        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(run, f"doc_id {kind}, quality int, x array<double>").collect())
    if not rows:
        return QualityModel(None, None, 0.998)
    y, x = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    if y.min() == y.max():
        return QualityModel(None, None, float(np.clip(y.mean(), 0.002, 0.998)))
    part = np.arange(len(rows)) % 10 >= 7
    if len(rows) < 200 or y[~part].min() == y[~part].max():
        part[:] = True
        trees = BoostedTrees().fit(x, y)
    else:
        trees = BoostedTrees().fit(x[~part], y[~part])
    return QualityModel(trees, Isotonic().fit(trees.raw(x[part]), y[part]), float(y.mean()))


def with_probability(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs and a column _p; all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees
    at = docs.columns.index(text_col)

    def run(it):
        import pyarrow as pa

        for b in it:
            p = [shared.value.probability(part) for _, part in grouped_texts([pa.RecordBatch.from_arrays([b.column(at), b.column(at)], ["a", "b"])], 1 << 22)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(p) if p else np.zeros(0))], [*b.schema.names, "_p"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_p", DoubleType())]))


def logit(c: Column) -> Column:
    c = F.least(F.greatest(c, F.lit(0.002)), F.lit(0.998))
    return F.log(c / (1 - c))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-counts of the prior by the method of moments: how far the groups' rates lie apart beyond chance."""
    r = groups.where("n >= 2").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum("s").alias("s"),
    ).first()
    if not r["n"] or r["k"] < 2 or r["n"] <= r["k"]:
        return 50.0
    within = max(r["within"] / (r["n"] - r["k"]), 1e-6)
    tau2 = max((r["between"] - (r["k"] - 1) * within) / r["n"], 1e-9)
    return min(max(within / tau2, 2.0), 10_000.0)


def site_rates(scored: DataFrame, host: Column, path: Column) -> tuple[DataFrame, float]:
    """(_host, _path, n, s, prior, a) of each path: its sums, its host's rate as the prior, the prior's strength; and
    the rate of all documents. Sums are combined in the scan, so a hot host costs a row a task."""
    p = F.col("_p")
    paths = materialize(scored.groupBy(host.alias("_host"), path.alias("_path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    a_host = _strength(hosts, F.lit(mean))
    rates = hosts.select("_host", ((F.col("s") + a_host * mean) / (F.col("n") + a_host)).alias("prior"))
    both = paths.join(rates, paths["_host"].eqNullSafe(rates["_host"])).drop(rates["_host"])
    a_path = _strength(both, F.col("prior"))
    return both.select("_host", "_path", "n", "s", "prior", F.lit(a_path).alias("a")), mean


def _scored(docs: DataFrame, model: QualityModel, host_col: str, path_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """The columns of docs by position (c0, c1, ...), so that none of their names can clash, and p_doc, path_rate, score,
    keep."""
    of = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    scored = with_probability(docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), model, of[text_col])
    scored = materialize(scored if keep_text else scored.drop(of[text_col]), "scored")
    host, path = of[host_col], of[path_col]
    sites, mean = site_rates(scored, F.col(host), F.col(path))
    on = lambda a, b: a[host].eqNullSafe(b["_host"]) & a[path].eqNullSafe(b["_path"])
    if fits(sites):
        joined = scored.join(F.broadcast(sites), on(scored, sites))
    else:
        left = scored.withColumn("_salt", F.floor(F.rand(1) * SALT).cast("int"))
        right = sites.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = left.join(right, on(left, right) & (left["_salt"] == right["_salt2"]))
    p = F.col("_p")
    others = (F.col("s") - p + F.col("a") * F.col("prior")) / (F.col("n") - 1 + F.col("a"))
    total = logit(p) + SITE_WEIGHT * (logit(others) - logit(F.lit(mean)))
    out = joined.select(*[F.col(c) for c in scored.columns if c != "_p"], p.alias("p_doc"), others.alias("path_rate"), (1 / (1 + F.exp(-total))).alias("score"))
    return out.withColumn("keep", F.col("score") >= THRESHOLD)


def score(docs: DataFrame, model: QualityModel, host_col: str = "source", path_col: str = "lang", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs plus p_doc, path_rate, score and keep. ``documents`` has no URL: its host is ``source``, its path ``lang``.

    Defined results: null and empty texts get the classifier's answer for a text without words; null hosts and paths
    are groups of their own; a path with one document has its host's rate; repeated rows count as often as they
    stand; a null id passes like any other value (and isn't learned from); other columns pass unchanged whatever their
    names, unless they carry one of the new names, then the new values stand."""
    out = _scored(docs, model, host_col, path_col, text_col, keep_text)
    new = ["p_doc", "path_rate", "score", "keep"]
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in new and (keep_text or c != text_col)], *new)


def kept(docs: DataFrame, model: QualityModel, host_col: str = "source", path_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs."""
    out = _scored(docs, model, host_col, path_col, text_col, True).where("keep")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    got = score(docs.select("doc_id", "text", "source", "lang"), model, keep_text=False)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_doc", "path_rate", "score", "keep")
