"""Language identification by partial matching of byte contexts.

For every language one variable-order tree of byte contexts (orders 0 to ORDER) is counted on a bounded sample of
training documents and then frozen. A symbol is coded in the longest known context; a symbol new to it costs an escape
(method C: distinct symbols / (total + distinct)) and goes on in the next shorter context, without the symbols that
the escape has ruled out; below order 0 all bytes are equally likely. A document's code length in a language is the
sum over its words, each with a space before and after; contexts don't reach over white space. The language with the
shortest code wins.

Frozen counts make the cost of a byte a function of the byte and the ORDER bytes before it, so each such sequence is
costed once in each worker and kept in a hash table, and texts are scored by whole arrays of bytes. Costs are whole
numbers of 2**-20 bits, so sums don't depend on their order.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped_texts, held_out, table

ORDER = 3
#: The training sample: about so many documents of a language, whole texts.
SAMPLE_DOCS = 300
#: Byte sequences kept in each Python worker, the bytes scored at a time, and the slots of the hash table.
KEPT_GRAMS, CHUNK, SLOTS = 300_000, 1 << 18, 1 << 21
UNIT = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


class ContextTree:
    """Frozen counts of one language: for each context the number of times each byte followed."""

    def __init__(self) -> None:
        self.after: dict[bytes, dict[int, int]] = {}

    def add(self, word: bytes, times: int) -> None:
        s = b" " + word + b" "
        for i in range(1, len(s)):
            for k in range(min(ORDER, i) + 1):
                node = self.after.setdefault(s[i - k : i], {})
                node[s[i]] = node.get(s[i], 0) + times

    def bits(self, context: bytes, symbol: int) -> float:
        out, ruled_out = 0.0, set()
        for k in range(len(context), -1, -1):
            node = self.after.get(context[len(context) - k :])
            if not node:
                continue
            if ruled_out:
                node = {s: c for s, c in node.items() if s not in ruled_out}
                if not node:
                    continue
            total, distinct = sum(node.values()), len(node)
            if symbol in node:
                return out - math.log2(node[symbol] / (total + distinct))
            out -= math.log2(distinct / (total + distinct))
            ruled_out |= node.keys()
        return out + math.log2(max(1, 256 - len(ruled_out)))


def gram_keys(data: np.ndarray) -> np.ndarray:
    """For each byte of words with a space before and after each: the byte, the bytes before it back to the last space
    (ORDER at most), and their number, as one integer. The first ORDER bytes of ``data`` are context only."""
    n, wide = len(data) - ORDER, data.astype(np.int64)
    key, going, count = wide[ORDER:].copy(), np.ones(n, bool), np.zeros(n, np.int64)
    for k in range(1, ORDER + 1):
        before = wide[ORDER - k : ORDER - k + n]
        key |= np.where(going, before, 0) << 8 * k
        count += going
        going = going & (before != 32)
    return key | count << 8 * (ORDER + 1)


class Costs:
    """Costs of byte sequences in each language, in a hash table with open addressing that whole arrays look up."""

    def __init__(self, trees: list[ContextTree]):
        self.trees = trees
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(SLOTS, -1, np.int64)
        self.rows = np.zeros(SLOTS, np.int32)
        self.costs = np.zeros((1 << 12, len(self.trees)), np.int64)
        self.kept = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * -7046029254386353131) >> 20) & (SLOTS - 1)

    def _add(self, key: int) -> None:
        raw = key.to_bytes(8, "little")
        context, symbol = raw[raw[ORDER + 1] : 0 : -1], raw[0]
        if self.kept == len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        self.costs[self.kept] = [round(t.bits(context, symbol) * UNIT) for t in self.trees]
        at = int(self._slot(np.array([key]))[0])
        while self.keys[at] >= 0:
            at = (at + 1) & (SLOTS - 1)
        self.keys[at], self.rows[at] = key, self.kept
        self.kept += 1

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The row in ``costs`` of each key."""
        out, todo, slot = np.zeros(len(keys), np.int32), np.arange(len(keys)), self._slot(keys)
        missing = []
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.rows[slot[hit]]
            empty = there < 0
            missing.append(todo[empty])
            on = ~(hit | empty)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        missing = np.concatenate(missing) if missing else np.zeros(0, np.int64)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            first = self.kept
            for key in new.tolist():
                self._add(key)
            out[missing] = first + back
        return out


class LanguageModel:
    def __init__(self, langs: list[str], trees: list[ContextTree]):
        self.langs, self.trees = langs, trees
        self.table = Costs(trees)

    def __getstate__(self):
        return self.langs, self.trees

    def __setstate__(self, state):
        self.__init__(*state)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each whole text in each language, a row a text."""
        raws = [f" {' '.join(t.lower().split())} ".encode("utf-8", "surrogatepass") for t in texts]
        # a text's first space is context; spaces stand in front of the first text
        starts = np.cumsum([0, *map(len, raws)])[:-1]
        data = np.frombuffer(b" " * ORDER + b"".join(raws), np.uint8)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        size, table = len(data) - ORDER, self.table
        for a in range(0, size, CHUNK):
            z = min(a + CHUNK, size)
            if table.kept > KEPT_GRAMS:
                table.clear()
            rows = table.look_up(gram_keys(data[a : z + ORDER]))
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, z, "left")
            here = np.maximum(starts[first:last], a) - a
            begins = here[starts[first:last] >= a]
            for k in range(len(self.langs)):
                cost = table.costs[:, k][rows]
                cost[begins] = 0  # the space in front of a text isn't coded
                out[first:last, k] += np.add.reduceat(cost, here)
        return out / UNIT

    def text_bits(self, text: str) -> np.ndarray:
        return self.bits([text])[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        if known:
            bits = self.bits([texts[k] for k in known])
            best = bits.argmin(1)
            least = bits[np.arange(len(known)), best]
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            for k, b, s in zip(known, best.tolist(), score.tolist(), strict=True):
                out[k] = self.langs[b], s
        return out


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel:
    """Learn from the rows of ``train`` with a language, whatever the length of their texts. Of a language with more
    than SAMPLE_DOCS documents a sample chosen by a hash of the id is used; scores and predictions cover all documents
    whatever its size."""
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], [])
    at = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    keep: Column = F.lit(False)
    for lang in langs:
        keep = keep | ((F.col("lang") == lang) & (at < int(1_000_000 * min(1.0, SAMPLE_DOCS / sizes[lang])) + 1))

    def count(it):
        import pyarrow as pa

        for b in it:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                words = Counter(text.as_py().lower().split())
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    # one row an id, so that rows that repeat one don't swell the sample; words are counted on the executors
    some = train.where(keep).groupBy("lang", "id").agg(F.min("text").alias("text")).select("lang", "text")
    counted = some.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    trees = {lang: ContextTree() for lang in langs}
    for lang, word, n in counted.toLocalIterator():
        trees[lang].add(word.encode("utf-8", "surrogatepass"), n)
    return LanguageModel(langs, [trees[lang] for lang in langs])


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each whole text.

    Defined results: ``und`` with score 0 for null texts, texts without a letter, and an empty model; on a tie the
    first language by name; repeated ids give one row each; a null id gives a row like any other (the query's held_out
    is null there, and the row isn't learned from); no other column is read."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(it):
        import pyarrow as pa

        m = shared.value
        for keys, texts in grouped_texts(it):
            got = m.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([g[0] for g in got]), pa.array([g[1] for g in got])], [id_col, "lang_pred", "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
