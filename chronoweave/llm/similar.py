"""Near-duplicates by the similarity of whole shingle sets: |A & B| / |A | B| of the different word shingles.

All shingles are held in one order. Two sets with a similarity of ``similarity`` or more share one of the first
``n - ceil(similarity * n) + 1`` shingles of each (prefix filter), so no pair is missed; every pair is then verified by
its whole sets. Shingles that a sample finds common come last in the order, so few sets have them among their first:
the sample decides how fast it goes, never what is found.

Only prefixes and sketches are stored for every text; whole sets are made again from the texts of candidates, so the
disk it takes is about a third of the input's.

A large group of near copies isn't taken pair by pair: fingerprints that are close (see simhash) and, of each shared
shingle, the holder of least id against all others are verified first. What this leaves apart is compared in full, in
a join that passes over pairs which are one component already.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped_texts, materialize, scratch, small, utf8
from .components import components
from .simhash import LOWER, SEED, links, majority

#: About so many documents are sampled; shingles that COMMON of them hold, the MOST_COMMON commonest at most, come last.
SAMPLE, COMMON, MOST_COMMON = 4_000, 3, 50_000
#: The similarity is counted in hundredths, so that bounds are whole numbers.
UNIT = 100
#: The parity sketch has one bit for two shingles, in words of 64, a power of two of them and WORDS at least. So many
#: are enough to tell a pair that is just similar from a pair with nothing in common.
WORDS = 4


def shingle_hashes(text: str | None, shingle: int):
    """XXH64 of each shingle; none for a text without words, one for a text of fewer words than a shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    words = utf8(text).translate(LOWER).split()
    grams = (b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))) if words else ()
    return np.fromiter((xxh(g, SEED) for g in grams), np.uint64)


def _shingled(df: DataFrame, id_col: str, text_col: str, shingle: int, least: int, common: Iterable[int]) -> DataFrame:
    """node, fp, sig (of the set), n, s0.. (parity sketch of WORDS words), sk (the whole one), first (the prefix)."""
    kind = df.schema[id_col].dataType.simpleString()
    last = df.sparkSession.sparkContext.broadcast(sorted(common))

    def run(it):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh128_digest

        late = np.array(last.value, np.int64).view(np.uint64)
        late.sort()
        late = late if len(late) else np.zeros(1, np.uint64)  # any order does
        for keys, texts in grouped_texts(it):
            out = {c: [] for c in ("fp", "sig", "n", *[f"s{k}" for k in range(WORDS)], "sk", "first")}
            for t in texts:
                every = shingle_hashes(t, shingle)
                hs = np.unique(every)
                n = len(hs)
                is_late = late[np.minimum(np.searchsorted(late, hs), len(late) - 1)] == hs
                order = np.concatenate([hs[~is_late], hs[is_late]])
                size = 64 * max(WORDS, 1 << (n // 128).bit_length())
                bits = np.bincount((hs >> np.uint64(32)) % np.uint64(size), minlength=size) % 2
                sk = sketch = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
                while len(sketch) > WORDS:  # the sketch of half the size
                    sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
                out["fp"].append(int(np.uint64(majority(every)).astype(np.int64)) if n else 0)
                out["sig"].append(xxh128_digest(hs.tobytes()))
                out["n"].append(n)
                for k in range(WORDS):
                    out[f"s{k}"].append(int(sketch[k]))
                out["sk"].append(sk)
                out["first"].append(order[: n + (-least * n // UNIT) + 1 if n else 0].view(np.int64))
            kinds = {"sig": pa.binary(), "n": pa.int32(), "sk": pa.list_(pa.int64()), "first": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()]], ["node", *out])

    sketch = ", ".join(f"s{k} long" for k in range(WORDS))
    return df.select(id_col, text_col).mapInArrow(run, f"node {kind}, fp long, sig binary, n int, {sketch}, sk array<bigint>, first array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, hs (the set) of (node, text)."""
    kind = docs.schema["node"].dataType.simpleString()

    def run(it):
        import numpy as np
        import pyarrow as pa

        for keys, texts in grouped_texts(it):
            hs = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hs, pa.list_(pa.int64()))], ["node", "hs"])

    return docs.mapInArrow(run, f"node {kind}, hs array<bigint>")


def _common(df: DataFrame, id_col: str, text_col: str, shingle: int) -> list[int]:
    """The shingles that COMMON documents of a sample hold, by a hash of the id."""
    every = max(1, df.count() // SAMPLE)
    some = df.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)

    def run(it):
        import numpy as np
        import pyarrow as pa

        for _, texts in grouped_texts(it):
            for t in texts:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, shingle)).view(np.int64))], ["h"])

    counted = some.select(id_col, text_col).mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    return [r["h"] for r in counted.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()]


def _possible(least: int) -> Column:
    """Of two rows with n, s0.. and n2, t0..: sizes and sketches leave the similarity possible. Each shingle that only
    one set holds turns one bit, so different bits are never more than such shingles."""
    n, m = F.col("n").cast("long"), F.col("n2").cast("long")
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    return (F.least(n, m) * UNIT >= F.greatest(n, m) * least) & _near(n + m, apart, least)


def _near(sizes: Column, apart: Column, least: int) -> Column:
    """Similar: (sizes - apart) / 2 shingles in both, of (sizes + apart) / 2 in either."""
    return (sizes - apart) * UNIT >= (sizes + apart) * least


def _by_whole_sketches(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs (u, v) that their whole sketches leave possible. sketches: node, n, sk. Of two lengths, which are one
    doubling apart, the longer sketch is folded."""
    of = lambda c, k: sketches.select(F.col("node").alias(c), F.col("n").cast("long").alias(f"n{k}"), F.col("sk").alias(f"sk{k}"))
    both = pairs.join(of("u", 1), "u").join(of("v", 2), "v")
    half = lambda x, k: F.slice(x, (F.size(x) / 2 * k + 1).cast("int"), (F.size(x) / 2).cast("int"))
    xor = lambda x, y: F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    fold = lambda x, y: F.when(F.size(x) > F.size(y), xor(half(x, 0), half(x, 1))).otherwise(F.col(x))
    bits = F.aggregate(xor(fold("sk1", "sk2"), fold("sk2", "sk1")), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    return both.where(_near(F.col("n1") + F.col("n2"), bits, least)).select("u", "v")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, shingle: int, least: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar. docs: node, text."""
    with scratch() as s:
        pairs = materialize(_by_whole_sketches(pairs.distinct(), sketches, least), "similar-pairs")
        asked = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "asked")
        # few asked for: only their texts leave the scan
        there = materialize(_sets(docs.join(small(asked, "shuffle_hash"), "node", "left_semi"), shingle), "similar-sets")
        a = pairs.join(there.select(F.col("node").alias("u"), F.col("hs").alias("x")), "u")
        both = a.join(there.select(F.col("node").alias("v"), F.col("hs").alias("y")), "v")
        shared = both.select("u", "v", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("n"))
        return s.keep(materialize(shared.where(F.col("i") * UNIT >= (F.col("n") - F.col("i")) * least).select("u", "v"), "similar-links"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 5) -> DataFrame:
    """id, component_id (the least id reachable over pairs that are similar, itself included) for each row.

    Defined results: texts without words are equal; words are those of simhash; a text shorter than a shingle is one
    shingle; rows that repeat an id count as one node with several sets. Ids are integers, and not null."""
    least = round(similarity * UNIT)
    docs = df.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    with scratch() as s:
        rows = materialize(_shingled(df, id_col, text_col, shingle, least, _common(df, id_col, text_col, shingle)), "shingles")
        classes = materialize(rows.groupBy("sig").agg(F.min(F.struct("node", "fp")).alias("m")).select("sig", "m.node", "m.fp"), "classes")
        near = materialize(_links(rows, classes, docs, shingle, least, distance), "all-links")
        stars = components(near)
        of = classes.join(stars, F.col("node") == F.col("u"), "left").select("sig", F.coalesce("v", "node").alias("component_id"))
        found = rows.select("node", "sig").join(of, "sig").select(F.col("node").alias(id_col), "component_id")
        return s.keep(materialize(found, "groups"))


def _links(rows: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, least: int, distance: int) -> DataFrame:
    """Similar pairs (u, v) that connect whatever is similar; not all pairs of a large group."""
    sketch = [f"s{k}" for k in range(WORDS)]
    # of equal sets one stands for all
    heads = materialize(rows.join(classes.select("sig", "node").hint("shuffle_hash"), ["sig", "node"], "left_semi").select("node", "n", *sketch, "sk", "first"), "prefixes")
    whole = materialize(heads.select("node", "n", "sk"), "sketches")
    posted = heads.select("node", F.explode("first").alias("key"))
    shared = posted.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    shared = materialize(shared, "shared-keys")
    common = materialize(posted.join(shared.hint("shuffle_hash"), "key"), "shared-postings")
    sizes = heads.select("node", "n", *sketch).distinct()
    held = materialize(common.join(sizes.hint("shuffle_hash"), "node"), "shared")
    for gone in (common, shared, heads):
        discard(gone)
    other = lambda rows, *more: rows.select("key", *more, F.col("node").alias("node2"), F.col("n").alias("n2"), *[F.col(s).alias(f"t{k}") for k, s in enumerate(sketch)])
    # first round: close fingerprints, and the first holder of each shingle with all others
    one = classes.groupBy("fp").agg(F.min("node").alias("node"))
    equal = classes.withColumnRenamed("node", "u").join(one.withColumnRenamed("node", "v"), "fp").where("u <> v").select("u", "v")
    firsts = other(held.where(F.col("node") == F.col("least")))
    stars = held.where(F.col("node") != F.col("least")).join(firsts, "key").where(_possible(least)).select(F.col("node").alias("u"), F.col("node2").alias("v"))
    normal = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _verified(normal(equal.union(links(one, distance)).union(stars)), whole, docs, shingle, least)
    # second round: all other pairs that share a shingle
    joined = components(near)
    known = held.join(joined.select(F.col("u").alias("node"), F.col("v").alias("of")), "node", "left").withColumn("of", F.coalesce("of", "node"))
    known = materialize(known.drop("least"), "shared-known")
    discard(held)
    right = other(known, F.col("of").alias("of2"))
    rest = known.join(right.hint("shuffle_hash"), "key").where((F.col("node") > F.col("node2")) & (F.col("of") != F.col("of2")) & _possible(least))
    far = _verified(rest.select(F.col("node").alias("u"), F.col("node2").alias("v")), whole, docs, shingle, least)
    return near.union(far)
