"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints with at most DISTANCE differing bits differ in at most
``DISTANCE // segments`` bits of one segment, so each fingerprint looks up the small Hamming ball around each of its
segments in the table of all segments, and whole distances are verified inside the join. Equal fingerprints are one
class from the start, so a group of copies costs one row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_texts, materialize, table, utf8
from .components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: From so many different fingerprints on two segments are cheaper than three: balls grow, but fewer others fall in.
TWO_SEGMENTS_FROM = 1 << 28
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; 0 for a text without words. Words are split at ASCII white space, A-Z in lower case."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join
    grams = map(joined, zip(*[words[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [joined(words)]
    return majority(np.fromiter((xxh(g, SEED) for g in grams), np.uint64, n))


def majority(h) -> int:
    """The bits that more than half of the 64-bit numbers h hold."""
    import numpy as np

    n = len(h)
    parts = h.view(np.uint8).reshape(n, 8)  # little-endian: column 0 holds bits 0 to 7
    if n < 400:
        ones = np.unpackbits(parts, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        table_ = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(parts[:, k], minlength=256) @ table_ for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a bigint) of each whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        import pyarrow as pa

        for keys, texts in grouped_texts(it):
            got = [fingerprint(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([g - (g >> 63 << 64) for g in got], pa.int64())], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = 3) -> DataFrame:
    """fps: distinct (fp, node). Pairs (u, v) of nodes whose fingerprints differ in at most ``distance`` bits, each
    pair once: it is taken in the first segment that is close enough. Fingerprints with a segment in common meet under
    one key; adaptive execution splits a large one, on either side of the join."""
    bounds = [64 * k // segments for k in range(segments + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    radius = distance // segments
    balls = [[sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(a, z), r)] for a, z in zip(bounds, bounds[1:], strict=False)]
    at = lambda k: F.col("fp").bitwiseAND(F.lit(signed(masks[k])))
    longs = lambda xs: F.array(*[F.lit(signed(x)).cast("long") for x in xs])
    pair = lambda k, key: F.struct(F.lit(k).cast("byte").alias("seg"), key.alias("key"))
    stored = fps.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), F.inline(F.array(*[pair(k, at(k)) for k in range(segments)])))
    # each segment's own value, then its ball: a constant array that is exploded
    own = fps.select("fp", "node", F.inline(F.array(*[F.struct(F.lit(k).cast("byte").alias("seg"), at(k).alias("own"), longs(balls[k]).alias("ball")) for k in range(segments)])))
    probes = own.select("fp", "node", "seg", "own", F.explode("ball").alias("flip")).select("fp", "node", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    first = F.lit(True)
    for k in range(segments - 1):
        first = first & ((F.col("seg") <= k) | (F.bit_count(x.bitwiseAND(F.lit(signed(masks[k])))) > radius))
    return probes.join(stored.hint("shuffle_hash"), ["seg", "key"]).where((F.col("fp") < F.col("fp2")) & (F.bit_count(x) <= distance) & first).select(F.col("node").alias("u"), F.col("node2").alias("v"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """id, fp, component_id (the least id reachable over links, itself included) for each row.

    Defined results: null and empty texts have fingerprint 0 and are linked like any others; equal fingerprints are
    always linked; rows that repeat an id give one row each; a row with a null id links others like any row, and its
    component_id is null only if no row in reach has an id; other columns aren't read."""
    rows = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    # the nodes of the graph are the fingerprints themselves, so ids may be anything
    fps = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    segments = segments or (2 if fps.count() >= TWO_SEGMENTS_FROM else 3)  # any number finds the same links
    stars = components(links(fps.select("fp", F.col("fp").alias("node")), distance, segments))
    roots = materialize(fps.join(stars, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.select("fp", "root").join(least.hint("shuffle_hash"), "root").drop("root")
    return rows.join(of, "fp").select(id_col, "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
