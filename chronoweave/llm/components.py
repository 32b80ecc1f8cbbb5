"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: (u, v) of bigints, either way round. Returns (u, v): v is the least node that u reaches, for every u
    that isn't the least of its component. The number of rounds grows with the logarithm of the longest chain; each
    round's edges are written to the shared folder, so a lost executor costs one round at most."""
    normal = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, mark = materialize(normal(links), name), None
    for _ in range(MOST_ROUNDS):
        after = materialize(normal(_small_star(normal(_large_star(edges)))), name)
        was, mark = mark, tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        discard(edges)
        edges = after
        if mark == was or not mark[0]:
            return edges
    raise RuntimeError("components didn't settle")
