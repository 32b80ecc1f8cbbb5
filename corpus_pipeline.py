"""A corpus from raw documents to token ids, in five stages. Each stage's rows are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, decontaminate, linededup, quality, similar
from chronoweave.llm.common import discard, materialize, scratch, table

#: Near-duplicates: five-word shingles at a similarity of 0.8 or more, by whole sets. Fingerprints at most 5 of 64 bits
#: apart are verified first, so that groups of close copies are known before the other pairs are sought.
SHINGLE, SIMILARITY, DISTANCE = 5, 0.8, 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    out = linededup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    classes = similar.near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY, distance=DISTANCE)
    roots = classes.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(roots.hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    keys = decontaminate.keys_of(docs, table(spark, sf_dir, "benchmark"))
    hits = decontaminate.phrase_matches(decontaminate.build_index(docs, keys), keys).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document that is left."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding", token_stage),
]

#: Trees, SimHash (XXH64) and BPE have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            break
        with scratch() as s:  # of each stage only its rows stay, until the next one has been written
            after = s.keep(materialize(stage(spark, docs, sf_dir), f"stage{k}"))
        discard(docs)
        docs = after
    return stage(spark, docs, sf_dir)
