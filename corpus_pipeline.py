"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut, sources
are mixed to target weights, and what is left is packed. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import lsh_forest, mixing, packing, suffix_dedup, toxicity
from termweave.llm.common import Staging, table
from termweave.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below 0.3; trained on labels outside the held-out fold. A null text scores as an
    empty one; rows with null or equal keys are judged each by its text."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.3).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id (null last), of each class of the n-gram Jaccard join; rows equal in doc_id and text
    are one. Rows without words, or with a null text, are copies of nothing and stay."""
    return lsh_forest.first_of_classes(docs, threshold=0.8, k=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages of 50 words or more that an earlier row, or place, has; those whose words are all cut
    go. n_chars is counted anew. Rows with a null doc_id or text lose nothing and take nothing from others; other rows
    of a doc_id keep their words."""
    staging = Staging(spark)
    cut = suffix_dedup.remove(docs, staging.put(suffix_dedup.repeats(docs, least=50, staging=staging), "spans"), emptied=False)
    counted = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else cut
    return counted.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by the raked weights of their source, language (null: a value of its own) and topic; rows equal in
    doc_id and text are drawn alike, others each by itself."""
    return mixing.drawn(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048; a null text is an empty one, and rows with null or
    equal keys are packed each by itself."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), size=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: The classifier and the draw can't be said in SQL; tests/llm holds every stage against what it must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = staging.put(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            staging.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
