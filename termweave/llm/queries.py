"""The queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.lsh_forest import links

    return links(table(spark, sf_dir, "documents"), threshold=0.8, k=5)


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.suffix_tree import score

    return score(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.simhash import compare_edits

    return compare_edits(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.suffix_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"), least=50)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    scored = score(docs, train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=2048, end_id=1)


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.paragraphs import duplicates

    return duplicates(table(spark, sf_dir, "documents"), threshold=0.8, k=5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.mixing import weigh

    return weigh(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {}
