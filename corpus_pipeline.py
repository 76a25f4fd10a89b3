"""The corpus pipeline: stages over `documents`, each written and reread as the next one's input.

Quality rules, MinHash near-duplicates, repeated passages, benchmark decontamination, packing. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import decontam, minhash, packing, quality, substring
from factloom.llm.common import table, table_if_any, written

#: Shingles of five words and a similarity of 0.8, as for every near-duplicate stage.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, held to `labels` where the folder has them. Null and empty texts go, repeated rows stay or go each."""
    return quality.judged(docs, labels=table_if_any(spark, sf_dir, "labels")).where("kept").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Rows without doc_id stay."""
    found = minhash.near_duplicates(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document holds; n_chars follows the text. Null and short texts stay as they are, repeated rows are cut alike."""
    found = substring.passages(docs, k=SHINGLE_WORDS, similarity=SIMILAR_PERCENT / 100)
    cut = found.withColumn("cut", substring.without_spans(F.col("row.text"), F.col("spans")))
    new = {"text": F.col("cut"), "n_chars": F.when(F.size("spans") > 0, F.length("cut").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay, repeated rows stay or go each."""
    return decontam.scan(docs, table(spark, sf_dir, "benchmark"), similarity=SIMILAR_PERCENT / 100).where(F.size("matches") == 0).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in bins. Null and empty texts have a row without a bin, repeated rows are packed each."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", good_quality),
    ("minhash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]
#: Min-max hashing, chaining, edit distances and packing aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
