"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import linededup, packing, quality, simhash, toxicity
from quillet.llm._common import save, table
from quillet.llm.queries import tokenizer


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; null texts are scored as empty ones, repeated rows alike."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go; null texts are scored as empty ones, repeated rows alike."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source leave the texts; n_chars follows the text."""
    out = linededup.clean(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates stays (five-word shingles,
    similarity from 0.8). Rows that repeat an id are one document; rows without an id stay."""
    groups = simhash.near_duplicates(docs, shingle=5)
    gone = save(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; null texts are empty ones, repeated rows documents of
    their own."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("simhash", stage_simhash),
    ("packing", stage_packing),
]

#: Fitted models and tokenizers aren't SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each on the written rows of the one before.
    Empty tables give no rows; extra columns go along up to packing, which returns its own."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs)
    return docs
