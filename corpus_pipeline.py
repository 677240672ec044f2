"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; ``run`` writes it as Parquet to
the shared folder and reads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.llm import bpe, decontam, jaccard, langid, pii
from stratalog.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter and those too far from every
    centroid go. ``lang`` stays as it was, and is not looked at for the decision."""
    model = langid.learn(docs, ~langid.held_out())
    found = langid.identify(docs, model, keep=("lang", "source", "n_chars"))
    return found.where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, one with the smallest id. Components are those of
    five-word Jaccard similarity 0.8 or more: SimHash finds the pairs, which are then verified
    exactly. Rows are told apart by more than their id, so repeated and null ids are no exception.
    Documents without a word are no copies of each other's content and all stay."""
    return jaccard.without_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked, each row judged by its own text."""
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    found = pii.find(docs, keep=("lang", "source"))
    return found.withColumn("text", pii.redact(F.col("text"), F.col("spans"))).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again to tell that nothing was lost."""
    out = bpe.round_trip(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: No stage but the fourth has a SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
