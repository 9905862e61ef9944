"""From raw documents to token ids: five stages, each a corpus operator over all that the one before kept.

Toxic documents go, one document of each group of near-duplicates stays, benchmark passages are
cut out (documents that are mostly such passages go), secrets are masked, and what is left
becomes token ids. Stages hand over Parquet tables; all but the last have the columns of
`documents`. `ORACLE_SQL` is None, as SQL can't express the first stage's classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, decontaminate, near_dedup, secret_scan, toxicity
from lakeloom.session import cut_lineage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit. A null or empty text has no toxic passage and stays; without labels of both classes all stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates. Null and empty texts are in no group and stay; repeated rows stay or go together."""
    return near_dedup.keep_first(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out. Null and empty texts, and an empty benchmark, change nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked and, where there is such a column, `n_chars` counted again. A null text stays null."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents with digests of their token ids. A null or empty text has no tokens. `docs` is a stored table's rows."""
    return bpe.digests(docs, stored=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secret_scans", mask_secrets),
    ("byte_bpe", to_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
