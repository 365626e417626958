"""The training-data pipeline: toxic documents go, one document of each near-duplicate
group stays, personal data is redacted, sources are mixed to their weights, and what the
mix takes is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, the last one the packed pieces. ``run`` writes each result to the shared folder
and reads it back. Nulls, empty texts, repeated rows and further columns are treated as the
operators state; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.mixing import mix
from wayfold.llm.packing import pack
from wayfold.llm.pii import redacted
from wayfold.llm.shared import cleared, keep, shared_folder
from wayfold.llm.simhash import distinct_documents
from wayfold.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted label is not toxic; the network learns from the labels of the
    rows at hand outside the held-out fold."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents with a likeness of 0.8 (five-word shingles)."""
    return distinct_documents(docs, width=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in ``text`` replaced by its kind in brackets."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes; copies keep their ``doc_id``."""
    mixed = mix(docs).where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in packed sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]
#: Models, fingerprints and tokenisers are beyond SQL; the tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES:
        with cleared(spark):  # what a stage keeps for itself goes once its result is written
            docs = keep(stage(spark, docs, sf_dir), folder, name)
    return docs
