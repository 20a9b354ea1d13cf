"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes what the one before it has written and returned, and works on all of it. All but the last return the
columns of documents; the last returns the places of all documents in packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import mixing, neardup, packing, pii, quality_rules
from folioworks.llm.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, one stays."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to target weights: blocks not drawn go, blocks drawn again come again."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document has its place in a packed sequence. The mix may hold several texts of one id; text_id, the hash of
    the text, says which of them lies where."""
    return packing.pack(docs.select("doc_id", "text"), carry={"text_id": F.xxhash64("text")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: No stage but the rules' base part can be said in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet in the shared folder and read as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
