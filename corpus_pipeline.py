"""A corpus from raw documents to packed sequences: each stage works on what its predecessor kept.

run() applies the stages to `documents`; each result is written as Parquet in the shared folder and read again as the next stage's input.

Defined cases, in all stages: columns of any names are carried up to the last stage; an empty table gives no rows. A null text is judged,
compared and scanned as an empty one and has no words, so the mix leaves it out. All texts without words are near copies of each other. A
null doc_id comes last among near copies. Repeated rows are one group of near copies. Null sources are one source. Very long texts are
read whole; only the packing cuts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tractspark.llm import mixing, packing, quality, secrets, simhash
from tractspark.llm.common import materialise
from tractspark.llm.queries import CAPACITY, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific credentials replaced; widely copied examples stay."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its ids, sequence and place; row_id tells the copies of a document apart that the mix takes."""
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY, keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_copies),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: A classifier and a tokenizer aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
