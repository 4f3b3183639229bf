"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

toxicity          documents that the tagger scores 0.5 or more go
near_duplicates   one document of each SimHash group stays, that of the smallest id
decontamination   documents with benchmark passages over the contract's share go
secrets           live-looking credentials are masked; every document stays
mix               sources are mixed to target weights: ``taken`` words of each document

Defined cases, for every stage: null, empty and very long texts, null ids and columns, ties and repeated rows pass as the
operators state; an empty table gives an empty one; extra columns of any name pass through unchanged.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet and rereads it as the next stage's input. All stages but
the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenledger.llm import decontaminate as _decontaminate
from tokenledger.llm import mixing, simhash, toxicity as _toxicity
from tokenledger.llm import secrets as _secrets
from tokenledger.llm.staging import prepare, stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the conditional random field finds toxic."""
    prepare(spark)
    return _toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near duplicates."""
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by benchmark items."""
    prepare(spark)
    return _decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask live-looking credentials."""
    prepare(spark)
    return _secrets.redact(docs, *_secrets.holders())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, source_size, target and taken added."""
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("mix", mix)]

#: the tagger's scores and the fingerprints cannot be expressed in SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
