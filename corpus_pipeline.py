"""A corpus through five stages: toxicity, line and document duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchglass.llm import line_dedup, packing, pii, simhash_dedup, toxicity
from watchglass.llm.catalogue import tokenizer
from watchglass.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely toxic go; the weights are learnt from the labels of the rest of the corpus."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of nothing else."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, that of the smallest doc_id stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; all documents stay."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut into sequences that hold the mixture of their sources."""
    return packing.pack(docs, tokenizer()).drop("queue")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents),
    ("line_dedup", line_duplicates),
    ("simhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: SQL cannot express the trained and the hashed stages; a brute-force version is in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` through all stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
