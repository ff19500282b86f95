"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    ann, arrow_output, conversation_repair, exact_dedup, fingerprints, lattice, licences, line_dedup, merkle, packing, pii,
    simhash_dedup, toxicity,
)
from .common import table, written


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.held_out()
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "sentences"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer()).drop("queue")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.match_lines(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(fingerprints.fingerprints(table(spark, sf_dir, "documents")), "fingerprinted")
    found = fingerprints.near_counts(made, F.col("doc_id") % 50 == 0)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = lattice.encode(table(spark, sf_dir, "documents"), path)
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_output.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    printed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", printed.alias("fingerprint"), "component_id")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.document_licences(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows)[1]


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).drop("row")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text_now = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, text_now=text_now)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_arrow_output": op6_arrow_output,
    "op7_pii": op7_pii,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_licences": op9_licences,
    "op10_ann": op10_ann,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The others cannot be put into SQL that ends on whole tables; tests hold them against brute force.
SQL: dict[str, str] = {
    "op12_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
        FROM texts WINDOW w AS (PARTITION BY t)
    """,
}
