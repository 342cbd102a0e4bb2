"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pvspark.llm import chat, classifier, decontaminate, jaccard, language, license, lines, merkle, packing, quality, records, trie, vectors

#: The vocabulary file of op7 and op10.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    try:
        import public_tokenizers
    except ImportError:
        return str(Path("/opt/tokenizers") / VOCABULARY)
    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict per document."""
    return quality.quality_rules(_table(spark, folder, "documents"))


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out."""
    return trie.language_model(_table(spark, folder, "documents"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License sentences and licenses per document."""
    return license.scan_licenses(_table(spark, folder, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the items and scores."""
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior quality per document; a path is a language of a source."""
    return classifier.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the lines that repeat another one, nearly or exactly."""
    return lines.duplicate_lines(_table(spark, folder, "documents")).drop("content")


def op7_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written as records and read back by their index."""
    manifest = records.write_records(_table(spark, folder, "documents"), vocabulary(), end=2)
    return records.read_records(spark, manifest)


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Group of near copies per document."""
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.render(_table(spark, folder, "conversations"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack_documents(_table(spark, folder, "documents"), vocabulary())


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and folded root per document."""
    return merkle.verify(_table(spark, folder, "documents"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector."""
    return vectors.encode(_table(spark, folder, "embeddings"))


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of every document, learned from those that are not held out."""
    return language.identify(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_lm_scoring, op3_license_scan, op4_benchmark_decontamination, op5_quality_classifier,
        op6_line_dedup, op7_token_records, op8_ngram_jaccard, op9_chat_formatting, op10_packing, op11_merkle_manifest,
        op12_vector_codes, op13_language_id,
    )
}
