"""The corpus pipeline: operators of airloom.llm applied to documents one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airloom.llm import chunk_dedup, common, decontaminate, minhash_dedup, piece_codec, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with passages that an earlier document holds cut out; n_chars counted again."""
    return chunk_dedup.cut_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes of each document."""
    import public_tokenizers

    return piece_codec.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


#: Applied in this order.
STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("piece_encoding", pieces),
]

#: No SQL expresses the fitted stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage written as Parquet in the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = common.finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        common.forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
