"""Documents to training sequences: language, exact and near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, exact_dedup, lang_id, packing, simhash_dedup
from lodestar.llm.common import shared_folder, small_batches
from lodestar.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts, texts without a letter, and texts of which no language makes up half.

    The model learns from the lang column; where no row has one, only the first two are
    rejected. Repeated rows, null ids and further columns pass through.
    """
    small_batches(spark)
    return lang_id.keep_known(docs, lang_id.train(docs), least=0.5)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of texts that are equal but for the case of A-Z the row with the smallest doc_id; null and empty texts are equal."""
    return exact_dedup.drop_exact_duplicates(docs, keep="min")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each group that links of similarity 0.8 over five-word shingles connect.

    Deletion variants of SimHash segments propose the links, the sets of shingles decide.
    """
    small_batches(spark)
    return simhash_dedup.drop_near_duplicates(docs, words=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a passage that is 0.8 similar to a benchmark item; without items, none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; no documents, no pieces."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_leaks), ("packing", packed)]

#: Fingerprints, language models and packing are beyond SQL; tests/llm/test_near.py holds run() against brute-force near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet to the shared folder and read again."""
    import uuid

    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{i}-{name}")
            docs = spark.read.parquet(path)
    return docs
