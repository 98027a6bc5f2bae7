"""The queries of the operators in this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionlake.llm import (
    bpe,
    chaining,
    cover_tree,
    entropy_mix,
    license_scan,
    line_dedup,
    media_chunks,
    minmax_dedup,
    oracles,
    resampling,
    style_tree,
    toxicity,
    vector_codes,
    web_archive,
)
from ionlake.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_scan.document_files(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_table(table(spark, sf_dir, "documents"))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_texts(table(spark, sf_dir, "pages"))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.similar_documents(table(spark, sf_dir, "documents"), words=2)


def op9_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.archived(table(spark, sf_dir, "pages")).drop("record_bytes")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_OPERATORS = (
    op1_license_scan, op2_cover_tree, op3_media_chunks, op4_entropy_mix, op5_line_dedup, op6_bpe, op7_style_tree, op8_minmax_dedup, op9_chaining, op10_toxicity,
    op11_vector_codes, op12_web_archive, op13_resampling,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
