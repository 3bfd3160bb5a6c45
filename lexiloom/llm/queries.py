"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, decontam, html, jaccard, license, oracles, pieces, pii, prints, quality, sharding, tokenfile, turns, whiten
from lexiloom.session import ship, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.query(table(ship(spark), sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(ship(spark), sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(ship(spark), sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(ship(spark), sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(ship(spark), sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(ship(spark), sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.query(table(ship(spark), sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.query(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.query(table(ship(spark), sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.query(table(ship(spark), sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_text, op2_quality, op3_token_counts, op4_sentencepiece, op5_jaccard_join, op6_decontaminate, op7_pii, op8_hilbert_shards, op9_licenses, op10_token_orc, op11_fingerprints, op12_whitening, op13_conversation_repair)
}

ORACLE_SQL: dict[str, str] = dict(oracles.SQL)
