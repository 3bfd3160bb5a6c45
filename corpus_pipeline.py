"""The corpus pipeline: quality rules, near-duplicate join, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Columns of other names
that docs may have are left out at the first stage that returns documents.

Defined results: a null or empty text fails the first stage's rules and goes; rows with a null
doc_id are in no group and stay past the join; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import decontam, jaccard, pieces, pii, quality
from lexiloom.llm.checkpoints import cut
from lexiloom.llm.queries import tokenizer_file
from lexiloom.session import ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the verdict's policy rejects."""
    return quality.kept_rows(docs.select(*COLUMNS), quality.POLICIES[quality.DEFAULT])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.75 or more, the one of least doc_id; of rows
    with one doc_id, the one of least text fingerprint. Documents without words are in no group and stay.
    The join and the choice among repeated rows share one partitioning by doc_id."""
    found = jaccard.join_components(docs)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).orderBy(F.xxhash64("text", "n_chars"))
    return left.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark table."""
    return decontam.clean_rows(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kinds; n_chars follows the text."""
    redacted = pii.redact(docs.select(*COLUMNS))
    return redacted.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return pieces.encode_digests(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("tokens", tokens),
]

#: Token ids and their digests aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
