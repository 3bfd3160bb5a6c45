"""The driver's tables as notes, words and small resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import TITLE_FALLBACK, derive_title
from lexiloom.operators import dictionary, search
from lexiloom.operators.correct import Resources
from lexiloom.operators.tokenize import words
from lexiloom.session import ship, stored, table

EPOCH = 1_704_067_200
MIN_FREQ = dictionary.MIN_WORD_FREQ

#: Replacements that occur in the invented languages of the tables.
TYPOS = (("thnd", "then"), ("thth", "that"), ("ouon", "or"), ("ennt", "enter"), ("onst", "most"))
SLANG = (("nd", "and"), ("th", "the"), ("wh", "which"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: pinned and archived come from labels; very short ones are in the trash."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    created = F.lit(EPOCH) + F.col("doc_id") * 3600
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("notes/"), F.col("doc_id"), F.lit(".md")).alias("path"), derive_title(F.col("text"), TITLE_FALLBACK).alias("title"), F.col("text").alias("body"),
        created.alias("created_at"), (created + F.col("n_chars")).alias("updated_at"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("pinned"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("archived"),
        F.when(F.col("n_chars") < 100, created + F.col("n_chars")).alias("trashed_at"), F.md5("text").alias("content_hash"), F.lit(0).cast("bigint").alias("opened_count"), F.lit(None).cast("bigint").alias("last_opened_at"),
        F.array(F.upper("lang"), "source", F.lower("lang")).alias("tags"), F.lit(False).alias("title_manual"),
    )


_INDEXES: dict[tuple[str, str], search.Index] = {}


def note_index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored search index of the notes, built once in a session and searched often."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        _INDEXES[at] = search.build(notes(spark, sf_dir))
    return _INDEXES[at]


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'")


def vocabulary(spark: SparkSession, sf_dir: str, lang: str, min_freq: int = MIN_FREQ) -> DataFrame:
    """The dictionary of a language of the corpus, with probabilities."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang") == lang)
    return dictionary.with_probability(dictionary.filtered(dictionary.merged(dictionary.from_tokens(words(docs))), typos(spark), min_freq))


def typos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPOS), "wrong string, right string")


def slang(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SLANG), "wrong string, right string")


def resources(spark: SparkSession, sf_dir: str, context: bool = True) -> Resources:
    """Dictionaries and word pairs of the corpus itself: English first, Spanish second. They are
    written once, as an index build would, and every tier of the corrector reads them."""
    ship(spark)
    docs = english(spark, sf_dir)
    pairs = stored(dictionary.pair_counts_of_texts(docs), "pairs") if context else None
    counts = table(spark, sf_dir, "documents").where("lang IN ('en', 'es')")
    counts = stored(words(counts, ("lang",)).groupBy("lang", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("freq")), "counts")
    both = [stored(dictionary.with_probability(dictionary.filtered(dictionary.merged(counts.where(F.col("lang") == lang)), typos(spark))), lang) for lang in ("en", "es")]
    return Resources(*both, typos(spark), slang(spark), pairs)
