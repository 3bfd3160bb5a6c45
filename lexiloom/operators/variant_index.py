"""A stored index of a dictionary's delete variants.

Variants are kept as 64-bit hashes in a table in buckets of the hash, made once; searches for typed words join it where it
lies, so only the typed words' variants are shuffled. Words are added as further files of the same buckets. Two variants of one hash make a
candidate too many, which the edit distance drops, so results are those of `fuzzy.matches`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import fuzzy
from lexiloom.operators.dictionary import MAX_EDIT, variants
from lexiloom.session import ship

BUCKETS = 32


class VariantIndex:
    """An index at a path, known to the session's catalog under a name of its own."""

    def __init__(self, spark: SparkSession, path: str, max_edit: int = MAX_EDIT, buckets: int = BUCKETS):
        self.spark, self.path, self.max_edit, self.buckets = ship(spark), path, max_edit, buckets
        self.name = f"variants_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (hash BIGINT, word STRING) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{path}'")

    def add(self, words: DataFrame) -> None:
        """Index more words; one that is there already may be added again."""
        rows = variants(words.select("word").distinct(), self.max_edit).select(F.xxhash64("variant").alias("hash"), "word")
        rows.repartition(self.buckets, "hash").sortWithinPartitions("hash").write.mode("append").format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def matches(self, typed: DataFrame, max_edit: int | None = None) -> DataFrame:
        """fuzzy.matches() with the words of the index, up to its number of edits."""
        k = self.max_edit if max_edit is None else max_edit
        if k > self.max_edit:
            raise ValueError(f"the index has variants of {self.max_edit} edits")
        left = variants(typed.select(F.lower("typed").alias("typed")).where("typed <> ''").distinct(), k, "typed")
        return fuzzy.within(left.withColumn("hash", F.xxhash64("variant")).join(self.table(), "hash"), k)
