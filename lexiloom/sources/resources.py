"""Text resources of the corrector: replacement tables, word lists, word pairs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexiloom.sources import versions

TABLE = "wrong string, right string"

#: Small tables of our own, for trials and tests; real ones are read from files.
TYPOS = (("teh", "the"), ("adn", "and"), ("hte", "the"), ("taht", "that"), ("wiht", "with"), ("recieve", "receive"), ("thier", "their"), ("becuase", "because"), ("yagn", "yang"), ("dnegan", "dengan"))
SLANG = (("gk", "tidak"), ("yg", "yang"), ("tdk", "tidak"), ("bgt", "banget"), ("dgn", "dengan"), ("krn", "karena"), ("u", "you"), ("thx", "thanks"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file or folder: n counts the lines of each file from 0. Splits of a file are read by tasks
    of their own: a line's number is its place in its split and the number of lines in the splits before, which one row
    for each split says."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    splits = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"), F.min("place").alias("first"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "split", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(begins), ["file", "split"]).select((F.col("place") + F.col("shift")).alias("n"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def replacements(lines: DataFrame) -> DataFrame:
    """(wrong, right) of lines `wrong<TAB>right`: blank lines, comments, lines without a tab, empty
    sides and words that stay as they are are skipped; a later line overrides."""
    bare = lines.where(~F.trim("line").startswith("#") & F.col("line").contains("\t"))
    pair = bare.select("n", F.lower(F.trim(F.split("line", "\t", 2)[0])).alias("wrong"), F.trim(F.split("line", "\t", 2)[1]).alias("right"))
    return pair.where("wrong <> '' AND right <> '' AND wrong <> lower(right)").groupBy("wrong").agg(F.max_by("right", "n").alias("right"))


def word_list(lines: DataFrame) -> DataFrame:
    """(word, freq) of lines `word` or `word freq`: a word without a number gets one from its rank,
    so earlier words count more; comments and blank lines are skipped; a frequency is 1 at least."""
    total = lines.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = lines.withColumn("_total", total).withColumn("_t", F.trim("line")).where("_t <> '' AND NOT startswith(_t, '#')")
    parts = F.split("_t", r"\s+")
    freq = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
    return rows.select(parts[0].alias("word"), F.greatest(F.coalesce(freq, F.col("_total") - F.col("n")), F.lit(1)).alias("freq"))


def pair_list(lines: DataFrame) -> DataFrame:
    """(left, right, count) of lines `left<TAB>right<TAB>count`: lower-cased, bad counts skipped, equal pairs summed."""
    p = F.split("line", "\t")
    rows = lines.where(~F.trim("line").startswith("#")).select(F.lower(F.trim(p[0])).alias("left"), F.lower(F.trim(F.try_element_at(p, F.lit(2)))).alias("right"), F.trim(F.try_element_at(p, F.lit(3))).try_cast("bigint").alias("count"))
    return rows.where("left <> '' AND right <> '' AND count IS NOT NULL").groupBy("left", "right").agg(F.sum("count").alias("count"))


def or_empty(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """What `read` makes of the lines at path, or no rows if nothing is there."""
    try:
        return read(numbered(spark, path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def dictionary_folder(installed: str | None, source: str, spark: SparkSession | None = None) -> str:
    """The installed folder if it is there, else the one of the source tree. With a session the folder may be any
    that its file systems know, given as a URI."""
    if not installed:
        return source
    there = versions.is_folder(spark, installed) if spark is not None else Path(installed).is_dir()
    return installed if there else source


def built_in(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The small typo and slang tables."""
    return spark.createDataFrame(list(TYPOS), TABLE), spark.createDataFrame(list(SLANG), TABLE)
