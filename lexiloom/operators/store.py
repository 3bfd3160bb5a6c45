"""The note store as tables: list, count, upsert, tags, trash, touch, versions, rebuild.

notes: id, path, title, body, created_at, updated_at (Unix seconds), pinned, archived, trashed_at,
content_hash, opened_count, last_opened_at, tags. Plain tables have no update in place: a change is a
new state computed from the old one and the changes, written beside it and then put in its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom.functions.text import TITLE_FALLBACK, derive_title, slug

LIST_LIMIT = 500
SCHEMA = (
    "id string, path string, title string, body string, created_at bigint, updated_at bigint, pinned boolean, archived boolean, "
    "trashed_at bigint, content_hash string, opened_count bigint, last_opened_at bigint, tags array<string>, title_manual boolean"
)


def live(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("trashed_at").isNull())


def listing(notes: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Live notes outside the archive, pinned first, then by last change; no bodies."""
    columns = [c for c in notes.columns if c != "body"]
    return live(notes).where(~F.col("archived")).select(*columns).orderBy(F.col("pinned").desc(), F.col("updated_at").desc()).limit(limit)


def pinned_and_rest(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return listed.where("pinned"), listed.where("NOT pinned")


def count_live(notes: DataFrame) -> DataFrame:
    return live(notes).agg(F.count(F.lit(1)).alias("n"))


def path_of(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id).select("path")


def tag_rows(notes: DataFrame) -> DataFrame:
    """(id, tag): lower-cased, each once."""
    return notes.select("id", F.explode("tags").alias("tag")).select("id", F.lower("tag").alias("tag")).where("tag <> ''").distinct()


def with_tags(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """notes with the sorted tags of the tag table."""
    grouped = tags.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return notes.drop("tags").join(grouped, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tags_of(tags: DataFrame, notes: DataFrame) -> DataFrame:
    """Tags of notes that are still there."""
    return tags.join(notes.select("id"), "id", "left_semi")


def upsert(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """The state after writing `changed` (the last row of an id by updated_at): an old note keeps its
    created_at and open counters, and comes back from the trash."""
    last = changed.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("content_hash").desc()))).where("_n = 1").drop("_n")
    keep = {"created_at", "opened_count", "last_opened_at"}
    old, new = notes.alias("o"), last.alias("c")
    written = F.col("c.id").isNotNull()
    value = lambda c: F.when(written, F.lit(None)).otherwise(F.col("o.trashed_at")) if c == "trashed_at" else F.coalesce(f"o.{c}", f"c.{c}") if c in keep else F.when(written, F.col(f"c.{c}")).otherwise(F.col(f"o.{c}"))
    return old.join(new, F.col("o.id") == F.col("c.id"), "full_outer").select(*((F.coalesce("o.id", "c.id") if c == "id" else value(c)).alias(c) for c in notes.columns))


def trash(notes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Notes of ids marked as trashed; the path stays as it was."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return notes.join(gone, "id", "left").withColumn("trashed_at", F.when(F.col("_gone"), now.cast("long")).otherwise(F.col("trashed_at"))).select(*notes.columns)


def touched(notes: DataFrame, opens: DataFrame) -> DataFrame:
    """Open counters after a log of (id, ts)."""
    log = opens.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    return notes.join(log, "id", "left").withColumns({"opened_count": F.coalesce("opened_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_opened_at": F.greatest("last_opened_at", F.col("_last"))}).select(*notes.columns)


def open_counts(opens: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    return opens.groupBy(key).agg(F.count(F.lit(1)).alias("opened_count"), F.max(ts).alias("last_opened_at"))


def rejected_pairs(undo: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs of words taken back as often as the threshold."""
    return undo.groupBy(F.lower("from_word").alias("from_word"), F.lower("to_word").alias("to_word")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= threshold)


def versions(notes: DataFrame, at: Column) -> DataFrame:
    """Rows to append to the version table."""
    return notes.select(F.col("id").alias("note_id"), "body", at.cast("long").alias("saved_at"))


def file_name(title: Column, note_id: Column) -> Column:
    return F.concat(slug(title), F.lit("-"), F.lower(F.substring(F.reverse(note_id), 1, 6)), F.lit(".md"))


# Fixed value: the digits of sortable ids.
ID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def sortable_id(milliseconds: Column, random_hex: Column) -> Column:
    """26 digits of base 32: 48 bits of time and 80 of 20 random hexadecimal digits."""
    five = lambda bits: F.array_join(F.transform(F.sequence(F.lit(1), F.length(bits), F.lit(5)), lambda i: F.substring(F.lit(ID_DIGITS), F.conv(F.substring(bits, i, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")
    half = lambda at: F.lpad(F.conv(F.substring(random_hex, at, 10), 16, 2), 40, "0")
    return F.concat(five(F.lpad(F.bin(milliseconds), 50, "0")), five(half(1)), five(half(11)))


def created(bodies: DataFrame, now: Column) -> DataFrame:
    """New notes of a column body: fresh ids, titles from the bodies."""
    new_id = sortable_id(now.cast("long") * 1000, F.regexp_replace(F.uuid(), "-", ""))
    rows = bodies.select(new_id.alias("id"), "body")
    return rows.select(
        "id", file_name(derive_title(F.col("body"), TITLE_FALLBACK), F.col("id")).alias("path"), derive_title(F.col("body"), TITLE_FALLBACK).alias("title"), "body", now.cast("long").alias("created_at"), now.cast("long").alias("updated_at"),
        F.lit(False).alias("pinned"), F.lit(False).alias("archived"), F.lit(None).cast("bigint").alias("trashed_at"), F.lit(None).cast("string").alias("content_hash"), F.lit(0).cast("bigint").alias("opened_count"), F.lit(None).cast("bigint").alias("last_opened_at"),
        F.array().cast("array<string>").alias("tags"), F.lit(False).alias("title_manual"),
    )


def saved(edited: DataFrame, now: Column) -> DataFrame:
    """Notes as they are saved: changed now; titles follow the body unless they were given by hand,
    and a blank one given by hand goes back to following it."""
    by_hand = F.col("title_manual") & (F.trim("title") != "")
    return edited.withColumns({"updated_at": now.cast("long"), "title": F.when(by_hand, F.col("title")).otherwise(derive_title(F.col("body"), TITLE_FALLBACK)), "title_manual": by_hand})


def rebuilt(files: DataFrame) -> DataFrame:
    """The whole note table from parsed files: trash and counters begin anew."""
    return files.select(
        "id", "path", "title", "body", "created_at", "updated_at", "pinned", "archived", F.lit(None).cast("bigint").alias("trashed_at"), "content_hash", F.lit(0).cast("bigint").alias("opened_count"),
        F.lit(None).cast("bigint").alias("last_opened_at"), F.array_distinct(F.transform("tags", lambda t: F.lower(t))).alias("tags"), "title_manual",
    )


def changed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id) of notes whose index rows must be made anew: added, gone, or with other content."""
    both = old.select("id", F.col("content_hash").alias("_a"), F.lit(1).alias("_o")).join(new.select("id", F.col("content_hash").alias("_b"), F.lit(1).alias("_n")), "id", "full_outer")
    return both.where(F.col("_o").isNull() | F.col("_n").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select("id")


# 64-bit FNV-1a.
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> str:
    return f"{_rest(text.encode(), _OFFSET):016x}"


def _rest(data: bytes, h: int) -> int:
    for b in data:
        h = (h ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(texts: list[str]) -> list[str]:
    """fnv1a() of many texts: byte by byte for all of them at once while many are as long, then each alone."""
    data = [t.encode() for t in texts]
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    sizes = np.array([len(data[i]) for i in order], np.int64)
    flat, begin = np.frombuffer(b"".join(data[i] for i in order), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h, prime, at = np.full(len(order), _OFFSET, np.uint64), np.uint64(_PRIME), 0
    while (many := int(np.searchsorted(-sizes, -at))) >= 64:  # so many texts are longer than `at`
        h[:many] = (h[:many] ^ flat[begin[:many] + at]) * prime
        at += 1
    out = [""] * len(data)
    for i, start in zip(order, h.tolist(), strict=True):
        out[i] = f"{_rest(data[i][at:], start):016x}"
    return out


@F.pandas_udf(StringType())
def content_hash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hash of the rendered file, as 16 hexadecimal digits."""
    for t in texts:
        some = t.dropna()
        yield pd.Series(fnv1a_all(some.tolist()), index=some.index, dtype=object).reindex(t.index)
