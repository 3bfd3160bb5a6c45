"""Joins of ranges that overlap.

Half-open ranges are cut into cells of equal width; ranges of one key meet where they have a cell in common, and a pair
is kept once, in the cell where the later of the two begins. Rows meet by key and cell, so one document
with many ranges spreads over many tasks, and work follows the number of ranges and of pairs that overlap, not the square of a document's ranges.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.tokenize import PART, TOKEN, overlaps, tokens, zones
from lexiloom.session import ship

CELL = 256
ZONE = "zone_start int, zone_end int, label string"


def _cell(at: Column, width: int) -> Column:
    return F.floor(at / width)


def _cut(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """rows for each cell that they touch; an empty range touches the one it stands in."""
    return rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), width), _cell(F.greatest(F.col(start), F.col(end) - 1), width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id",), left_range: tuple[str, str] = ("char_start", "char_end"), right_range: tuple[str, str] = ("zone_start", "zone_end"), width: int = CELL) -> DataFrame:
    """All columns of both for every pair of rows with equal keys whose ranges share a position. width: of the order of most
    ranges; a much longer range has a row for each cell on its way through the shuffle. Columns besides the keys must differ."""
    (a, b), (c, d) = left_range, right_range
    both = _cut(left, a, b, width).join(_cut(right, c, d, width), [*keys, "_cell"])
    once = F.col("_cell") == _cell(F.greatest(a, c), width)
    return both.where(once & overlaps(F.col(a), F.col(b), F.col(c), F.col(d))).drop("_cell")


def range_rows(docs: DataFrame, find: Callable[[str], Iterable[tuple[int, int, str]]], keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and ZONE of the ranges that `find` sees in every text, in code points; a table to store and join."""
    ship(docs.sparkSession)
    some = docs.select(*keys, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.drop("_text").schema.fields)

    def made(batch: pa.RecordBatch, found: list[tuple[int, tuple[int, int, str]]]) -> pa.RecordBatch:
        keep = pa.array([i for i, _ in found], pa.int64())
        parts = [pa.array([z[k] for _, z in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(keep) for i in range(len(keys))), *parts], [*keys, *(c.split()[0] for c in ZONE.split(", "))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: list[tuple[int, tuple[int, int, str]]] = []
            for i, t in enumerate(batch.column(len(keys))):
                for z in find(t.as_py()) if t.as_py() else ():
                    found.append((i, z))
                    if len(found) >= PART:
                        yield made(batch, found)
                        found = []
            if found:
                yield made(batch, found)

    return some.mapInArrow(run, f"{kept}, {ZONE}")


def zone_rows(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The protected ranges of every text."""
    return range_rows(docs, zones, keys, text)


def line_rows(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The lines of every text that aren't empty, without their newlines."""
    return range_rows(docs, lambda t: ((*m.span(), "line") for m in re.finditer("[^\n]+", t)), keys, text)


def labelled(words: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("doc_id",), place: str = "pos", width: int = CELL) -> DataFrame:
    """words with `label`, that of the first range by start and end which they touch, or null. place: tells the words of a key apart."""
    near = overlap_join(words.select(*keys, place, "char_start", "char_end"), ranges, keys, width=width)
    first = near.groupBy(*keys, place).agg(F.min(F.struct("zone_start", "zone_end", "label"))["label"].alias("label"))
    return words.join(first, [*keys, place], "left")


def tokens_with(docs: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """tokens() whose protected ranges come from a table: theirs, such as zone_rows() of another day, or ranges that users have marked."""
    plain = tokens(docs, keys, text, zoned=False)
    names = [*keys, *(c.split()[0] for c in TOKEN.split(", "))]
    return labelled(plain, ranges, keys).withColumn("reason", F.coalesce("label", "reason")).select(*names)
