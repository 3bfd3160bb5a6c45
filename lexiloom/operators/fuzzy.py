"""The fuzzy join of words with a dictionary, and the scores of its candidates.

Two words within k edits share a delete variant, so an equi-join on variants finds every pair; the
length gap, then a restricted edit distance in Arrow batches, decide. Typed words are made distinct
first: the join's size follows the vocabulary, not the text. Variants are 64-bit hashes made in Arrow batches; those of
typed words that no dictionary word has are left out by a bitmap of fixed size before anything is shuffled. A hash or
a bit that two variants share makes a candidate too many, which the distance drops.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.columns import small
from lexiloom.functions.edits import codes, osa_distance, typing_cost
from lexiloom.operators.dictionary import PREFIX
from lexiloom.session import ship

# ---- fixed values -------------------------------------------------------------------------
COST_WEIGHT = 5.0
RESULTS = 8
SMOOTH = 0.5
#: Letters of which the join's variants are made; short prefixes are shared by many words that aren't near.
JOIN_PREFIX = 12
#: Bits of the bitmap of a dictionary's variants (a power of two), at most, and for each word.
BITMAP_BITS, BITS_A_WORD = 27, 1024
#: Slices in which a bitmap is made (a power of two).
SLICES = 1 << 6
# ---- end of fixed values ------------------------------------------------------------------


@cache
def _weights(n: int, max_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of n letters a column for each way to delete up to max_edit of them, but not all: what each letter counts at its
    place in what is left; and how many are deleted, in the lowest 4 bits, and where the first two, in the next."""
    places = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        places = (places ^ places >> np.uint64(shift)) * np.uint64(by)
    ways = [gone for d in range(min(max_edit, n - 1) + 1) for gone in combinations(range(n), d)]
    out = np.zeros((n, len(ways)), np.uint64)
    for column, gone in enumerate(ways):
        out[[i for i in range(n) if i not in gone], column] = places[: n - len(gone)]
    return out, np.array([len(g) + sum(x << 4 * i for i, x in enumerate(g[:2], 1)) for g in ways], np.int32)


def hashed_variants(words: pa.Array, max_edit: int, prefix: int = JOIN_PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the delete variants of each word's prefix, never empty, the word's number, a hash and what is deleted."""
    letters, size = codes([w[:prefix] for w in words.to_pylist()])
    rows, found, deleted = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        weights, marks = _weights(int(n), max_edit)
        sums = (letters[at, :n].astype(np.uint64) + np.uint64(1)) @ weights
        rows.append(np.repeat(at, sums.shape[1]))
        found.append(((sums ^ sums >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)).ravel())
        deleted.append(np.tile(marks, len(at)))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(deleted)


def _aligned(max_edit: int) -> Column:
    """Whether what was deleted from the two words may be max_edit edits; decided for up to two, of words that weren't cut.
    Words of one length that lose so many letters each have only letters changed or swapped, so each letter stands where one of the
    other word does, or beside it. Of two edits that take one letter and two, one adds a letter and the other is such a change."""
    if max_edit > 2:
        return F.lit(True)
    n = lambda c: F.col(c).bitwiseAND(15)
    at = lambda c, i: F.shiftright(F.col(c), 4 * i).bitwiseAND(15)
    beside = lambda a, b: F.abs(a - b) <= 1
    a, b = "typed_lost", "word_lost"
    test = F.when((n(a) == max_edit) & (n(b) == max_edit), reduce(lambda x, y: x & y, (beside(at(a, i), at(b, i)) for i in range(1, max_edit + 1))))
    if max_edit == 2:
        for one, two in ((a, b), (b, a)):
            test = test.when((n(one) == 1) & (n(two) == 2), beside(at(one, 1), at(two, 1)) | beside(at(one, 1) + 1, at(two, 2)))
    return test.otherwise(True) | (F.greatest(F.length("typed"), F.length("word")) > JOIN_PREFIX)


def _slot(hashes: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """The first or second place of variants in a bitmap."""
    return ((hashes if turn == 0 else hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(dictionary: DataFrame, max_edit: int) -> np.ndarray:
    """A bitmap in which each variant of the dictionary has its places; slices are made in tasks and put together."""
    bits = min(BITMAP_BITS, max(16, (dictionary.count() * BITS_A_WORD).bit_length()))
    width = (1 << bits) // SLICES

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hashes = hashed_variants(batch.column(0), max_edit)[1]
            both = np.unique(np.concatenate([_slot(hashes, bits, turn) for turn in (0, 1)]))
            cuts = np.searchsorted(both, np.arange(SLICES + 1) * width)
            offsets = pa.array((cuts * 4).astype(np.int32)).buffers()[1]
            some = pa.Array.from_buffers(pa.binary(), SLICES, [None, offsets, pa.py_buffer((both % width).astype("<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), some], ["slice", "places"])

    def slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in it:
            for at, some in zip(*batch.to_pydict().values(), strict=True):
                made.setdefault(at, np.zeros(width, bool))[np.frombuffer(some, "<u4")] = True
        for at, slots in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(slots, bitorder="little").tobytes()])], ["slice", "bits"])

    out = np.zeros((SLICES, width // 8), np.uint8)
    for r in dictionary.select("word").mapInArrow(places, "slice int, places binary").repartition("slice").mapInArrow(slices, "slice int, bits binary").collect():  # as many bytes as the bitmap has
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _hashed(words: DataFrame, name: str, max_edit: int, bitmap=None) -> DataFrame:
    """(hash, name, what is deleted) for each variant of the words; with a bitmap, for those that may be in it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, hashes, lost = hashed_variants(batch.column(0), max_edit)
            if bitmap is not None:
                known = bitmap.value
                for turn in (0, 1):
                    at = _slot(hashes, (len(known) * 8).bit_length() - 1, turn)
                    there = (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                    rows, hashes, lost = rows[there], hashes[there], lost[there]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array(lost)], ["hash", name, f"{name}_lost"])

    return words.select(F.col(name)).mapInArrow(run, f"hash bigint, {name} string, {name}_lost int")


def matches(typed: DataFrame, dictionary: DataFrame, max_edit: int) -> DataFrame:
    """Distinct (typed, word, distance <= max_edit); typed has a column `typed`, the dictionary `word`. The dictionary is read
    three times: one that takes time to make should be stored before."""
    spark = ship(typed.sparkSession)
    some = dictionary.select("word").where("word IS NOT NULL")
    known = spark.sparkContext.broadcast(_bitmap(some, max_edit))
    left = _hashed(typed.select(F.lower("typed").alias("typed")).where("typed <> ''").distinct(), "typed", max_edit, known)
    # a hint, as the variants' size is taken for that of their words, and a table of them all must not go to the driver
    return within(left.join(_hashed(some, "word", max_edit).hint("merge"), "hash").where(_aligned(max_edit)), max_edit, JOIN_PREFIX)


def within(joined: DataFrame, max_edit: int, prefix: int = PREFIX) -> DataFrame:
    """Of (typed, word) that share a variant of their prefixes, once each those within max_edit, with their distance."""
    near = joined.where(F.abs(F.length("typed") - F.length("word")) <= max_edit).select("typed", "word").distinct()
    # a transposition is two plain edits, so a pair within k has a plain distance within 2 k, as have all that share a variant of the whole
    whole = F.greatest(F.length("typed"), F.length("word")) <= prefix
    likely = near.where(whole | (F.levenshtein("typed", "word", 2 * max_edit) >= 0))
    return likely.withColumn("distance", osa_distance("typed", "word")).where(F.col("distance") <= max_edit)


def candidates(typed: DataFrame, dictionary: DataFrame, max_edit: int = 2, n: int | None = RESULTS, found: DataFrame | None = None) -> DataFrame:
    """typed, word, distance, cost, freq, log_prob, score and place among the typed word's first n:
    an equal word first, then by score, then by word. n: a top-n report; None gives all. found: matches() from
    another source, such as a stored index of variants."""
    found = (matches(typed, dictionary, max_edit) if found is None else found).withColumn("cost", typing_cost("typed", "word")).join(dictionary.select("word", "freq", "log_prob"), "word")
    scored = found.withColumn("score", F.col("log_prob") - COST_WEIGHT * F.col("cost"))
    w = Window.partitionBy("typed").orderBy((F.col("distance") == 0).desc(), F.col("score").desc(), "word")
    out = scored.withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= n) if n is not None else out


def with_context(rows: DataFrame, pairs: DataFrame, word: str = "word") -> DataFrame:
    """rows (with prev_word and next_word) with left_count, right_count, context (the sum of
    ln(count + 0.5) over the neighbours there are) and evidence (how many pairs have been seen)."""
    counts = pairs.select(F.col("left").alias("_l"), F.col("right").alias("_r"), "count")
    prev, nxt = F.lower("prev_word"), F.lower("next_word")
    out = rows.join(counts.withColumnRenamed("count", "left_count"), (prev == F.col("_l")) & (F.col(word) == F.col("_r")), "left").drop("_l", "_r")
    out = out.join(counts.withColumnRenamed("count", "right_count"), (F.col(word) == F.col("_l")) & (nxt == F.col("_r")), "left").drop("_l", "_r")
    part = lambda neighbour, c: F.when(F.col(neighbour).isNull(), F.lit(0.0)).otherwise(F.log(F.coalesce(F.col(c), F.lit(0)) + SMOOTH))
    seen = lambda c: F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
    return out.withColumns(
        {
            "context": part("prev_word", "left_count") + part("next_word", "right_count"),
            "evidence": seen("left_count") + seen("right_count"),
            "left_count": F.coalesce("left_count", F.lit(0)),
            "right_count": F.coalesce("right_count", F.lit(0)),
        }
    )


def replaced(toks: DataFrame, table: DataFrame) -> DataFrame:
    """toks with `right`, the table's replacement of the word in any case, or null."""
    return toks.join(small(table.select(F.col("wrong").alias("_wrong"), "right")), F.lower("word") == F.col("_wrong"), "left").drop("_wrong")


def unknown_to(toks: DataFrame, user_words: DataFrame) -> DataFrame:
    """Words that aren't in the personal dictionary."""
    known = user_words.select(F.lower("word").alias("_known")).distinct()
    return toks.join(known, F.lower("word") == F.col("_known"), "left_anti")


def not_rejected(corrections: DataFrame, undo: DataFrame, threshold: int = 2) -> DataFrame:
    """Corrections whose pair of words has been taken back fewer times than the threshold."""
    often = undo.groupBy(F.lower("from_word").alias("_f"), F.lower("to_word").alias("_t")).agg(F.sum("count").alias("_n")).where(F.col("_n") >= threshold)
    return corrections.join(often, (F.lower("from") == F.col("_f")) & (F.lower("to") == F.col("_t")), "left_anti")
