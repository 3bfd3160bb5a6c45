"""Dictionaries: filters, merging, probabilities, delete variants, word pairs and readiness."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.tokenize import spans
from lexiloom.session import ship

# ---- fixed values -------------------------------------------------------------------------
MIN_WORD_FREQ = 25
MIN_DICT_SIZE = 5_000
PREFIX = 7
MAX_EDIT = 2
#: Bytes of the texts whose pairs a Python worker counts at once.
PART = 1 << 22
#: Pairs are dealt to so many buckets (a power of two, 16 at most).
BUCKET_BITS = 12
#: Bytes of packed counts that a Python worker adds up at once, and rows that it puts out at once.
HELD = 1 << 24
ROWS = 1 << 17
# ---- end of fixed values ------------------------------------------------------------------

_GAP = re.compile(rb"[\x00-&(-/:-@\[-`{-\x7f]")


def from_tokens(toks: DataFrame) -> DataFrame:
    """(word, freq) of a corpus: lower-cased words and how often they occur."""
    return toks.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("freq"))


def filtered(words: DataFrame, typos: DataFrame | None = None, min_freq: int = MIN_WORD_FREQ) -> DataFrame:
    """Words frequent enough that aren't known typos."""
    kept = words.where(F.col("freq") >= min_freq)
    return kept if typos is None else kept.join(typos.select(F.col("wrong").alias("word")), "word", "left_anti")


def merged(*lists: DataFrame) -> DataFrame:
    """Word lists put together: trimmed, lower-cased, the greatest frequency of each word."""
    union = lists[0].select("word", "freq")
    for other in lists[1:]:
        union = union.unionByName(other.select("word", "freq"))
    return union.select(F.lower(F.trim("word")).alias("word"), "freq").where("word <> ''").groupBy("word").agg(F.max("freq").alias("freq"))


def with_probability(words: DataFrame) -> DataFrame:
    """words with log_prob, the logarithm of each word's share of all frequencies."""
    total = words.agg(F.greatest(F.coalesce(F.sum("freq"), F.lit(0)), F.lit(1)).alias("total")).scalar()
    return words.withColumn("log_prob", F.log(F.greatest("freq", F.lit(1)) / total))


def delete_variants(word: Column, max_edit: int = MAX_EDIT, prefix: int = PREFIX) -> Column:
    """The word's prefix and what is left of it after up to max_edit deletions, never empty."""
    drop_one = lambda s: F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
    layer = F.array(F.substring(word, 1, prefix))
    out = layer
    for _ in range(max_edit):
        layer = F.array_distinct(F.flatten(F.transform(layer, drop_one)))
        out = F.concat(out, layer)
    return F.array_distinct(out)


def variants(words: DataFrame, max_edit: int = MAX_EDIT, word: str = "word") -> DataFrame:
    """words with a row for each delete variant."""
    return words.withColumn("variant", F.explode(delete_variants(F.col(word), max_edit)))


def pair_counts_of_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(left, right, count) of neighbouring words of each text, lower-cased. Pairs are counted in parts of texts of bounded size,
    so only counts are shuffled: packed in a row for each bucket of pairs, not in a row for each pair. Then each bucket's
    counts are added up."""
    ship(docs.sparkSession)
    packed = docs.select(F.col(text).alias("text")).mapInArrow(_packed_counts, "bucket int, pairs string, counts array<bigint>")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_added_counts, "left string, right string, count bigint")


def _packed_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _parts(it):
        if len(texts) > 1 or texts.nbytes <= PART:
            yield _counts(texts)[0]
            continue
        last = b""
        for piece in _pieces(texts.view(pa.binary())[0].as_py()):
            rows, last = _counts(pa.array([last + b"\n" + piece], pa.binary()).view(pa.string()))
            yield rows


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """Texts in arrays of PART bytes at most; a text of more is alone."""
    held, size = [], 0
    for batch in it:
        texts = batch.column(0).cast(pa.string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        at = done = 0
        while at < len(texts):
            to = max(int(np.searchsorted(ends, done + PART - size, side="right")), at + (not held))
            if to > at:
                held.append(texts.slice(at, to - at))
                size += int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
            if at < len(texts):
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut between words into pieces of about PART bytes; a piece gets longer where no ASCII mark or space comes."""
    at = 0
    while len(text) - at > PART and (gap := _GAP.search(text, at + PART)) is not None:
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def _counts(texts: pa.Array) -> tuple[pa.RecordBatch, bytes]:
    """Counts of the pairs of some texts, a row for each bucket, and the last word as it was written."""
    try:
        words, at, last = spans(texts)
    except UnicodeDecodeError:
        words, at, last = spans(pa.array([t.decode("utf-8", "replace") for t in texts.view(pa.binary()).to_pylist()], pa.string()))
    coded = words.dictionary_encode()
    hard = pc.invert(pc.string_is_ascii(coded.dictionary))
    lower = pa.array("\n".join(coded.dictionary.filter(hard).to_pylist()).lower().split("\n"), pa.string())
    again = pc.replace_with_mask(coded.dictionary, hard, lower).dictionary_encode()
    found, numbers = again.dictionary, again.indices.to_numpy().astype(np.int64)[coded.indices.to_numpy()]
    together = np.ones(max(len(numbers) - 1, 0), bool)
    together[at[(at > 0) & (at < len(numbers))] - 1] = False
    pairs, counts = np.unique((numbers[:-1] * len(found) + numbers[1:])[together], return_counts=True)
    left, right = np.divmod(pairs, max(len(found), 1))
    sums = _checksums(found)
    mixed = (sums[left] * np.uint64(0x9E3779B97F4A7C15) ^ sums[right]) * np.uint64(0xD6E8FEB86659FD93)
    buckets = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(buckets, kind="stable")
    rows, first = np.unique(buckets[order], return_index=True)
    ends = np.append(first, len(order)).astype(np.int32)
    side_by_side = np.stack([left[order], right[order]], axis=1).ravel()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends * 2), found.take(pa.array(side_by_side))), " ")
    return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), joined, pa.ListArray.from_arrays(pa.array(ends), pa.array(counts[order]))], ["bucket", "pairs", "counts"]), last


def _checksums(words: pa.Array) -> np.ndarray:
    """A number for each word, by its bytes alone."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
    starts = np.append(0, ends[:-1])
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "").buffers()[2], np.uint8)[: ends[-1]]
    powers = np.multiply.accumulate(np.full(int((ends - starts).max()), 0x9E3779B97F4A7C55, np.uint64))
    return np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, ends - starts)], starts)


def _added_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their buckets. Whole buckets are added up as soon as they have HELD bytes."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        step = max(batch.num_rows * HELD // max(batch.nbytes, 1), 1)
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            if sum(b.nbytes for b in held) < HELD:
                continue
            rows = pa.concat_batches(held)
            buckets = rows.column(0).to_numpy()
            whole = int(np.searchsorted(buckets, buckets[-1]))
            yield from _sums(rows.slice(0, whole))
            held = [rows.slice(whole)]
    if held:
        yield from _sums(pa.concat_batches(held))


def _sums(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    words = pc.split_pattern(rows.column(1), " ").flatten().dictionary_encode()
    left, right = words.indices.to_numpy().astype(np.int64).reshape(-1, 2).T
    pairs = left * len(words.dictionary) + right
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    counts = np.add.reduceat(rows.column(2).flatten().to_numpy()[order], first)
    left, right = np.divmod(pairs[first], len(words.dictionary))
    for at in range(0, len(first), ROWS):
        some = slice(at, at + ROWS)
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(left[some])), words.dictionary.take(pa.array(right[some])), pa.array(counts[some])], ["left", "right", "count"])


def is_ready(sizes: dict[str, int], enabled: tuple[str, ...], min_size: int = MIN_DICT_SIZE) -> bool:
    """Whether a language is enabled and every enabled one has enough words."""
    return bool(enabled) and all(sizes.get(lang, 0) >= min_size for lang in enabled)


def status(dictionaries: dict[str, DataFrame], pairs: DataFrame | None) -> dict[str, int | bool]:
    """Sizes, and whether neighbouring words are used."""
    sizes = {f"{name}_words": d.count() for name, d in dictionaries.items()}
    n = pairs.count() if pairs is not None else 0
    return sizes | {"pairs": n, "has_context": n > 0}
