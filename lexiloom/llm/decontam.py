"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `n` consecutive item words (a shorter item is one pattern). Those
of one length share a shift table over blocks of two words: a block that ends no pattern lets
the search skip positions where no pattern can end. Where the shift is zero, the bucket of
patterns that end in that block is compared word by word from the end, and what remains is
confirmed byte by byte.

The benchmark is read to the driver in blocks of at most BLOCK_WORDS words, each broadcast on
its own; a benchmark of several blocks is searched block after block over the same rows, whose hits are written between.

Defined results: null, empty or word-less texts have no words, no hits and are clean; null or
word-less items are never found; an item id that is null is left out; repeated documents give
repeated rows; repeated items count once by id; an empty benchmark finds nothing. Of the inputs
only doc_id, text and item_id, text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.checkpoints import cut, discard
from lexiloom.session import ship

WINDOW = 13
BLOCK_WORDS = 2_000_000
TABLE_BITS = 20
LANE = 256
_P1, _P2 = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xF1357AEA2E62A9C5)


def block_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the block that ends at each word; the first is of no use at width 2."""
    if width == 1:
        return K.mix(h * _P1)
    out = np.zeros(len(h), np.uint64)
    out[1:] = h[:-1] * _P1 + h[1:] * _P2
    return K.mix(out)


@dataclass
class Patterns:
    """Patterns of m words: words[i] are the fingerprints of pattern i, whose bytes (lower-cased
    words, one after the other) are data[at[i]:at[i+1]]; owners[own[i]:own[i+1]] are its items."""

    m: int
    shift: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    data: np.ndarray
    at: np.ndarray
    own: np.ndarray
    owners: np.ndarray
    suffix: np.ndarray  # distinct block fingerprints at the patterns' ends, sorted
    bucket: np.ndarray  # bucket[i]:bucket[i+1] are the patterns with suffix[i]

    @property
    def width(self) -> int:
        return min(2, self.m)


def compile_patterns(items: list[tuple[int, str]], n: int = WINDOW) -> list[Patterns]:
    """One table for each pattern length; owners are positions in `items`."""
    found: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for i, (_, text) in enumerate(items):
        data = np.frombuffer((text or "").encode(), np.uint8)
        w = K.words(data, np.array([0, len(data)]), K.ALNUM_WORDS)
        low = K.ALNUM_WORDS[data].tobytes()
        ws = [low[a:b] for a, b in zip(w.start, w.end, strict=True)]
        m = min(n, len(ws))
        for j in range(len(ws) - m + 1 if m else 0):
            found.setdefault(m, {}).setdefault(tuple(ws[j : j + m]), set()).add(i)
    out = []
    for m, owned in sorted(found.items()):
        strings = list(owned)
        flat = [x for s in strings for x in s]
        joined = np.frombuffer(b" ".join(flat), np.uint8)
        h = K.words(joined, np.array([0, len(joined)]), K.ALNUM_WORDS).hash.reshape(-1, m)
        width = min(2, m)
        blocks = np.stack([block_hash(row, width) for row in h])
        order = np.argsort(blocks[:, -1], kind="stable")
        strings, h, blocks = [strings[i] for i in order], h[order], blocks[order]
        shift = np.full(1 << TABLE_BITS, m - width + 1, np.uint8)
        for j in range(width - 1, m):
            np.minimum.at(shift, blocks[:, j] & np.uint64((1 << TABLE_BITS) - 1), np.uint8(m - 1 - j))
        lengths = np.array([[len(x) for x in s] for s in strings])
        suffix, begin = np.unique(blocks[:, -1], return_index=True)
        owners = [sorted(owned[s]) for s in strings]
        out.append(
            Patterns(
                m, shift, h, lengths, np.frombuffer(b"".join(x for s in strings for x in s), np.uint8), np.concatenate([[0], np.cumsum(lengths.sum(1))]),
                np.concatenate([[0], np.cumsum([len(x) for x in owners])]), np.array([x for o in owners for x in o]), suffix, np.append(begin, len(strings)),
            )
        )
    return out


def search(p: Patterns, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last word and the pattern of every occurrence."""
    none = np.zeros(0, np.int64)
    low, high = w.first[:-1] + p.m - 1, w.first[1:]
    low, high = low[low < high], high[low < high]
    if not len(low):
        return none, none
    lanes = (high - low + LANE - 1) // LANE
    pos = K.ragged(np.zeros(len(low), np.int64), lanes) * LANE + np.repeat(low, lanes)
    stop = np.minimum(pos + LANE, np.repeat(high, lanes))
    blocks = block_hash(w.hash, p.width)
    slots = (blocks & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    ends = []
    while len(pos):
        skip = p.shift[slots[pos]]
        zero = skip == 0
        if zero.any():
            ends.append(pos[zero])
        pos = pos + np.maximum(skip, 1)
        on = pos < stop
        pos, stop = pos[on], stop[on]
    if not ends:
        return none, none
    end = np.concatenate(ends)
    b = np.minimum(np.searchsorted(p.suffix, blocks[end]), len(p.suffix) - 1)
    hit = p.suffix[b] == blocks[end]
    end, b = end[hit], b[hit]
    sizes = p.bucket[b + 1] - p.bucket[b]
    pattern, end = K.ragged(p.bucket[b], sizes), np.repeat(end, sizes)
    lengths = w.end - w.start
    for j in range(1, p.m + 1):  # from the last word backwards
        if not len(end):
            return none, none
        at = end - j + 1
        same = (w.hash[at] == p.words[pattern, p.m - j]) & (lengths[at] == p.lengths[pattern, p.m - j])
        end, pattern = end[same], pattern[same]
    word = K.ragged(end - p.m + 1, np.full(len(end), p.m))  # every byte of what is left
    text = K.ALNUM_WORDS[w.data[K.ragged(w.start[word], lengths[word])]]
    size = p.at[pattern + 1] - p.at[pattern]
    wrong = np.zeros(len(text) + 1, np.int64)
    np.cumsum(text != p.data[K.ragged(p.at[pattern], size)], out=wrong[1:])
    to = np.cumsum(size)
    right = wrong[to] == wrong[to - size]
    return end[right], pattern[right]


def _searcher(tables, n_items: int, last: bool, ids):
    """Adds a block's hits to the columns hits (word ranges) and items; after the last block,
    returns the figures."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin()
        patterns, names = tables.value
        for batch in it:
            col = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            for a, b, data, bounds in K.slices(col["text"]):
                w = K.words(data, bounds, K.ALNUM_WORDS)
                n_docs = b - a
                cover = np.zeros(len(w.hash) + 1, np.int32)
                pairs = []
                for p in patterns:
                    end, which = search(p, w)
                    np.add.at(cover, end - p.m + 1, 1)
                    np.add.at(cover, end + 1, -1)
                    count = p.own[which + 1] - p.own[which]
                    doc = np.searchsorted(w.first, end, side="right") - 1
                    pairs.append(np.repeat(doc, count) * n_items + p.owners[K.ragged(p.own[which], count)])
                hit = np.cumsum(cover)[:-1] > 0
                earlier = {}
                if "hits" in col:
                    for i, (h, x) in enumerate(zip(col["hits"].slice(a, n_docs).to_pylist(), col["items"].slice(a, n_docs).to_pylist(), strict=True)):
                        if h:
                            hit[K.ragged(np.array(h[::2]), np.array(h[1::2])) + w.first[i]] = True
                        if x:
                            earlier[i] = set(x)
                for x in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
                    earlier.setdefault(x // n_items, set()).add(names[x % n_items])
                keys = [x for x in batch.schema.names if x not in ("text", "hits", "items")]
                out = [col[x].slice(a, n_docs) for x in keys]
                if not last:
                    runs = []
                    for i in range(n_docs):
                        edge = np.diff(np.concatenate([[0], hit[w.first[i] : w.first[i + 1]].astype(np.int8), [0]]))
                        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                        runs.append(np.stack([s, e - s], 1).ravel().tolist())
                    yield pa.RecordBatch.from_arrays([*out, col["text"].slice(a, n_docs), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(earlier.get(i, ())) for i in range(n_docs)], pa.list_(pa.string()))], [*keys, "text", "hits", "items"])
                    continue
                found = [sorted(earlier.get(i, ())) for i in range(n_docs)]
                n_words, n_hit = np.diff(w.first), K.per_doc(hit, w.first)
                yield pa.RecordBatch.from_arrays(
                    [*out, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                     pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else empty for x in found]), pa.array(found, pa.list_(pa.string())), pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
                    [*keys, "n_words", "n_hit", "n_items", "items_sha256", "item_ids", "contaminated"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), n: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: keep, n_words, n_hit, n_items, items_sha256, item_ids, contaminated."""
    spark = ship(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    clash = set(keep) & {"text", "hits", "items", "n_words", "n_hit", "n_items", "items_sha256", "item_ids", "contaminated"}
    if clash:
        raise ValueError(f"columns named like the result's own: {sorted(clash)}")
    out = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    before: DataFrame | None = None
    for block, last in _blocks(items, block_words):
        tables = spark.sparkContext.broadcast((compile_patterns(block, n), [x for x, _ in block]))
        schema = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, item_ids array<string>, contaminated boolean" if last else "text string, hits array<bigint>, items array<string>"
        out = out.mapInArrow(_searcher(tables, max(1, len(block)), last, keep), f"{kept}, {schema}")
        if not last:  # one block at a time: its hits are written and its tables go before the next one comes
            out = cut(out, "block")
            tables.destroy()
            if before is not None:
                discard(before)
            before = out
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[tuple[list[tuple[str, str | None]], bool]]:
    """(items, whether they are the last) of about block_words words; one block without items for an empty table."""
    held, block, words = None, [], 0
    for row in items.toLocalIterator():
        if words >= block_words:
            if held is not None:
                yield held, False
            held, block, words = block, [], 0
        block.append((row.item_id, row.text))
        words += len(row.text or "") // 2 + 1  # no text has more words
    if held is not None:
        yield held, False
    yield block, True


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with docs' columns, whatever their names."""
    columns = docs.columns
    places = [f"_{i}" for i in range(len(columns))]
    held = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(columns, places, strict=True)), F.col("text"))
    found = contamination(held, benchmark, tuple(places)).where(~F.col("contaminated"))
    return found.select(*(F.col(p).alias(c) for c, p in zip(columns, places, strict=True)))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("item_ids")
