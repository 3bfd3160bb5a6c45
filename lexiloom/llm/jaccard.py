"""Exact Jaccard join on word 5-grams: size-aware, heavy and light sets apart.

Sets with J >= 0.75 agree on more than the last three quarters of either in any common order of
the shingles. Shingles are ordered from rare to frequent: first those that occur once, then
those that occur again, then the most frequent ones by the logarithm of their counts.

* Light sets (at most `boundary` shingles) enumerate the 2-subsets of their first
  n - ceil(0.75 n) + 2 shingles: two light sets that link share one.
* Heavy sets post each of their first n - ceil(0.75 n) + 1 shingles to its inverted list, which is
  scanned; light sets near enough to the boundary to link with a heavy one post theirs too.
* The boundary is the one of least cost for the sizes and list lengths of the corpus.

A shingle that occurs once is in no other set, so nothing is posted for it. The order needs the
counts only approximately, and any order gives the same links, so they come as a bitmap of fixed
size (shingles seen again) and a table of the frequent ones, both broadcast. Frequent are those that have at least
one in HOT_KEYS of all postings, so there are HOT_KEYS of them at most and a list outside the table holds no larger
share. Where the corpus fills the bitmap, shingles that occur once aren't told any more and prefixes are posted whole:
more postings, the same links.

Lists aren't expanded into pairs. Lists with the same documents are kept once. A list is scanned
in order and all of it is compared with its first document only. Documents so linked get one
label. Where a list still holds several labels, what isn't under its most frequent label is
compared with documents that are, others for each list, for some rounds; the rest is
compared pair by pair, but first by what the bounds need: rows of a list that agree in it are one kind, kinds of the list that
may link are joined, and only then their documents, in blocks. Pairs are left out only where a bound proves that they can't link: two sets
share at most what comes after their first common key in the order, nothing that occurs once,
and in each part of the fingerprints no more than the lesser has there; and the Jaccard distance
keeps the triangle inequality. So no link between different texts is lost, and
a group of m near copies costs about m comparisons. Frequent keys are dealt over salts.

Defined results: null, empty and word-less texts have an empty set, n_shingles 0 and themselves
as component; equal texts share a component; rows with one doc_id are one node; a null doc_id
has a null component; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.checkpoints import cut, discard
from lexiloom.llm.components import components
from lexiloom.session import ship

SHINGLE = 5
NUM, DEN = 3, 4  # J >= 0.75
BITMAP_BITS = 27  # 16 MB, however large the corpus
HOT_KEYS = 1 << 19  # 4 MB of keys and as much of counts, however large the corpus
HOT_COUNT = 64
FLUSH = 1_000_000
BLOCK = 1024
ROUNDS = 1
SALT = 64
SKETCH = 64
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xB5026F5AA96619E9)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each document of a slice."""
    w = K.words(data, bounds, K.LOWER_WORDS)
    first, h = K.windows(w, k)
    at = np.searchsorted(first, w.first)
    out = []
    for i, n in enumerate(np.diff(w.first).tolist()):
        if n >= k:
            s = np.sort(h[at[i] : at[i + 1]])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            words = w.hash[w.first[i] : w.first[i + 1]]
            p = K.weights(k + 1)
            out.append(K.mix(np.array([(words * p[1 : n + 1]).sum()], np.uint64) * _WHOLE + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int) -> int:
    """Least overlap of a set of n with any set it links with."""
    return -(-NUM * n // DEN)


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, data, bounds in K.slices(batch.column(1)):
        yield a, b, shingle_sets(data, bounds)


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    K.begin()
    for batch in it:
        for a, b, sets in _sets_of(batch):
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "n", "digest"])


class _Seen:
    """Digests met in this task; emptied when full, so a set may be met again as new."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.known = limit, set()

    def new(self, s: np.ndarray) -> bool:
        d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        if d in self.known:
            return False
        if len(self.known) >= self.limit:
            self.known.clear()
        self.known.add(d)
        return True


def _counter(bits: int):
    """Rows (bucket, blob): sorted 32-bit remainders as differences, and counts, of the shingles of
    FLUSH postings or, with many buckets, of up to 8 times as many, so that blobs hold some keys; a bucket is
    the top `bits` bits of the fingerprint."""
    least = max(FLUSH, min(8 * FLUSH, 64 << bits))

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held) >> np.uint64(32 - bits)
        keys, counts = np.unique(keys, return_counts=True)
        cuts = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        press, buckets, blobs = zstandard.ZstdCompressor(level=1), [], []
        for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b:
                continue
            low = (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            diff = np.diff(low, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
            buckets.append(bucket)
            blobs.append(press.compress(np.ascontiguousarray(diff.T).tobytes() + np.ascontiguousarray(np.minimum(counts[a:b], 2**31 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin()
        held, n, seen = [], 0, _Seen()
        for batch in it:
            for _, _, sets in _sets_of(batch):
                for s in sets:
                    if len(s) and seen.new(s):
                        held.append(s)
                        n += len(s)
                if n >= least:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merge_counts(bits: int, bitmap_bits: int, hot_count: int):
    """All blobs of a bucket -> its slice of the bitmap, its most frequent keys, and sums."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for blob in rows["blob"]:
            flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 4, -1)
            back = lambda x: np.ascontiguousarray(x.T).view("<u4").ravel()
            keys.append(np.cumsum(back(flat[0]), dtype=np.uint32))
            counts.append(back(flat[1]))
        keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[start], np.add.reduceat(counts, start)
        again = counts > 1
        bits_here = bitmap_bits - bits
        slots = np.zeros(1 << bits_here, bool)
        slots[keys[again] >> np.uint32(32 - bits_here)] = True
        hot = np.flatnonzero(counts >= hot_count)
        whole = (np.uint64(key[0]) << np.uint64(32)) | keys[hot].astype(np.uint64)
        n = counts[again].astype(float)
        return pd.DataFrame({"bucket": [key[0]], "bitmap": [np.packbits(slots, bitorder="little").tobytes()], "hot": [whole.astype("<u8").tobytes()], "count": [counts[hot].astype("<i8").tobytes()], "total": [float(counts.sum())], "again": [float(n.sum())], "square": [float((n * n).sum())]})

    return run


class Order:
    """The common order of shingles: level 0 occurs once, 1 occurs again, above 1 by log2 of the count."""

    def __init__(self, bits: int, bitmap: np.ndarray, hot: np.ndarray, counts: np.ndarray, boundary: int):
        self.bits, self.bitmap, self.hot, self.boundary = bits, bitmap, hot, boundary
        self.level_of = (1 + np.floor(np.log2(np.maximum(counts, 2)))).astype(np.int64)
        self.shift = np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)

    def levels(self, s: np.ndarray) -> np.ndarray:
        at = s >> self.shift
        level = (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(np.int64)
        on = np.flatnonzero(level)
        if len(on) and len(self.hot):
            key = s[on] >> np.uint64(32 - self.bits)
            i = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            same = self.hot[i] == key
            level[on[same]] = self.level_of[i[same]]
        return level

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Keys of a set, whether each is frequent, how many shingles that occur again may come
        after it in the order, and how many occur again."""
        n, none = len(s), (s[:0], np.zeros(0, bool), np.zeros(0, np.int64), 0)
        if n == 0:
            return none
        level = self.levels(s)
        light = n <= self.boundary
        p = n - needed(n) + (2 if light else 1)
        first = int((level == 0).sum())
        if first >= p:
            return none
        order = np.argsort(level, kind="stable")[:p]
        head, level = s[order][first:], level[order][first:]  # what occurs once is in no other set
        keys, hot, after = [], [], []
        if not light or n >= needed(self.boundary + 1):  # may link with a heavy set
            k = n - needed(n) + 1 - first
            keys.append(head[: max(k, 0)])
            hot.append(level[: max(k, 0)] > 1)
            after.append(n - first - 1 - np.arange(len(keys[-1])))
        if light and len(head) > 1:
            i, j = np.triu_indices(len(head), 1)
            a, b = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
            keys.append(K.mix(a * _PAIR + K.mix(b)))
            hot.append((level[i] > 1) & (level[j] > 1))
            after.append(np.full(len(i), n - first - 1))
        return (np.concatenate(keys), np.concatenate(hot), np.concatenate(after), n - first) if keys else none


def choose_boundary(sizes: dict[int, int], again: float, list_length: float) -> int:
    """Light sets are those of at most this size: of all sizes that occur, and 0, the one of least cost. again: share
    of postings that occur again; list_length: mean length of the list that such a posting is in. What occurs again
    stands together, in copies, so of a pair of shingles about that share occurs again too, in lists shorter by as much."""
    p = lambda n, k: max(n - needed(n) + k, 0)
    lists = lambda n: again * p(n, 1) * (1 + list_length)  # noqa: E731  a posting, and what its list holds
    subsets = lambda n: again * math.comb(p(n, 2), 2) * (1 + again * list_length)
    ns = sorted(sizes)
    light = np.cumsum([0.0, *(sizes[n] * subsets(n) for n in ns)])
    heavy = np.cumsum([0.0, *(sizes[n] * lists(n) for n in ns)])
    cost = {x: light[k] + heavy[-1] - heavy[np.searchsorted(ns, needed(x + 1))] for k, x in enumerate([0, *ns])}
    return min(cost, key=lambda x: (cost[x], x))


def common_order(docs: DataFrame, sets: DataFrame, bitmap_bits: int = BITMAP_BITS, hot_keys: int = HOT_KEYS, hot_count: int = HOT_COUNT) -> Order:
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    bits = min(20, max(6, math.ceil(math.log2(max(total, 1) / 2_000_000 + 1))))
    blobs = docs.mapInArrow(_counter(bits), "bucket int, blob binary")
    merged = blobs.groupBy("bucket").applyInPandas(_merge_counts(bits, bitmap_bits, max(hot_count, math.ceil(total / hot_keys))), "bucket int, bitmap binary, hot binary, count binary, total double, again double, square double")
    bitmap, hot, counts, sums = np.zeros(1 << (bitmap_bits - 3), np.uint8), [], [], np.zeros(3)
    width = len(bitmap) >> bits
    for r in merged.collect():  # as many bytes as the bitmap and the table have
        bitmap[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.bitmap, np.uint8)
        hot.append(np.frombuffer(r.hot, "<u8"))
        counts.append(np.frombuffer(r["count"], "<i8"))
        sums += [r.total, r.again, r.square]
    keys = np.concatenate(hot) if hot else np.zeros(0, np.uint64)
    freq = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(keys)
    band = F.when(F.col("n") > 1024, F.floor(F.pow(F.lit(1.01), F.ceil(F.log("n") / math.log(1.01))))).otherwise(F.col("n")).cast("long")
    sizes = {r.n: r["count"] for r in sets.where("n > 0").groupBy(band.alias("n")).count().collect()}  # large sizes by hundredths: some thousand rows
    boundary = choose_boundary(sizes, sums[1] / max(sums[0], 1), sums[2] / max(sums[1], 1))
    return Order(bits, bitmap, keys[order].astype(np.uint64), freq[order], boundary)


POSTED = "doc bigint, n bigint, again bigint, keys array<bigint>, salts array<int>, after array<bigint>, z binary, sketch array<int>"


def _poster(shared):
    """Documents that post anything, one of equal sets of a task: what is posted (keys, salts, and how many of the shingles that
    occur again come after each), the compressed text, how many shingles occur again, and how many of these are in each of SKETCH
    equal parts of the fingerprints. Postings and texts come from one reading, so that both are of the same documents
    whatever the order in which a task meets equal sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin()
        order, seen, press = shared.value, _Seen(), zstandard.ZstdCompressor(level=1)
        for batch in it:
            ids, text = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, _, sets in _sets_of(batch):
                rows, keys, salts, afters, texts, parts = [], [], [], [], [], []
                for i, s in enumerate(sets):
                    k, hot, after, again = order.keys(s)
                    if not len(k) or not seen.new(s):
                        continue
                    doc = int(ids[a + i])
                    rows.append((doc, len(s), again))
                    keys.append(k)
                    salts.append(np.where(hot, 1 + hash(doc) % SALT, 0))
                    afters.append(after)
                    texts.append(press.compress(text[a + i].as_buffer()))
                    parts.append(np.bincount((s[order.levels(s) > 0] >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH))
                if rows:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
                    listed = lambda x, t: pa.ListArray.from_arrays(ends, pa.array(x, t))  # noqa: B023, E731
                    lists = [listed(np.concatenate(keys).view(np.int64), pa.int64()), listed(np.concatenate(salts), pa.int32()), listed(np.concatenate(afters), pa.int64())]
                    columns = [*(pa.array(np.ascontiguousarray(c)) for c in np.array(rows, np.int64).T), *lists, pa.array(texts, pa.binary()), pa.array(parts, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in POSTED.split(", ")])

    return run


LIST = "key bigint, salt int, doc bigint, n bigint, again bigint, after bigint, pivot bigint, pivot_n bigint, pivot_again bigint"


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings -> those of lists with several documents, each with its list's first one.
    A list inside one batch gets a fingerprint of its documents as key, so that equal lists can
    be told. A salted list keeps its key, and goes on even if it has one document."""
    names = ["key", "salt", "doc", "n", "again", "after"]
    held: list[np.ndarray] | None = None  # the list that may go on in the next batch
    goes_on: tuple | None = None  # a long list, part of which is out: key, salt and its first row

    def out(rows: list[np.ndarray], pivot: tuple | None = None) -> pa.RecordBatch | None:
        key, salt = rows[0], rows[1]
        if not len(key):
            return None
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.append(begin, len(key)))
        keep = (salt > 0) | (size[group] > 1) | (pivot is not None)
        if pivot is None:
            docs = K.mix(rows[2].astype(np.uint64))
            same = K.mix(np.add.reduceat(docs, begin) + size.astype(np.uint64) * _WHOLE).view(np.int64)[group]
            first = [c[begin][group] for c in rows[2:5]]
        else:
            same, first = key, [np.full(len(key), x) for x in pivot]
        key = np.where(salt > 0, key, same)
        columns = [key[keep], salt[keep].astype(np.int32), *(c[keep] for c in rows[2:]), *(c[keep] for c in first)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "pivot", "pivot_n", "pivot_again"]) if keep.any() else None

    for batch in it:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if goes_on is not None:
            same = int(((rows[0] == goes_on[0]) & (rows[1] == goes_on[1])).sum())  # sorted: they come first
            if same:
                yield out([c[:same] for c in rows], goes_on[2])
            if same == batch.num_rows:
                continue
            rows, goes_on = [c[same:] for c in rows], None
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            held = None
        last = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])
        if (made := out([c[:last] for c in rows])) is not None:
            yield made
        held = [c[last:] for c in rows]
        if len(held[0]) > 20_000:
            first = tuple(c[0] for c in held[2:5])
            goes_on = (held[0][0], held[1][0], first)
            yield out(held, first)
            held = None
    if held is not None and (made := out(held)) is not None:
        yield made


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, za, zb) -> (a, b, shared, either)."""
    K.begin()
    for batch in it:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            blobs = {}
            for c in (2, 3):
                for z in part.column(c).to_pylist():
                    blobs.setdefault(z, len(blobs))
            texts = [zstandard.ZstdDecompressor().decompress(z) for z in blobs]
            sets: list[np.ndarray] = []
            for _, _, data, bounds in K.slices(pa.array(texts, pa.large_binary()).view(pa.large_string())):
                sets += shingle_sets(data, bounds)
            both, either = [], []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                p, q = sets[blobs[x]], sets[blobs[y]]
                joint = np.sort(np.concatenate([p, q]), kind="stable")
                o = int((joint[1:] == joint[:-1]).sum())
                both.append(o)
                either.append(len(p) + len(q) - o)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "shared", "either"])


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) -> (a, b, shared, either, linked, far): far is the Jaccard distance. A text goes
    once to its b and then with the pair to a, so a frequent a meets its pairs without being gathered."""
    one = pairs.join(texts.select(F.col("doc").alias("b"), F.col("z").alias("zb")), "b")
    both = one.join(texts.select(F.col("doc").alias("a"), F.col("z").alias("za")), "a").select("a", "b", "za", "zb")
    got = both.mapInArrow(_compare, "a bigint, b bigint, shared bigint, either bigint")
    return got.select("*", (F.col("shared") * DEN >= F.col("either") * NUM).alias("linked"), (1 - F.col("shared") / F.col("either")).alias("far"))


def may_link(x: str, y: str):
    """Sets x and y (columns <x>_n and <x>_again) share at most what either has of others."""
    most = F.least(F.col(f"{x}again"), F.col(f"{y}again"))
    return most * DEN >= (F.col(f"{x}n") + F.col(f"{y}n") - most) * NUM


def may_link_here(x: str, y: str):
    """The same at the first key, in the order, that both have: they share it and what comes
    after. At their later keys this may fail for sets that link; their first key is enough."""
    most = F.least(F.col(f"{x}after"), F.col(f"{y}after")) + 1
    return most * DEN >= (F.col(f"{x}n") + F.col(f"{y}n") - most) * NUM


def labels_of(links: DataFrame) -> DataFrame:
    """(doc, label): components so far. Equal labels mean that two documents needn't be compared."""
    found = components(links)
    out = found.select(F.col("node").alias("doc"), F.col("component").alias("label"))
    out._written_at = found._written_at
    return out


def join_components(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    spark = ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut(plain.mapInArrow(_digests, "doc_id bigint, n bigint, digest binary"), "sets")
    known = plain.where("doc_id IS NOT NULL")
    order = common_order(known, sets, **limits)
    shared = spark.sparkContext.broadcast(order)
    del order
    posted = cut(known.mapInArrow(_poster(shared), POSTED), "posted")
    shared.destroy()
    each = posted.select(F.explode(F.arrays_zip("keys", "salts", "after")).alias("p"), "doc", "n", "again")
    postings = each.select(F.col("p.keys").alias("key"), F.col("p.salts").alias("salt"), "doc", "n", "again", F.col("p.after").alias("after")).repartition("key", "salt").sortWithinPartitions("key", "salt", "doc")
    same_list = [c.split()[0] for c in LIST.split(", ") if c != "after bigint"]  # of keys with the same documents the first in the order is left
    lists = cut(postings.mapInArrow(_scan, LIST).groupBy(*same_list).agg(F.max("after").alias("after")), "lists")
    texts = posted.select("doc", "z", "sketch")

    top = lists.where("salt > 0").groupBy("key").agg(F.min(F.struct("pivot", "pivot_n", "pivot_again")).alias("top"))
    across = lists.where("salt > 0 AND doc = pivot").join(top, "key").select(F.col("top.pivot").alias("pivot"), F.col("top.pivot_n").alias("pivot_n"), F.col("top.pivot_again").alias("pivot_again"), "doc", "n", "again")
    stars = lists.select(*across.columns).unionByName(across).where("pivot <> doc")
    compared = compared_pairs(stars.where(may_link("", "pivot_")), "pivot", "doc", texts)
    links = compared.where("linked").select(F.col("b").alias("u"), F.col("a").alias("v"))
    labels = labels_of(links)

    members = lists.select("key", "salt", "doc", "n", "again", "after", "pivot")
    salted = cut(lists.where("salt > 0").select("key", "salt").distinct(), "salted")
    written = [compared, labels]
    for turn in range(ROUNDS + 1):
        marked = members.join(labels, "doc", "left").select(*members.columns, F.coalesce("label", "doc").alias("label"))
        some = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.min_by(F.struct("doc", "n", "again"), F.xxhash64("doc", "key", F.lit(turn))).alias("p"))
        most = some.groupBy("key").agg(F.max_by(F.struct("label", "p"), F.struct("m", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        # a frequent key's rows stay dealt over its salts
        most = most.select("key", F.lit(0).alias("salt"), "most").unionByName(most.join(salted, "key").select("key", "salt", "most"))
        open_ = marked.join(most.select("key", "salt", F.col("most.label").alias("most"), F.col("most.p.doc").alias("p_doc"), F.col("most.p.n").alias("p_n"), F.col("most.p.again").alias("p_again")), ["key", "salt"])
        if turn < ROUNDS:
            pairs = open_.where("label <> most").where(may_link("", "p_")).select("p_doc", "doc")
            fresh = compared_pairs(pairs, "p_doc", "doc", texts, compared)
        else:
            left = cut(open_.drop("p_doc", "p_n", "p_again", "salt"), "open")
            pairs, kinds = rest(left, compared, texts)
            fresh = compared_pairs(pairs, "a", "b", texts, compared)
            written += [left, kinds]
        written.append(fresh)
        compared = compared.unionByName(fresh)
        links = compared.where("linked").select(F.col("b").alias("u"), F.col("a").alias("v"))
        if turn < ROUNDS:
            labels = labels_of(links)
            written.append(labels)
    equal = sets.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # equal sets: rows of a part of a class link to the part's least, and that to the class's; a large class is many parts
    equal = equal.select("digest", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("part"))
    parts = equal.groupBy("digest", "part").agg(F.min("doc_id").alias("v"))
    whole = parts.groupBy("digest").agg(F.min("v").alias("w"))
    same = equal.join(parts, ["digest", "part"]).select(F.col("doc_id").alias("u"), "v")
    same = same.unionByName(parts.join(whole, "digest").select(F.col("v").alias("u"), F.col("w").alias("v"))).where("u <> v")
    found = components(links.unionByName(same))  # written: nothing below reads what comes before
    discard(lists, posted, salted, *written)
    return sets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def compared_pairs(pairs: DataFrame, x: str, y: str, texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """compare() of the distinct pairs of the columns x and y that aren't in known, written."""
    some = pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()
    if known is not None:
        some = some.join(known.select("a", "b"), ["a", "b"], "left_anti")
    return cut(compare(some, texts), "compared")


def rest(open_: DataFrame, compared: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, the written table of kinds): pairs of one list under different labels that may link. What is under
    the list's most frequent label is not joined with itself. Rows of a list of one size and place (n, after) are one
    kind; kinds in their order make blocks of about BLOCK rows, a larger kind several. A kind goes to the blocks whose least size
    and last place it may link with, and only there documents meet: a list of usual length is one block."""
    kinds = open_.groupBy("key", "n", "after").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("label") != F.col("most")).alias("few"))
    in_order = Window.partitionBy("key").orderBy("n", "after").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m").over(in_order), F.lit(0))
    kinds = cut(kinds.withColumn("block", (before / BLOCK).cast("int")).withColumn("parts", (1 + F.col("m") / BLOCK).cast("int")), "kinds")
    blocks = kinds.groupBy("key", "block").agg(F.min("n").alias("b_n"), F.max("after").alias("b_after"), F.max("parts").alias("parts"))
    meets = kinds.where("few > 0").select("key", "n", "after").join(blocks, "key").where(may_link_here("", "b_")).select("key", "n", "after", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    far = compared.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), "far").unionByName(compared.select(F.col("b").alias("pivot"), F.col("a").alias("doc"), "far"))

    def known(rows: DataFrame) -> DataFrame:
        """rows with their distance from the list's pivot, where it is known, and their sketches."""
        rows = rows.join(far, ["pivot", "doc"], "left").withColumn("far", F.when(F.col("doc") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("far")))
        return rows.join(texts.select("doc", "sketch"), "doc")

    dealt = known(open_.join(kinds.select("key", "n", "after", "block", "parts"), ["key", "n", "after"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).drop("parts", "again"))
    few = known(open_.where("label <> most").drop("again", "most").join(meets, ["key", "n", "after"]))
    few = few.select("key", "block", "part", *(F.col(c).alias(f"x_{c}") for c in ("doc", "n", "after", "label", "pivot", "far", "sketch")))
    limit = 1 - NUM / DEN + 1e-9
    apart = F.coalesce((F.col("pivot") == F.col("x_pivot")) & (F.abs(F.col("far") - F.col("x_far")) > limit), F.lit(False))
    most = F.aggregate(F.zip_with("sketch", "x_sketch", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    close = most * DEN >= (F.col("n") + F.col("x_n") - most) * NUM
    out = few.join(dealt, ["key", "block", "part"]).where((F.col("label") != F.col("x_label")) & ((F.col("label") == F.col("most")) | (F.col("doc") < F.col("x_doc")))).where(may_link_here("", "x_"))
    return out.where(~apart).where(close).select(F.col("doc").alias("a"), F.col("x_doc").alias("b")), kinds
