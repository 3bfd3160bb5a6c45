"""Document fingerprints from prefix polynomial hashes.

prefixes() holds, for each of two primes, the polynomial hash of every prefix of a text's bytes. The hash of any span
is a difference of two of them, so spans are compared without being read, and extension() finds how far two texts
agree from given places on by binary search.

A fingerprint is a thinned prefix array: the text's length, the hash of all of it, and prefix hashes up to two kinds of places.
CUTS places are those of least hash of the WINDOW bytes before them, each window once; they move with what surrounds them, and the
hash is their tag, which says where the same place is in another text. Up to GRID more are the multiples of a power of two, which find
what two texts share from their beginning on, repeated passages too. What two fingerprints tell about spans between common places is again a
difference of prefixes: likeness() takes common places by their shift, extends each match as far as it goes by binary search,
and returns 2 x matched bytes / bytes of both. Short texts keep every place.

`query` pairs each document with the next one in descending order of doc_id. Parts of that order are ranges between quantiles of
doc_id (an id repeated so often that it spans several quantiles is split by the hash of its text); a part's last document
needs the next part's first, so those rows, one for each part, are looked up and sent along. A task streams its part and holds two texts.

Defined results: a null text is empty; two empty texts are alike (1), an empty one and another aren't (0). Rows with a null doc_id come last.
Rows of one doc_id stand in descending order of the hash of their texts. A table of one row is its own next. An empty table gives an empty
result. Equality of spans and texts is up to their hashes (62 bits for extension() and whole texts, 31 inside likeness()). Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.session import ship

CUTS = 32
GRID = 16
WINDOW = 8
#: Bytes hashed at once.
BLOCK = 1 << 18
CUT = np.dtype([("tag", "<u4"), ("at", "<u4"), ("sum", "<u4")])
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next bigint"
(PRIME, BASE), (PRIME2, BASE2) = K._FIELDS


def prefixes(data: np.ndarray) -> np.ndarray:
    """2 x (n + 1): the hash of every prefix for both primes."""
    out = np.zeros((2, len(data) + 1), np.uint32)
    for a in range(0, len(data), BLOCK):
        for row, sums, (prime, base) in zip(out, K.prefix_sums(data[a : a + BLOCK]), K._FIELDS, strict=True):
            q = np.uint64(prime)
            part = sums % q
            row[a : a + len(part)] = (part * np.uint64(pow(base, a, prime)) + np.uint64(row[a])) % q if a else part
    return out


def same_span(p: np.ndarray, i: int, r: np.ndarray, j: int, size: int) -> bool:
    """Whether `size` bytes from i in one text and from j in the other are equal."""
    return all((int(x[i + size]) - int(x[i])) * pow(base, j, prime) % prime == (int(y[j + size]) - int(y[j])) * pow(base, i, prime) % prime for x, y, (prime, base) in zip(p, r, K._FIELDS, strict=True))


def extension(p: np.ndarray, r: np.ndarray, i: int = 0, j: int = 0) -> int:
    """Length of the longest span that begins at i in one text and at j in the other and is equal in both."""
    low, high = 0, min(p.shape[1] - 1 - i, r.shape[1] - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same_span(p, i, r, j, mid) else (low, mid - 1)
    return low


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (at most CUTS) inner places of least window hash, ascending, and those hashes; the first place of a window counts."""
    best_at, best = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for a in range(1, len(data), BLOCK):
        left = max(a - WINDOW, 0)
        sums, (_, inverse) = K.prefix_sums(data[left : a + BLOCK - 1])[0], K.powers(min(BLOCK + WINDOW, len(data)) + 1)[0]
        end = np.arange(a, min(a + BLOCK, len(data))) - left
        start = np.maximum(end - WINDOW, 0)
        q = np.uint64(PRIME)
        h = K.mix(((sums[end] - sums[start]) % q * inverse[start] % q) << np.uint64(16) | (end - start).astype(np.uint64))
        at, want = np.arange(len(h)), 2 * CUTS
        while want < len(h):  # few of the least are repeated, as a rule
            least = np.flatnonzero(h <= np.partition(h, want)[want])
            if len(np.unique(h[least])) >= CUTS:
                at = least
                break
            want *= 4
        both, where = np.concatenate([best, h[at]]), np.concatenate([best_at, at + a])
        best, first = np.unique(both, return_index=True)
        best, best_at = best[:CUTS], where[first[:CUTS]]
    order = np.argsort(best_at)
    return best_at[order], best[order]


@dataclass(frozen=True)
class Print:
    """A text's length in bytes, the hash of all of it and its thinned prefix array."""

    size: int
    whole: int
    cuts: np.ndarray
    grid: np.ndarray

    @cached_property
    def by_place(self) -> dict[int, int]:
        step = stride(self.size)
        return {step * (i + 1): s for i, s in enumerate(self.grid.tolist())}

    @cached_property
    def by_tag(self) -> dict[int, tuple[int, int]]:
        return {t: (a, s) for t, a, s in self.cuts.tolist()}

    def __str__(self) -> str:
        return f"{self.size:x}.{self.whole:016x}.{base64.b64encode(self.cuts.tobytes() + self.grid.tobytes()).decode()}"


def stride(size: int) -> int:
    """The least power of two that divides a text into GRID steps at most."""
    return 1 << max(-(-size // GRID) - 1, 0).bit_length()


def make(data: np.ndarray, p: np.ndarray | None = None) -> Print:
    p = prefixes(data) if p is None else p
    at, h = places(data)
    cuts = np.zeros(len(at), CUT)
    cuts["tag"], cuts["at"], cuts["sum"] = h & np.uint64(0xFFFFFFFF), at, p[0][at]
    step = stride(len(data))
    return Print(len(data), int(p[0][-1]) << 31 | int(p[1][-1]), cuts, p[0][step : len(data) : step].astype("<u4"))


def parse(text: str) -> Print:
    size, whole, arrays = text.split(".")
    n, data = int(size, 16), base64.b64decode(arrays)
    grid = 4 * len(range(stride(n), n, stride(n)))
    return Print(n, int(whole, 16), np.frombuffer(data[: len(data) - grid], CUT), np.frombuffer(data[len(data) - grid :], "<u4"))


def _covered(spans: list[tuple[int, int]]) -> int:
    """Bytes inside any of the spans."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total, end = total + max(b - max(a, end), 0), max(b, end)
    return total


def likeness(a: Print, b: Print) -> float:
    """Share of both texts' bytes that lie in spans which the fingerprints show to be equal."""
    if a.size == b.size and a.whole == b.whole:
        return 1.0
    pairs = [(a.by_tag[t], b.by_tag[t]) for t in a.by_tag.keys() & b.by_tag.keys()]
    pairs += [((at, a.by_place[at]), (at, b.by_place[at])) for at in a.by_place.keys() & b.by_place.keys()]
    pairs += [((0, 0), (0, 0)), ((a.size, a.whole >> 31), (b.size, b.whole >> 31))]
    by_shift: dict[int, list[tuple[int, int, int]]] = {}
    for (at, s), (at2, s2) in pairs:
        by_shift.setdefault(at2 - at, []).append((at, s, s2))
    here, there = [], []
    for shift, row in by_shift.items():
        row.sort()
        move, i = pow(BASE, shift, PRIME), 0
        while i < len(row) - 1:
            low, high = i, len(row) - 1
            while low < high:  # equal up to a place means equal up to every one before it
                mid = (low + high + 1) // 2
                same = (row[mid][1] - row[i][1]) * move % PRIME == (row[mid][2] - row[i][2]) % PRIME
                low, high = (mid, high) if same else (low, mid - 1)
            if low > i:
                here.append((row[i][0], row[low][0]))
                there.append((row[i][0] + shift, row[low][0] + shift))
            i = max(low, i + 1)
    return 2.0 * min(_covered(here), _covered(there)) / (a.size + b.size)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; of null as of an empty text."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: str(make(as_bytes(t))))

    return made(F.coalesce(text, F.lit("")))


def alike(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null where one is."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness(parse(x), parse(y)) for x, y in zip(a, b, strict=True)], dtype="Float64")

    return share(a, b)


def in_parts(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, print and part: the number of the row's range in descending order of (doc_id, print)."""
    steps = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), steps, max(10_000, 20 * parts))).first()[0] if steps else None
    bounds = np.array(sorted(found or []), np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series, prints: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        v = ids.fillna(0).to_numpy().astype(np.int64)
        above, among = np.searchsorted(bounds, v, side="right"), np.searchsorted(bounds, v, side="left")
        back = (np.int64(2**63 - 1) - prints.to_numpy().astype(np.int64)).view(np.uint64) >> np.uint64(32)  # least for the greatest print
        inside = (back * (above - among + 1).astype(np.uint64)) >> np.uint64(32)
        return pd.Series(np.where(known, len(bounds) - above + inside.astype(np.int64), len(bounds)).astype(np.int32))

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print")).withColumn("part", part("doc_id", "print"))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of in_parts() in their order, one part a task, and behind each part's rows the first row of the part after it
    (`ahead`); behind the last part, that of the first."""
    rows = in_parts(docs, parts)
    firsts = rows.groupBy("part").agg(F.max(F.struct("doc_id", "print")).alias("first")).orderBy("part").collect()  # a row a part
    if not firsts:
        return rows.withColumn("ahead", F.lit(True))
    follow = [(r.part, n.first.doc_id, n.first.print) for r, n in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    wanted = docs.sparkSession.createDataFrame(follow, "to int, doc_id bigint, print bigint")
    heads = rows.alias("r").join(F.broadcast(wanted).alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.print") == F.col("w.print"))).select("r.doc_id", "r.text", "r.print", F.col("to").alias("part")).dropDuplicates(["part"])
    both = rows.withColumn("ahead", F.lit(False)).unionByName(heads.withColumn("ahead", F.lit(True)))
    return both.repartitionById(parts + 1, "part").sortWithinPartitions("part", "ahead", F.desc("doc_id"), F.desc("print"))


class _Text:
    """A text with its prefix arrays and fingerprint."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.data = as_bytes(text)
        self.prefixes = prefixes(self.data)
        self.print = make(self.data, self.prefixes)


def _row(own: _Text, after: _Text) -> tuple:
    n = len(own.text)
    k = n // 3
    edited = own.text[: n - k] + after.text[:k]
    changed = _Text(None, edited)
    shared = extension(own.prefixes, after.prefixes)
    chars = np.flatnonzero((own.data & 0xC0) != 0x80)  # where code points begin; one that is cut doesn't count
    common = int(np.searchsorted(np.append(chars, len(own.data)), shared, side="right")) - 1
    return own.doc_id, n, hashlib.sha256(changed.data).hexdigest(), str(own.print), str(changed.print), likeness(own.print, changed.print), likeness(own.print, after.print), common


def query(docs: DataFrame) -> DataFrame:
    spark = ship(docs.sparkSession)
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin()
        own = None
        for batch in it:
            made = []
            for doc_id, text, ahead in zip(*(batch.column(i) for i in range(3)), strict=True):
                one = _Text(doc_id.as_py(), text.as_py())
                if own is not None:
                    made.append(_row(own, one))
                own = None if ahead.as_py() else one
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, parts).select("doc_id", "text", "ahead").mapInArrow(run, RESULT)
