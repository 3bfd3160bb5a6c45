"""Word and window hashing over the raw buffers of an Arrow string column.

Everything here works on a slice of rows at once with numpy: no Python string is made for a
document. A word's fingerprint joins two polynomials of its bytes, modulo two primes below 2**31
and taken from prefix sums: modulo a power of two, texts of very regular make-up would collide. A
window's fingerprint combines those of its words. Where a verdict hangs on equal fingerprints of one
document, exact() and same_spans() confirm them by bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document is handled alone.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FIELDS = ((2**31 - 1, 1_237_940_039), (2**31 - 19, 892_710_437))  # prime, base
_powers: list[tuple[np.ndarray, np.ndarray]] = []
#: Tables that operators keep in a worker from task to task.
KEPT: list[dict] = []


def begin(own: dict | None = None) -> None:
    """At the start of a task: a worker serves one operator after the other, so the tables that
    others have left in it go, and freed memory goes back to the system."""
    stale = [d for d in KEPT if d and d is not own]
    for d in stale:
        d.clear()
    if stale:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _table(separators: set[int], lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[0x41:0x5B] += 0x20
    t[list(separators)] = 0
    return t


_BLANKS = {0x20, *range(0x09, 0x0E)}
#: `[^\x20\x09-\x0D]+`. A NUL byte stays inside its word: as 0x01 where equal words are confirmed by bytes, as a symbol of its own where not.
PLAIN_WORDS = _table(_BLANKS, False)
PLAIN_WORDS[0] = 1
LOWER_WORDS = _table(_BLANKS, True).astype(np.uint16)
LOWER_WORDS[0] = 256
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM_WORDS = _table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, True)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def weights(n: int) -> np.ndarray:
    """_BASE**i modulo 2**64, for the few words of a window."""
    return np.array([pow(int(_BASE), i, 1 << 64) for i in range(n)], np.uint64)


def _series(base: int, prime: int, n: int) -> np.ndarray:
    """base**i modulo prime for i < n, by doubling."""
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field base**i and base**-i for i < n, kept for the usual chunk length."""
    if _powers and len(_powers[0][0]) >= n:
        return _powers
    size = max(n, 1 << 16)
    out = [(_series(base, prime, size), _series(pow(base, -1, prime), prime, size)) for prime, base in _FIELDS]
    if size <= 2 * CHUNK_BYTES:
        _powers[:] = out
    return out


@dataclass
class Words:
    """Words of a slice of documents, in order."""

    data: np.ndarray  # the text's bytes
    bounds: np.ndarray  # byte offset of each document, and the end
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of rows of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null has no bytes
        length = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if length.sum() != offsets[-1] - offsets[0]:
            yield from slices(column.fill_null(""), limit)
            return
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray, sums: list[np.ndarray] | None = None) -> Words:
    """Split and fingerprint; sums: prefix sums of another byte mapping (see prefix_sums)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    m = classes[data]
    w = m != 0
    starts, ends = w.copy(), w.copy()
    starts[1:] &= ~w[:-1]
    ends[:-1] &= ~w[1:]
    full = np.flatnonzero(np.diff(bounds) > 0)  # a word doesn't go on in the next document
    starts[bounds[full]] = w[bounds[full]]
    ends[bounds[full + 1] - 1] = w[bounds[full + 1] - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if sums is None:
        sums = prefix_sums(m)
    h = span_hash(sums, s, e)
    return Words(data, bounds, s, e, h, np.searchsorted(s, bounds))


def prefix_sums(symbols: np.ndarray) -> list[np.ndarray]:
    """For each field the sums of (symbol + 1) * base**i before every place, not yet reduced."""
    n, out = len(symbols), []
    plus = symbols.astype(np.uint64) + np.uint64(1)
    for (prime, _), (p, _) in zip(_FIELDS, powers(n + 1), strict=True):
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(plus, p[:n], out=sums[1:])
        if n >= 1 << 24:  # terms below 2**39 would overflow
            sums %= np.uint64(prime)
        np.cumsum(sums, out=sums)
        out.append(sums)
    return out


def span_hash(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    for (prime, _), s, (_, inverse) in zip(_FIELDS, sums, powers(len(sums[0])), strict=True):
        q = np.uint64(prime)
        out = out << np.uint64(31) | (s[end] - s[start]) % q * inverse[start] % q
    return mix(out)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] of them, then those of start[1], ..."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether the bytes of two spans are equal, for each pair of spans."""
    size = end - start
    same = size == end2 - start2
    some = np.flatnonzero(same)
    wrong = np.zeros(int(size[some].sum()) + 1, np.int64)
    np.cumsum(data[ragged(start[some], size[some])] != data[ragged(start2[some], size[some])], out=wrong[1:])
    to = np.cumsum(size[some])
    same[some] = wrong[to] == wrong[to - size[some]]
    return same


def exact(w: Words) -> np.ndarray:
    """Numbers of the slice's words that are equal only for equal words: the fingerprints where bytes
    confirm them, else numbers in order of first sight."""
    if not len(w.hash):
        return w.hash
    _, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
    like = first[at]
    if same_spans(w.data, w.start, w.end, w.start[like], w.end[like]).all():
        return w.hash
    seen: dict[bytes, int] = {}
    return mix(np.array([seen.setdefault(w.data[a:b].tobytes(), len(seen)) for a, b in zip(w.start, w.end, strict=True)], np.uint64) + np.uint64(1))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each k-word window inside a document, and its fingerprint."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = weights(k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += w.hash[i : i + n] * p[i + 1]
    doc = w.doc
    keep = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return keep, mix(h[keep])


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
