"""Word tokens with the zones that protect them.

A word is a run of letters, digits and apostrophes without those at its ends. A word is protected
if it touches front matter, a code fence, inline code, a link, an address, a mention, a tag or a
link target, if it has a digit, or if it is an acronym. Offsets are given in UTF-8 bytes and in
code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import ship

WORD = r"[\p{IsAlphabetic}\p{N}'’]+"
APOSTROPHES = "'’"
REASONS = ("frontmatter", "code_fence", "inline_code", "url", "email", "mention", "tag", "link_target", "has_digit", "acronym")
TOKEN = "pos int, byte_start int, byte_end int, char_start int, char_end int, word string, reason string"
NEIGHBOURS = "prev_word string, next_word string"
#: Offsets as editors count them: a character outside the first plane is two units.
UTF16 = "utf16_start int, utf16_end int"
#: Words that a Python worker holds at once.
PART = 1 << 15

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LINK = re.compile(r"(?=(https://|http://|ftp://|www\.))", re.S)
_LINK_END = re.compile(r"[ \t\n\r\f]|\Z")
_MARKS = re.compile(r"[@#`\]]|://|www\.")
_ADDRESS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-+")
_DOMAIN = re.compile(r"[A-Za-z0-9._-]*")
_NAME = re.compile(r"(?:(?<=[ \t\n\r\f(\[\"'])|\A)([@#])[A-Za-z0-9_/-]+")


class _Cover:
    """Half-open ranges, merged, and whether a place is in one of them."""

    def __init__(self, ranges: Iterable[tuple[int, int]]):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(ranges):
            if a >= b:
                continue
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)

    def end(self, i: int) -> int | None:
        k = bisect_right(self.begins, i) - 1
        return self.ends[k] if k >= 0 and i < self.ends[k] else None


def zones(text: str) -> list[tuple[int, int, str]]:
    """Protected ranges in code points, by start and end."""
    out: list[tuple[int, int, str]] = []
    if text.startswith("---") and (nl := text.find("\n")) >= 0:
        at = nl + 1
        while at <= len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            if text[at:end].strip() == "---":
                out.append((0, end, "frontmatter"))
                break
            at = end + 1
    fences = [m.span() for m in _FENCE.finditer(text)]
    out += [(a, b, "code_fence") for a, b in fences]
    marks = [m.start() for m in _MARKS.finditer(text)]  # each of them begins a zone or doesn't
    if not marks:
        return out

    fence = _Cover(fences)
    at = text.find("`")
    while at >= 0:
        if (end := fence.end(at)) is not None:
            at = text.find("`", end)
            continue
        close = text.find("`", at + 1)
        if close < 0:
            break
        out.append((at, close + 1, "inline_code"))
        at = text.find("`", close + 1)

    covered = _Cover((a, b) for a, b, _ in out)
    starts: dict[str, list[int]] = {}
    for m in _LINK.finditer(text):
        starts.setdefault(m[1], []).append(m.start())
    for scheme in ("https://", "http://", "ftp://", "www."):
        found = []
        for a in starts.get(scheme, ()):
            if covered.end(a) is None and not (found and a < found[-1][1]):
                b = _LINK_END.search(text, a).start()
                found.append((a, a + len(text[a:b].rstrip(".,)];:!?")), "url"))
        if found:
            out += found
            covered = _Cover((a, b) for a, b, _ in out)

    named: list[tuple[int, int]] = []  # zones of this loop, which later marks must not stand in
    for i in marks:
        if text[i] not in "@#" or covered.end(i) is not None or named and named[-1][0] <= i < named[-1][1]:
            continue
        before = text[i - 1] if i else " "
        if text[i] == "@" and before in _ADDRESS:
            a, b = i, _DOMAIN.match(text, i + 1).end()
            while a and text[a - 1] in _ADDRESS:
                a -= 1
            while b > i + 1 and text[b - 1] == ".":
                b -= 1
            if "." in text[i + 1 : b]:
                out.append((a, b, "email"))
                named.append((a, b))
        elif (m := _NAME.match(text, i)) is not None:
            out.append((i, m.end(), "mention" if text[i] == "@" else "tag"))
            named.append((i, m.end()))

    at = text.find("](")
    while at >= 0:
        close = text.find(")", at + 1)
        if close < 0:
            break
        out.append((at + 1, close + 1, "link_target"))
        at = text.find("](", close + 1)
    return sorted(out, key=lambda z: z[:2])


_RUNS = re.compile(rf"(?:[^\W_]|[{APOSTROPHES}])+")
_FIRST_MARK = "\u0345"  # the first letter-like mark that only \p{Alphabetic} takes


@cache
def _runs_with_marks() -> re.Pattern:
    import regex

    return regex.compile(rf"[\p{{Alphabetic}}\p{{N}}{APOSTROPHES}]+")


_LETTER, _APOSTROPHE = 1, 2
_AS_LOWER = np.arange(256, dtype=np.uint8)
_AS_LOWER[ord("A") : ord("Z") + 1] += 32


@cache
def _kinds() -> np.ndarray:
    """What each code point is in a word."""
    import regex

    kinds = np.zeros(0x110000, np.uint8)
    for run in regex.finditer(r"[\p{Alphabetic}\p{N}]+", "".join(map(chr, range(0x110000)))):
        kinds[run.start() : run.end()] = _LETTER
    kinds[[ord(c) for c in APOSTROPHES]] = _APOSTROPHE
    return kinds


def spans(texts: pa.Array) -> tuple[pa.Array, np.ndarray, bytes]:
    """Words of all texts in one array, with A-Z as a-z; the number of words before each text; and the last word as it was
    written. No text is made a Python string of its own."""
    lengths = pc.binary_length(texts).to_numpy()
    around = pa.array([""], pa.string())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts) + 2], pa.int32()), pa.concat_arrays([around, texts, around])), "\n")
    data = np.frombuffer(joined.buffers()[2], np.uint8)[: int(lengths.sum()) + len(texts) + 1]
    kinds = _kinds()[np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4")]
    marks = np.flatnonzero(kinds == _APOSTROPHE)
    if len(marks):  # those between letters belong to the word
        apart = np.diff(marks) > 1
        first, last = marks[np.append(True, apart)], marks[np.append(apart, True)]
        kinds[marks] = np.repeat((kinds[first - 1] == _LETTER) & (kinds[last + 1] == _LETTER), last - first + 1)
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    if len(data) != len(kinds):
        places = np.flatnonzero((data & 0xC0) != 0x80)
        edges, kinds = places[edges], np.repeat(kinds, np.diff(np.append(places, len(data))))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_AS_LOWER[data[kinds.view(bool)]]))
    begins = 1 + np.append(0, np.cumsum(lengths[:-1].astype(np.int64) + 1))
    return words, np.searchsorted(starts, begins), data[starts[-1] : ends[-1]].tobytes() if len(starts) else b""


def tokens_of(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, reason) of each word, in code points."""
    return [(s, e, why) for s, e, _, why in _words_of(text)]


def _words_of(text: str, zoned: bool = True) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, end, word, reason) of each word."""
    ranges = zones(text) if zoned else []
    touched = _Touched(ranges)
    runs = _RUNS if text.isascii() or max(text) < _FIRST_MARK else _runs_with_marks()
    for run in runs.finditer(text):
        word, s = run[0], run.start()
        if word[0] in APOSTROPHES or word[-1] in APOSTROPHES:
            bare = word.lstrip(APOSTROPHES)
            s += len(word) - len(bare)
            word = bare.rstrip(APOSTROPHES)
            if not word:
                continue
        e = s + len(word)
        why = touched.label(s, e) if ranges else None
        if why is None:
            if not word.isalpha() and any(c.isnumeric() for c in word):
                why = "has_digit"
            elif word[0].isupper() and word[-1].isupper() and len(letters := [c for c in word if c.isalpha()]) >= 2 and all(c.isupper() for c in letters):
                why = "acronym"
        yield s, e, word, why


class _Touched:
    """Labels of words by the zones they touch; words come in order. Of several zones the first by (start, end) counts."""

    def __init__(self, ranges: list[tuple[int, int, str]]):
        self.ranges, self.at, self.open = ranges, 0, []

    def label(self, s: int, e: int) -> str | None:
        while self.at < len(self.ranges) and self.ranges[self.at][0] < e:
            heappush(self.open, self.ranges[self.at])
            self.at += 1
        while self.open and self.open[0][1] <= s:
            heappop(self.open)
        # ended zones deeper in the heap begin after the top, which is still open
        return self.open[0][2] if self.open else None


def _parts(text: str, zoned: bool) -> Iterator[tuple[list[tuple[int, int, str, str | None]], str | None]]:
    """A text's words in lists of about PART, each with the first word behind it that isn't protected. A list ends before such a
    word, so it gets longer where none comes."""
    rows: list[tuple[int, int, str, str | None]] = []
    for r in _words_of(text, zoned):
        if len(rows) >= PART and r[3] is None:
            yield rows, r[2]
            rows = []
        rows.append(r)
    if rows:
        yield rows, None


class _Places:
    """Bytes and UTF-16 units before places of a text that are given in code points."""

    def __init__(self, text: str):
        self.bytes = self.units = None
        if not text.isascii():
            width = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sums = lambda n: np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
            self.bytes = sums(1 + (width > 0x7F).astype(np.int8) + (width > 0x7FF) + (width > 0xFFFF))
            if max(text) > "\uffff":
                self.units = sums(1 + (width > 0xFFFF).astype(np.int8))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (at if self.bytes is None else self.bytes[at]), (at if self.units is None else self.units[at])


def _batches(text_at: int, names: list[str], zoned: bool):
    """Rows of words, put out as soon as there are PART of them, however many texts a batch has and however long they are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = _Words()
            for i, text in enumerate(batch.column(text_at)):
                text = text.as_py()
                if not text:
                    continue
                places, n, last = _Places(text), 0, None
                for rows, behind in _parts(text, zoned):
                    last = out.add(i, n, rows, last, behind, places)
                    n += len(rows)
                    if len(out.pos) >= PART:
                        yield out.made(batch, text_at, names)
                        out = _Words()
            if out.pos:
                yield out.made(batch, text_at, names)

    return run


class _Words:
    """Columns of the words of a part of a batch."""

    def __init__(self) -> None:
        self.at, self.pos, self.found, self.bytes, self.units, self.before, self.after = [], [], [], [], [], [], []

    def add(self, i: int, n: int, rows: list, last: str | None, behind: str | None, places: _Places) -> str | None:
        """Words of the text in row i, from the n-th on, between the words `last` and `behind`; gives the last free one."""
        self.at.append((i, len(rows)))
        self.pos += range(n, n + len(rows))
        self.found += rows
        b, u = places.of(np.array([x for r in rows for x in r[:2]], np.int32))
        self.bytes.append(b)
        self.units.append(u)
        for r in rows:
            self.before.append(last)
            last = r[2] if r[3] is None else last
        back = []
        for r in reversed(rows):
            back.append(behind)
            behind = r[2] if r[3] is None else behind
        self.after += reversed(back)
        return last

    def made(self, batch: pa.RecordBatch, text_at: int, names: list[str]) -> pa.RecordBatch:
        keep = pa.array(np.repeat(*np.array(self.at, np.int64).T))
        bytes_, units = np.concatenate(self.bytes), np.concatenate(self.units)
        columns = [pa.array(self.pos, pa.int32()), pa.array(bytes_[::2]), pa.array(bytes_[1::2]), *(pa.array([r[k] for r in self.found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))), pa.array(self.before, pa.string()), pa.array(self.after, pa.string()), pa.array(units[::2]), pa.array(units[1::2])]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(keep) for i in range(len(names)) if i != text_at), *columns], [*(n for i, n in enumerate(names) if i != text_at), *(x.split()[0] for x in f"{TOKEN}, {NEIGHBOURS}, {UTF16}".split(", "))])


def tokens(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", zoned: bool = True, neighbours: bool = False, utf16: bool = False) -> DataFrame:
    """A row for each word: keys and TOKEN, and NEIGHBOURS and UTF16 if asked for; reason is null for words that aren't
    protected. Without zones a word is protected only for what it is itself. Neighbours are found in the row's own
    text, so they need no shuffle."""
    ship(docs.sparkSession)
    some = docs.select(*keys, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.drop("_text").schema.fields)
    out = some.mapInArrow(_batches(len(keys), some.columns, zoned), f"{kept}, {TOKEN}, {NEIGHBOURS}, {UTF16}")
    return out.drop(*(() if neighbours else ("prev_word", "next_word")), *(() if utf16 else ("utf16_start", "utf16_end")))


def words(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Words alone, by built-in functions: keys, pos and word. For texts without zones."""
    bare = F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda w: F.btrim(w, F.lit(APOSTROPHES)))
    return docs.select(*keys, F.posexplode(F.filter(bare, lambda w: w != "")).alias("pos", "word"))


def with_neighbours(toks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """toks with prev_word and next_word: the nearest words that aren't protected, in a document."""
    w = Window.partitionBy(*keys).orderBy("pos")
    free = F.when(F.col("reason").isNull(), F.col("word"))
    return toks.withColumns(
        {
            "prev_word": F.last(free, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "next_word": F.first(free, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        }
    )


def overlaps(start: Column, end: Column, range_start: Column, range_end: Column) -> Column:
    """Half-open ranges that share a position."""
    return (start < range_end) & (range_start < end)
