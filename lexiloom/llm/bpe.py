"""Byte-level BPE token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbol ids. A round finds, for every
sequence at once, the lowest rank among its adjacent pairs, applies that pair wherever it stands
(left to right, without overlap) and closes the gaps; sequences without a pair in the merge table
drop out. The symbols that survive are the tokens. A pair made with a new symbol always ranks
after the merge that made it, so this gives what merging one pair at a time gives.

Counts of pre-tokens already seen are kept in a table per worker; what came last goes when it is full.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens; the strings of
added tokens inside a text count as one token each, as the library's default has it; repeated
documents give repeated rows; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexiloom.llm import textkernel as K
from lexiloom.session import ship

#: Fixed pattern of the byte-level pre-tokenizer.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same classes spelt out for texts of Latin-1 characters, which the faster engine takes.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_latin = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
_any = regex.compile(PRETOKEN).findall
CACHE = 400_000
LIMIT = 512


def halve(kept: dict) -> None:
    """Forget the later half: words that were met first are mostly the frequent ones."""
    for k in list(islice(kept, len(kept) // 2, None)):
        del kept[k]


def pretokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any(text)
    return _latin(text)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the rest follow from U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(spec: dict) -> None:
    """Raise for a tokenizer file that asks for more than is done here: plain byte-level merges, and added tokens as they stand."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    marked = [t["content"] for t in spec.get("added_tokens", ()) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if not plain or odd or marked or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        raise ValueError(f"not a plain byte-level tokenizer: model {odd}, added tokens {marked}, normalizer {spec.get('normalizer')}")


class RankMerger:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        refuse_others(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_id = np.zeros(256, np.int64)
        for symbol, byte in byte_symbols().items():
            self.byte_id[byte] = vocab[symbol]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        rank, made = np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs])
        key, first = np.unique(key, return_index=True)
        bits = max(4, math.ceil(math.log2(len(key) * 4)))
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)  # open addressing, probed in step
        self.slot_rank = np.full((1 << bits) + 64, 1 << 40, np.int64)
        self.made = made
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.slot_key[at] < 0
            _, one = np.unique(at, return_index=True)
            take = np.zeros(len(todo), bool)
            take[one] = free[one]
            self.slot_key[at[take]], self.slot_rank[at[take]] = key[todo[take]], rank[first[todo[take]]]
            todo, at = todo[~take], at[~take] + 1
        self.none = 1 << 40
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.counts: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = self._slot(key)
        out = np.full(len(key), self.none, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            there = self.slot_key[at]
            same = there == key[todo]
            out[todo[same]] = self.slot_rank[at[same]]
            on = ~same & (there >= 0)
            todo, at = todo[on], at[on] + 1
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each sequence of bytes."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        for who, ids, size in self._rounds(pieces):
            ends = np.cumsum(size)
            for i, e, n in zip(who, ends, size, strict=True):
                out[i] = ids[e - n : e]
        return out

    def count(self, pieces: list[bytes]) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        for who, _, size in self._rounds(pieces):
            out[who] = size
        return out

    def _rounds(self, pieces: list[bytes]):
        """Yields the sequences that are finished, their symbols and their sizes."""
        size = np.array([len(p) for p in pieces], np.int64)
        who = np.flatnonzero(size)
        size = size[who]
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(size)), size)
        rank = self._pair_ranks(ids, seq)
        while len(ids):
            start = np.cumsum(size) - size
            lowest = np.minimum.reduceat(rank, start)
            done = lowest == self.none
            if done.any():
                gone = done[seq]
                yield who[done], ids[gone], size[done]
                ids, rank, who, size, lowest = ids[~gone], rank[~gone], who[~done], size[~done], lowest[~done]
                if not len(ids):
                    return
                seq = np.repeat(np.arange(len(size)), size)
            hit = rank == lowest[seq]  # rank[i]: of the pair i, i + 1
            if (hit[1:] & hit[:-1]).any():  # x x x: the first, third, ... of a run
                at = np.arange(len(hit))
                begin = hit.copy()
                begin[1:] &= ~hit[:-1]
                since = at - np.maximum.accumulate(np.where(begin, at, -1))
                hit &= since % 2 == 0
            where = np.flatnonzero(hit)
            ids[where] = self.made[rank[where]]
            stays = np.ones(len(ids), bool)
            stays[where + 1] = False
            rank[where] = -1  # to be looked up again, with those before them
            before = where[where > 0] - 1
            rank[before] = -1
            size = size - np.bincount(seq[where], minlength=len(size))
            ids, rank, seq = ids[stays], rank[stays], seq[stays]
            again = np.flatnonzero(rank < 0)
            inner = again[again + 1 < len(ids)]
            rank[again] = self.none
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[inner] = self.ranks(ids[inner], ids[inner + 1])

    def _pair_ranks(self, ids: np.ndarray, seq: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), self.none, np.int64)
        if len(ids) > 1:
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        return rank

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. New pre-tokens of all texts go through the rounds together."""
        find, counts, out = pretokens, self.counts, []
        held, special = [], []
        for t in texts:
            parts = self.split.split(t) if self.split else [t]
            special.append(len(parts) - 1)
            held.append([find(p) for p in parts])
        new = set()
        for parts in held:
            for p in parts:
                new.update(p)
        if len(counts) + len(new) > CACHE:
            halve(counts)
        new = [x for x in new if x not in counts]
        counts.update(zip(new, self.count([x.encode() for x in new]).tolist(), strict=True))
        for parts, n in zip(held, special, strict=True):
            out.append(n + sum(sum(map(counts.__getitem__, p)) for p in parts))
        return out


_mergers: dict[str, RankMerger] = {}
K.KEPT.append(_mergers)


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers.clear()
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def runs(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """Per document: keep, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin(_mergers)
        m = merger(path)
        for batch in it:
            names = batch.schema.names
            column = batch.column(names.index("text"))
            texts = [x or "" for x in column.to_pylist()]
            tokens: list[int] = []
            for a, b in runs(texts):
                tokens += m.count_texts(texts[a:b])
            n = np.array(tokens, np.int64)
            size = [len(t.encode()) if not t.isascii() else len(t) for t in texts]
            rest = [i for i, x in enumerate(names) if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], [*(names[i] for i in rest), "n_bytes", "n_tokens", "over_limit"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, n_bytes bigint, n_tokens bigint, over_limit boolean")
