"""SentencePiece encoding (merge type) by backtracking, and decoding.

A sequence of pieces is what merging gives for its text exactly if every two adjacent pieces are
compatible: merging the text of both, and nothing else, gives them back. So the encoder walks the
text with the longest piece at each position (from one Aho-Corasick pass), takes it if it is
compatible with the piece before, tries its shorter prefixes otherwise, and steps back when none
is left; a bitfield of positions from which no encoding goes on keeps it from failing there twice.

Texts are cut where a run of the blank mark begins, and at control characters that are in no
piece: no piece has a blank mark after another character, so no merge crosses such a cut. The results of short stretches are kept in a bounded
table per worker; what came last goes when it is full.

Defined results: null and empty texts give the end id alone and decode to an empty text;
characters outside the vocabulary become byte pieces; control pieces are never matched in text;
repeated documents give repeated rows; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm import textkernel as K
from lexiloom.llm.bpe import halve
from lexiloom.session import ship

MARK = "▁"
CACHE = 750_000
PARTS = 200_000
PAIRS = 500_000
#: A longer stretch is encoded but not kept.
KEEP = 48


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ﬁ Å①  x "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises texts beyond marking blanks")
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.byte_id = {int(self.text[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = model.unk_id()
        self.end_id = model.eos_id()
        self.ids = {p: i for i, p in enumerate(self.text) if i not in special and i not in byte_of}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a blank mark after another character: stretches can't be encoded alone")
        self.number = [f"{i} " for i in range(n)]
        #: Control pieces are silent.
        self.spelt = [bytes([byte_of[i]]) if i in byte_of else (b"" if i in special else p.replace(MARK, " ").encode()) for i, p in enumerate(self.text)]
        if model.unk_id() >= 0:
            self.spelt[model.unk_id()] = " ⁇ ".encode()
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.single = {p for p in self.ids if len(p) == 1}
        self.inner = {c for p in self.ids for c in p} - self.single  # only inside longer pieces
        alphabet = self.single | self.inner  # a control character in no piece takes part in no merge
        cut = re.escape("".join(c for c in map(chr, range(32)) if c not in alphabet))
        self.stretch = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|[{cut}]" if cut else ""))
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, self.ids[p])
        self.matcher.make_automaton()
        self.width = n.bit_length()
        self.length = [len(p) for p in self.text]
        self.shorter = [-1] * n  # the longest piece that is a proper prefix
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        self.is_whole: list[bool | None] = [None] * n
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts: dict[str, list[int]] = {}
        self.pair: dict[int, bool] = {}
        self.kept = _Kept(self)
        self.long: list[str] = []  # stretches to be forgotten after their text
        self.odd: dict[str, str] = {}  # decoded texts of stretches that don't decode to themselves

    def merge(self, text: str) -> list[str]:
        """Merging as defined: the adjacent pair that makes the best piece, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the texts of both pieces gives them back."""
        if len(self.pair) >= PAIRS:
            self.pair.clear()
        a, b = self.text[left], self.text[right]
        ok = self.pair[left << self.width | right] = self.merge(a + b) == [a, b]
        return ok

    def whole(self, piece: int) -> bool:
        """Whether merging the piece's own text gives the piece."""
        ok = self.is_whole[piece]
        if ok is None:
            ok = self.is_whole[piece] = self.merge(self.text[piece]) == [self.text[piece]]
        return ok

    def _known(self, text: str) -> list[int]:
        """Ids of the pieces of a text of which every character is a piece."""
        longest, known, width, length = self.matcher.iter_long, self.pair.get, self.width, self.length
        straight = [p for _, p in longest(text)]  # the walk that never fails
        done = 0
        if self.whole(straight[0]):
            last, done = straight[0], 1
            for piece in straight[1:]:
                ok = known(last << width | piece)
                if not (self.compatible(last, piece) if ok is None else ok):
                    break
                last = piece
                done += 1
            else:
                return straight
        first, at = {}, 0
        for i, p in enumerate(straight):
            if i == done:
                begin = at
            first[at] = p
            at += length[p]
        size, closed, shorter = len(text), 0, self.shorter
        out, at, piece = straight[:done], begin, straight[done]
        while at < size:
            last = out[-1] if out else -1
            while piece >= 0:
                if not closed >> (at + length[piece]) & 1:
                    ok = self.whole(piece) if last < 0 else known(last << width | piece)
                    if self.compatible(last, piece) if ok is None else ok:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at += length[piece]
                if at < size:
                    piece = first.get(at, -1)
                    if piece < 0:
                        piece = first[at] = next(longest(text, at))[1]
                continue
            if last < 0:
                raise AssertionError(f"no encoding of {text!r}")  # its characters are all pieces
            closed |= 1 << at  # the bitfield of positions from which nothing goes on
            out.pop()
            at -= length[last]
            piece = last  # its end is closed now, so its prefixes come next
        return out

    def encode_stretch(self, text: str) -> list[int]:
        """Ids; no piece crosses a place where it would have two characters side by side that no
        piece has, so what lies between such places is encoded on its own, and kept."""
        out: list[int] = []
        joins, at, last = self.joins, 0, len(text)
        for i in range(1, last):
            if text[i - 1 : i + 1] not in joins:
                out += self.parts.get(text[at:i]) or self._part(text[at:i])
                at = i
        return out + (self.parts.get(text[at:]) or self._part(text[at:]))

    def _part(self, text: str) -> list[int]:
        if len(text) == 1 or (self.inner and not self.inner.isdisjoint(text)):
            found = []
            for p in self.merge(text):
                i = self.ids.get(p)
                found += [i] if i is not None else ([self.byte_id[b] for b in p.encode()] if self.byte_id else [self.unknown])
        else:
            found = self._known(text)
        if len(text) <= KEEP:
            if len(self.parts) >= PARTS:
                halve(self.parts)
            self.parts[text] = found
        return found

    def stretches(self, text: str) -> list[str]:
        return self.stretch.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids without the end id."""
        return [i for s in self.stretches(text) for i in self.encode_stretch(s)]

    def decode(self, ids: Iterable[int]) -> str:
        """Control pieces are silent; the first blank is the one that encoding put there."""
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def encoded(self, text: str) -> tuple[str, int, str]:
        """Ids with the end id, as decimals between blanks; how many; what they decode to."""
        stretches = self.stretches(text)
        if not stretches:
            return str(self.end_id), 1, ""
        if len(self.kept) > CACHE:
            halve(self.kept)
            self.odd = {k: v for k, v in self.odd.items() if k in self.kept}
        said = "".join(map(self.kept.__getitem__, stretches))
        if self.odd:
            decoded = "".join(self.odd.get(s) or s.replace(MARK, " ") for s in stretches)
        else:
            decoded = f" {text.replace(MARK, ' ')}"
        if self.long:
            for s in self.long:
                del self.kept[s]
                self.odd.pop(s, None)
            self.long.clear()
        return f"{said}{self.end_id}", said.count(" ") + 1, decoded[1:] if decoded.startswith(" ") else decoded


class _Kept(dict):
    """The ids of stretches, each followed by a blank. They are decoded once, when they are new."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec

    def __missing__(self, stretch: str) -> str:
        c = self.codec
        ids = c.encode_stretch(stretch)
        if len(stretch) > KEEP:
            c.long.append(stretch)
        decoded = b"".join(map(c.spelt.__getitem__, ids)).decode("utf-8", "replace")
        if decoded != stretch.replace(MARK, " "):
            c.odd[stretch] = decoded
        said = self[stretch] = "".join(map(c.number.__getitem__, ids))
        return said


_codecs: dict[str, PieceCodec] = {}
K.KEPT.append(_codecs)


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: keep, n_tokens, ids (decimals between blanks, end id last), decoded."""
    return _mapped(docs, path, keep, {"n_tokens": ("bigint", lambda e: e[1]), "ids": ("string", lambda e: e[0]), "decoded": ("string", lambda e: e[2])})


def encode_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: keep, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return _mapped(docs, path, keep, {"n_tokens": ("bigint", lambda e: e[1]), "ids_sha256": ("string", lambda e: sha(e[0])), "decoded_sha256": ("string", lambda e: sha(e[2]))})


def _mapped(docs: DataFrame, path: str, keep: tuple[str, ...], columns: dict) -> DataFrame:
    ship(docs.sparkSession)
    types = {"bigint": pa.int64(), "string": pa.string()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin(_codecs)
        c = codec(path)
        for batch in it:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            rest = [i for i, x in enumerate(names) if x != "text"]
            step = 512
            for a in range(0, len(texts), step):
                got: dict[str, list] = {k: [] for k in columns}
                for t in texts.slice(a, step).to_pylist():
                    e = c.encoded(t or "")
                    for k, (_, f) in columns.items():
                        got[k].append(f(e))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, step) for i in rest), *(pa.array(got[k], types[t]) for k, (t, _) in columns.items())], [*(names[i] for i in rest), *columns])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, " + ", ".join(f"{k} {t}" for k, (t, _) in columns.items()))
