"""Repair of conversations whose turns are damaged: the cheapest edits that make roles alternate.

Rows of a conversation stand in the order of (turn with nulls first, role, digest of the text); a row's first fault is `blank`,
`duplicate` (role and text seen earlier) or `truncated`. A repaired conversation is empty, or pairs of user and assistant behind at most one
system row. Edits are Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate rows) and
Insert an empty user or assistant row anywhere (5); a truncated row that stays costs 5 more.

What an edit may do depends on the row and on what the grammar has seen: nothing, a system row, a user row or an assistant row. `plan`
computes backward, row by row, the cost to go from each of the four states, keeps for each the ASCII-least letter whose
cost is tight, and then walks forward from the first state along those letters. Repaired rows are built from the letters, in order, for the hash.

On Spark: faults are column functions, first rows of equal (role, text) come from one aggregate joined back where something repeats. Rows without their texts go to
ranges of (conv_id, turn, role, digest), so a long conversation is cut into pieces that many tasks read; each task writes a piece of a
conversation as one byte a row and a few counts. Only conversations at the ends of a range can have other pieces; those meet as such
bytes. Texts are sorted once, by conversation, and stream past the conversation's letters: a SHA-256 can't be computed in parts, so the texts of one conversation pass
through one task, which holds one row at a time.

Defined results: a null role or text is one space, so that a null text is blank; a null conv_id or turn stands as one space in the key whose checksum
chooses the damage. Rows with a null conv_id are one conversation. Rows equal in conv_id, turn, role and text are interchangeable; all but one are duplicates. An empty role, like every
one that begins with none of s, u and a, has no place in the grammar and can't be kept. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.checkpoints import cut
from lexiloom.session import ship

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, WEAK = 0, 1, 2, 5, 5
#: States of the grammar, and what an inserted or reroled row leads to from each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
THEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A kept row's state by its role, from the states where the grammar allows it.
KEPT_FROM = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,), NOTHING: ()}
FINE, TRUNCATED, GONE = range(3)
FAR = 1 << 40

PIECE = "conv_id bigint, piece bigint, edge boolean, codes binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role int, last_role int, first_turn bigint, last_turn bigint, n_turns bigint"
FOUND = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
RESULT = FOUND + ", repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that each row's key chooses."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    chosen = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return chosen.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), times.alias("time")).drop("time")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and fault of each row: 0, `truncated` (1), `duplicate` (2) or `blank` (3). A repeated
    row of the first one's turn isn't told from it here: such rows are equal and stand together, and the next step marks all but the first."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", 3).when(F.substring(trimmed, -1, 1).isin(*ENDS), 0).otherwise(1)
    brief = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), fault.alias("fault"))
    key = ("conv_id", "role", "digest")
    again = brief.groupBy(*key).agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    a, b = brief.alias("a"), again.alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left")
    later = F.col("b.n").isNotNull() & ~F.col("a.turn").eqNullSafe(F.col("b.first.turn"))
    return joined.select("a.conv_id", "a.turn", "a.role", "a.digest", F.when((F.col("fault") != 3) & later, 2).otherwise(F.col("fault")).alias("fault"))


class _Piece:
    """The rows of a conversation that a task has read so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.faults = conv_id, bytearray(), [0, 0, 0, 0]
        self.illegal, self.n_turns, self.first_turn, self.last_turn, self.before = 0, 0, None, None, None

    def add(self, turn: int | None, role: str, digest: bytes, fault: int) -> None:
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], NOTHING)
        now = (turn, role, digest)
        if fault != 3 and now == self.before:
            fault = 2
        if self.codes:
            self.illegal += not follows(self.codes[-1] // 3, state)
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        self.faults[fault] += 1
        self.codes.append(3 * state + min(fault, GONE))
        self.before = now

    def row(self, number: int, edge: bool) -> tuple:
        return (self.conv_id, number, edge, bytes(self.codes), self.faults[3], self.faults[2], self.faults[1], self.illegal, self.codes[0] // 3, self.codes[-1] // 3, self.first_turn, self.last_turn, self.n_turns)


def follows(a: int, b: int) -> bool:
    """Whether roles of these states may stand side by side: su, ua or au."""
    return (a, b) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def arrow_schema(text: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


def pieces(faults: DataFrame) -> DataFrame:
    """Rows of marked() as pieces of conversations, one for each conversation and range; `edge` where others may belong to it."""
    schema = arrow_schema(PIECE)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin()
        number = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            now, first = None, True
            for batch in it:
                for conv_id, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            yield now.row(number, first)
                            first = False
                        now = _Piece(conv_id)
                    now.add(*row)
            if now is not None:
                yield now.row(number, True)

        yield from batches(rows(), schema)

    order = ("conv_id", "turn", "role", "digest")
    return faults.select(*order, "fault").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PIECE)


@cache
def step(code: int | None, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], int, bytes]:
    """Costs to go before a row (None: at the end) from those behind it, less their least; that least; and each state's letter.
    Costs to go differ by a few edits at most, so there are few different calls."""
    state, fault = divmod(code, 3) if code is not None else (NOTHING, FINE)
    ways: list[dict[str, int]] = []
    for s in range(4):
        if code is None:
            ways.append({"": ahead[s]})
            continue
        way = {"D": DELETE + ahead[s]}
        if fault != GONE:
            weak = WEAK * (fault == TRUNCATED)
            if s in KEPT_FROM[state]:
                way["K"] = KEEP + weak + ahead[state]
            way["R"] = REROLE + weak + ahead[THEN[s]]
        ways.append(way)
    cost = [min(w.values()) for w in ways]
    for _ in range(2):  # at most two rows are inserted in one place
        cost = [min(c, INSERT + cost[THEN[s]]) for s, c in enumerate(cost)]
    letters = bytearray()
    for s, way in enumerate(ways):
        if INSERT + cost[THEN[s]] == cost[s]:
            way["I"] = cost[s]
        letters.append(ord(min((x for x, c in way.items() if c == cost[s]), default="") or " "))
    least = min(cost)
    return tuple(c - least for c in cost), least, bytes(letters)


def plan(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, ASCII-least among equals; five bytes a row are held."""
    ahead, base, last = step(None, (0, FAR, FAR, 0))
    chosen = bytearray(4 * len(codes) + 4)
    chosen[-4:] = last
    for i in range(len(codes) - 1, -1, -1):
        ahead, more, letters = step(codes[i], ahead)
        base += more
        chosen[4 * i : 4 * i + 4] = letters
    out, i, s = bytearray(), 0, NOTHING
    while (letter := chosen[4 * i + s]) != 32:
        out.append(letter)
        s = {68: s, 75: codes[i] // 3 if i < len(codes) else s}.get(letter, THEN[s])
        i += letter != 73
    return base + ahead[NOTHING], out.decode()


def repaired(parts: list[tuple]) -> tuple:
    """A FOUND row from a conversation's pieces in order."""
    conv_id = parts[0][0]
    codes = b"".join(p[3] for p in parts)
    blank, duplicate, truncated, illegal = (sum(p[i] for p in parts) for i in range(4, 8))
    illegal += sum(not follows(a[9], b[8]) for a, b in zip(parts, parts[1:], strict=False))
    dated = [p for p in parts if p[10] is not None]
    turns = sum(p[12] for p in dated) - sum(a[11] == b[10] for a, b in zip(dated, dated[1:], strict=False))
    gaps = dated[-1][11] - dated[0][10] + 1 - turns if dated else 0
    cost, audit = plan(codes)
    return conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit


def audits(found: DataFrame) -> DataFrame:
    """FOUND rows of pieces(): whole conversations where they are, those at the ends of ranges after their pieces have met."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    schema = arrow_schema(FOUND)

    def alone(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((repaired([row]) for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), schema)

    def met(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(n).to_pylist() for n in names), strict=True), key=lambda r: r[1])
        return pa.Table.from_batches(list(batches(iter([repaired(rows)]), schema)), schema=schema)

    whole = found.where("NOT edge").select(*names).mapInArrow(alone, FOUND)
    return whole.unionByName(found.where("edge").select(*names).groupBy("conv_id").applyInArrow(met, FOUND))


def emitted(letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of each repaired row."""
    s = NOTHING
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        s = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]] if letter == "K" else THEN[s]
        yield role if letter == "K" else NAMES[s], text


def with_hashes(found: DataFrame, rows: DataFrame) -> DataFrame:
    """FOUND rows with the SHA-256 of the repaired rows, `role:text` joined by newlines. rows: those that the letters are for."""
    schema = arrow_schema(RESULT)
    facts = [c.split()[0] for c in FOUND.split(", ")]
    order = (F.col("turn"), F.col("role"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in FOUND.split(", ")[1:]]
    heads = found.select(*facts, F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("digest"))
    texts = rows.select("conv_id", *none, "turn", "role", "text", F.lit(1).alias("kind"), order[2].alias("digest"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin()
        stream = (row for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []  # the next conversation's first row

        def own_rows() -> Iterator[tuple[str, str]]:
            for row in stream:
                if row[-1] == 0:
                    held.append(row)
                    return
                yield row[8], row[9]

        def done() -> Iterator[tuple]:
            held.extend([r] if (r := next(stream, None)) else [])
            while held:
                head = held.pop()
                sha, own = hashlib.sha256(), own_rows()
                for i, (role, text) in enumerate(emitted(head[7], own)):
                    sha.update(f"{chr(10) if i else ''}{role}:{text}".encode())
                for _ in own:  # the next one's first row comes behind these
                    pass
                yield *head[:8], sha.hexdigest()

        yield from batches(done(), schema)

    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select(*facts, "role", "text", "kind").mapInArrow(run, RESULT)


def repair(rows: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and repaired hash of each conversation of rows (conv_id, turn, role, text without nulls but in
    the first two). all_ids: conversations to return even where no row is left."""
    found = audits(cut(pieces(marked(rows)), "pieces"))
    if all_ids is not None:
        ids = all_ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().alias("i")
        facts = [c.split() for c in FOUND.split(", ")[1:]]
        empty = {"bigint": F.lit(0).cast("bigint"), "string": F.lit("")}
        found = ids.join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select("i.conv_id", *(F.coalesce(F.col(f"f.{n}"), empty[k]).alias(n) for n, k in facts))
    return with_hashes(found, rows)


def query(rows: DataFrame) -> DataFrame:
    ship(rows.sparkSession)
    return repair(damaged(rows), rows)
