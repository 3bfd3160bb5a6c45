"""Operator 13 against a plain version that searches all edits, on random conversations of every awkward kind."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb

from lexiloom.llm import oracles, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, audit string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def order(row):
    return (row[1] is not None, row[1] or 0, row[2], hashlib.sha256(row[3].encode()).digest())


def cheapest(rows):
    """Dijkstra over (cost, letters, rows used, roles made): rows are (role, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        # of equal cost, the least letters come off the heap first
        key = (i, roles[:1] == "s" and len(roles) == 1, roles[-1:])
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        if key in seen:
            continue
        seen.add(key)
        then = "a" if roles[-1:] == "u" else "u"
        ways = [(5, "I", i, then)]
        if i < len(rows):
            role, fault = rows[i]
            weak = 5 * (fault == "truncated")
            ways.append((2, "D", i + 1, ""))
            if fault not in ("blank", "duplicate"):
                ways.append((1 + weak, "R", i + 1, then))
                if role[:1] == then or (role[:1] == "s" and not roles):
                    ways.append((weak, "K", i + 1, role[:1]))
        for more, letter, at, made in ways:
            heapq.heappush(heap, (cost + more, letters + letter, at, roles + made))
    raise AssertionError


def plain(rows):
    """The contract's row for every conversation."""
    after, out = {}, {}
    for r in plain_damage(rows):
        after.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        own, seen, faults = sorted(after.get(conv, []), key=order), set(), []
        for _, _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        dated = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest([(r[2], f) for r, f in zip(own, faults, strict=True)])
        made, left = [], iter(own)
        for x in audit:
            _, _, role, text = (None, None, "", "") if x == "I" else next(left)
            if x != "D":
                made.append((role if x == "K" else "assistant" if made and made[-1][0][:1] == "u" else "user", text))
        body = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def made_up(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += rng.choice([1, 1, 1, 2, 0])
            text = rng.choice(["Yes.", "No!", "well", "why?", "", " \n", "é…", "Ünd so. \t", None, f"own {rng.random()}.", f"own {rng.random()}"])
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "s", "User"]), text, "x", "y"))
    rows += [(None, i, "user", f"t{i}.", "x", "y") for i in range(5)] + [(7777, 3, "user", "x." * 200_000, "k", "a")] * 3
    return rows


def test_random_conversations_equal_a_plain_version(spark):
    for seed in (1, 2):
        rows = made_up(seed)
        got = turns.query(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows) and len(got) == len({r[0] for r in rows})


def test_sql_equals_a_plain_version():
    """The oracle holds the same on rows of every kind, ties among them."""
    rows = made_up(3)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    found = db.sql(oracles.CONVERSATIONS)
    names = [d[0] for d in found.description]
    assert names == [c.split()[0] for c in turns.RESULT.split(", ")]
    assert {r[0]: r[1:] for r in found.fetchall()} == plain(rows)


def test_one_long_conversation_in_many_ranges(spark):
    """Pieces of a conversation in several tasks give what one task would."""
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"a {t}.", f"b {t}", "again.", ""]), "x", "y") for t in range(3000)] + [(0, 1, "user", "a.", "", ""), (2, 1, "user", "b.", "", "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert turns.pieces(turns.marked(turns.damaged(docs))).where("conv_id = 1").count() > 8
        got = {r.conv_id: tuple(r)[1:] for r in turns.query(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == plain(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.query(empty).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (r,) = turns.query(spark.createDataFrame([(5, gone, "user", "Hi.", None, None)], SCHEMA)).collect()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_letters_of_equal_cost():
    """Ties go to the ASCII-least letters: D before I before K before R."""
    code = {"s": 3, "u": 6, "a": 9, "x": 0}
    for text, want in (("", (0, "")), ("u", (2, "D")), ("ua", (0, "KK")), ("aa", (1, "RK")), ("uu", (1, "KR")), ("s", (2, "D")), ("sa", cheapest([("s", ""), ("a", "")]))):
        assert turns.plan(bytes(code[c] for c in text))[1] == want[1]
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice("suax"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 12))]
        codes = bytes(code[r] + {"": 0, "truncated": 1, "blank": 2}[f] for r, f in rows)
        assert turns.plan(codes) == cheapest(rows)
