"""Operator 11 against the contract done plainly, and its parts against reading the bytes."""

import difflib
import hashlib
import os
import random

import numpy as np

from lexiloom.llm import prints

SCHEMA = "doc_id bigint, text string, part string, print string, ahead int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", "a", "ab", "abc", "é日本🙂" * 5, "w " * 40_000, sentence(rng, 30_000)] + [sentence(rng, rng.randint(1, 300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[20]) for i in range(30)] + [(50, f"same id {i}") for i in range(40)] + [(50, texts[9])] * 5 + [(None, "no id"), (None, None)]
    rng.shuffle(rows)
    return rows


def test_next_documents_and_edits(spark):
    rows = corpus()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "7", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            docs = spark.createDataFrame([(i, t, "p", "q", 1) for i, t in rows], SCHEMA).repartition(5)
            got = prints.query(docs).collect()
            text = {r[0]: r[1] for r in docs.selectExpr("xxhash64(coalesce(text, ''))", "coalesce(text, '')").collect()}
            ordered = sorted(docs.selectExpr("doc_id", "xxhash64(coalesce(text, ''))").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        want = []
        for (i, p), (_, q) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
            own, after = text[p], text[q]
            k = len(own) // 3
            edited = own[: len(own) - k] + after[:k]
            want.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), len(os.path.commonprefix([own, after]))))
        key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.common_next) for r in got), key=key) == sorted(want, key=key)
        assert len({r.fingerprint for r in got}) == len(set(text.values()))
        assert all(0.0 <= v <= 1.0 for r in got for v in (r.near_edited, r.near_next))
        long = [r for r in got if r.n_chars > 200 and r.near_edited < 1]
        assert min(r.near_edited for r in long) > 0.5 > max(r.near_next for r in long if r.near_next < 1)


def test_empty_table(spark):
    got = prints.query(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_spans_and_extensions_equal_the_bytes():
    rng = random.Random(3)
    for _ in range(60):
        a = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 60)))
        b = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 60)))
        p, r = (prints.prefixes(np.frombuffer(x, np.uint8)) for x in (a, b))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert prints.extension(p, r, i, j) == len(os.path.commonprefix([a[i:], b[j:]]))
    long = rng.randbytes(2 * prints.BLOCK + 1000)
    other = b"xyz" + long[:-500] + b"?" * 500
    p, r = (prints.prefixes(np.frombuffer(x, np.uint8)) for x in (long, other))
    assert prints.extension(p, r, 0, 3) == len(long) - 500 and prints.extension(p, r, 10, 10) == 0


def test_places_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    data = prints.as_bytes(sentence(rng, 4000) + "again and again " * 900)
    at, h = prints.places(data)
    monkeypatch.setattr(prints, "BLOCK", 1000)
    at2, h2 = prints.places(data)
    assert at.tolist() == at2.tolist() and h.tolist() == h2.tolist() and len(at) == prints.CUTS


def test_likeness_follows_what_texts_share():
    rng = random.Random(5)
    for _ in range(40):
        own = sentence(rng, rng.randint(40, 800))
        a, b = sorted(rng.sample(range(len(own)), 2))
        moved = [own[b:] + own[a:b] + own[:a], "New start. " + own, own[:a] + own[b:], own[:a] + "CHANGED" + own[a:]]
        for other in moved:
            one, two = (prints.make(prints.as_bytes(t)) for t in (own, other))
            assert prints.parse(str(one)).cuts.tolist() == one.cuts.tolist() and prints.parse(str(one)).grid.tolist() == one.grid.tolist()
            got = prints.likeness(one, two)
            shared = 2 * sum(m.size for m in difflib.SequenceMatcher(None, own, other, autojunk=False).get_matching_blocks()) / (len(own) + len(other)) if len(own) < 1500 else None
            assert got == prints.likeness(two, one)
            if shared is not None and other is not moved[0]:
                assert shared + 1e-9 >= got > shared - 0.35
            assert prints.likeness(one, prints.make(prints.as_bytes(sentence(rng, 200)))) < 0.2


def test_columns(spark):
    rows = spark.createDataFrame([("one two three four five six", "one two three four five six"), ("one two", None), (None, "")], "a string, b string")
    got = rows.select(prints.alike(prints.fingerprint("a"), prints.fingerprint("b")).alias("x"), prints.fingerprint("b").alias("y")).collect()
    assert [r.x for r in got] == [1.0, 0.0, 1.0] and got[1].y == got[2].y
