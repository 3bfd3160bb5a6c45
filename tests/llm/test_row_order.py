"""Operator 5 where a task meets its rows in another order each time, and with texts of odd bytes."""

import random
import re

import numpy as np
import pyarrow as pa

from lexiloom.llm import jaccard, textkernel

SCHEMA = "doc_id bigint, text string"


def permuted(docs):
    """docs whose tasks give their rows in another order at every evaluation, as after a shuffle."""

    def run(it):
        rng = np.random.default_rng()
        rows = pa.Table.from_batches(list(it))
        yield from rows.take(pa.array(rng.permutation(len(rows)))).combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)


def plain(rows):
    """Components by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                a, b = sets[i], sets[j]
                if i < j and root[i] != root[j] and a and b and 4 * len(a & b) >= 3 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in ids}


def test_rows_in_another_order_at_each_evaluation(spark):
    rng = random.Random(6)
    rows = []
    for g in range(50):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        near = [*words[:-1], "other"]
        rows += [(100 * g + k, " ".join(words)) for k in range(3)] + [(100 * g + 9, " ".join(near))]
    docs = permuted(spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert [r.doc_id for r in docs.collect()] != [r.doc_id for r in docs.collect()]
    for _ in range(2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(docs).collect()}
        assert got == plain(rows)


def test_nul_is_a_letter_of_its_own(spark):
    rows = [(1, "a\x00b c d e f"), (2, "a\x01b c d e f"), (3, "a\x00b c d e f a\x01b c d e f"), (4, "A\x00b c d e f"), (5, "\x00"), (6, "\x01"), (7, "\x00\x00")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows) and got[3][0] == 6


def test_bytes_of_lower_words_are_told_apart():
    kept = textkernel.LOWER_WORDS[textkernel.LOWER_WORDS > 0]
    assert len(set(kept.tolist())) == len(kept) - 26 and len(kept) == 256 - 6
