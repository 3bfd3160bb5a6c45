"""Fingerprints of texts of very regular make-up, and what is confirmed by bytes."""

import numpy as np
import pytest

from lexiloom.llm import jaccard, quality
from lexiloom.llm import textkernel as K


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


WORD, OTHER = thue_morse(1024), thue_morse(1024, "b", "a")


def docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def test_regular_words_differ(spark):
    got = {r.doc_id: r for r in quality.query(docs(spark, [f"{WORD}\n{OTHER}\n{WORD}", f"{WORD}\n{OTHER}"])).collect()}
    assert (got[0].n_dup_lines, got[1].n_dup_lines) == (1, 0)
    assert {r.doc_id: r.component_id for r in jaccard.join_components(docs(spark, [WORD, OTHER, WORD])).collect()} == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("shape", ["lines", "words"])
def test_equal_fingerprints_are_told_by_bytes(monkeypatch, shape):
    """With a fingerprint of the first byte alone nearly everything collides; the measures stay right."""
    real = K.span_hash
    text = "ax b c d e f g h\nay\nax b c d e f g h\nay\n" if shape == "lines" else "aa b c d e f g h ab b c d e f g h aa b c d e f g h"
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = np.array([0, len(data)])
    right = {k: v.tolist() for k, v in quality._measure(data, bounds).items()}
    monkeypatch.setattr(K, "span_hash", lambda sums, s, e: K.mix(data[s].astype(np.uint64)))
    assert {k: v.tolist() for k, v in quality._measure(data, bounds).items()} == right
    monkeypatch.setattr(K, "span_hash", real)


def test_columns_named_like_the_ledgers_own(spark):
    row = (1, " ".join(f"w{i}" for i in range(30)), "mine", "zero", 7)
    rows = spark.createDataFrame([row], "doc_id bigint, text string, _text string, _0 string, n_words bigint")
    kept = quality.kept_rows(rows, quality.BASE)
    assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == [row]
