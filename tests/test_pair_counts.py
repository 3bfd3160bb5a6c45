"""Counts of neighbouring words: packed in buckets by the map side, added up by bucket."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import dictionary
from lexiloom.operators.tokenize import words

ODD = [
    None, "", " ", "'", "’'’", "alone", "'alone'", "Two two", "two", "don't ''quote'' it’s rock'n'roll 'tis dogs' x''y", "a_b a-b a.b a b a​b",
    "İstanbul İzmir i", "ΟΔΟΣ ΣΑΣ ΑΣ' Σ", "Ⓐ ⓑ ½ Ⅷ ²x ٣٤", "हिन्दी में शब्द", "été ete", "漢字。かな、カナ 漢字", "\U0001f600 x \U0001f600y \U00010400\U00010428", "ͅ aͅb", "STRASSE straße ﬀ", "end", "1 2 1 2 1", "\n\nnew\nline\n",
]


def _plain(texts):
    """What the packed way must give, word by word."""
    out = Counter()
    for t in texts:
        found = [w.lower() for w in re.findall(r"[a-zäöß]+(?:'+[a-zäöß]+)*", t or "", re.I)]
        out.update(zip(found, found[1:]))
    return out


def _through(batches):
    packed = pa.concat_batches(list(dictionary._packed_counts(iter(batches))))
    rows = packed.take(pa.array(np.argsort(packed.column(0).to_numpy(), kind="stable")))
    parts = [rows.slice(i, 7) for i in range(0, rows.num_rows, 7)]
    out = [(r["left"], r["right"], r["count"]) for b in dictionary._added_counts(iter(parts)) for r in b.to_pylist()]
    assert len({x[:2] for x in out}) == len(out)  # each pair is put out once
    return Counter({x[:2]: x[2] for x in out})


def test_same_as_pairs_of_words_on_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").unionByName(spark.range(100, 101).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61206220FF20C3632064")).cast("string").alias("text")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    lead = words(docs).select(F.lower("word").alias("left"), F.lower(F.lead("word").over(w)).alias("right")).where("right IS NOT NULL")
    want = {tuple(r) for r in lead.groupBy("left", "right").count().collect()}
    assert {tuple(r) for r in dictionary.pair_counts_of_texts(docs).collect()} == want
    assert ("i̇stanbul", "i̇zmir", 1) in want


def test_no_pair_is_a_row_of_the_shuffle(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i % 997}" for i in range(20_000)),)] * 3, "text string").coalesce(1)
    counts = dictionary.pair_counts_of_texts(docs)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "HashAggregate" not in plan
    got = counts.collect()
    assert len(got) == 997 and sum(r["count"] for r in got) == 3 * 19_999


@pytest.mark.parametrize(("part", "held"), [(1 << 24, 1 << 26), (64, 1 << 26), (64, 1), (1, 1)])
def test_parts_and_cuts_lose_no_pair(monkeypatch, part, held):
    monkeypatch.setattr(dictionary, "PART", part)
    monkeypatch.setattr(dictionary, "HELD", held)
    monkeypatch.setattr(dictionary, "BUCKET_BITS", 3)
    monkeypatch.setattr(dictionary, "ROWS", 5)
    rng = np.random.default_rng(3)
    vocabulary = ["the", "The", "of", "öl", "don't", "Straße", "x", "averylongword" * 9]
    gaps = [" ", ", ", ".\n", " " * 150, "' '", " — ", "。"]
    texts = ["".join(x for _ in range(n) for x in (vocabulary[rng.integers(8)], gaps[rng.integers(7)])) for n in [0, 1, 2, 3, 5, 40, 400, 1, 0, 2, 90]] + [None, "", "ö" * 500 + " a b", " " * 400 + "b"]
    batches = [pa.record_batch([pa.array(texts[i : i + k], pa.string())], ["text"]) for i, k in ((0, 4), (4, 0), (4, 9), (13, 9))]
    assert _through(batches) == _plain(texts)


def test_parts_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr(dictionary, "PART", 100)
    texts = ["a" * n for n in (60, 30, 20, 250, 1, 99, 100, 101, 5)]
    batches = [pa.record_batch([pa.array(texts[i : i + 4])], ["text"]) for i in (0, 4, 8)]
    parts = [[len(t) for t in p.to_pylist()] for p in dictionary._parts(iter(batches))]
    assert parts == [[60, 30], [20], [250], [1, 99], [100], [101], [5]]
