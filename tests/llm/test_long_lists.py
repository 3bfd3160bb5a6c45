"""Operator 5 on lists that hold many documents which don't link, and with tables that hold nothing."""

import random

import pytest
from test_corpus_ops import groups

from lexiloom.llm import jaccard


def crowd(seed=9, n=400):
    """Documents that share a long passage and differ in the rest: one list, hardly a link; some are near copies."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    out = []
    for i in range(n):
        own = [f"o{i}x{k}" for k in range(rng.choice([12, 14, 20]))]
        out.append(passage + own)
        if i % 10 == 0:
            out.append(passage + own[:-1] + ["end"])
    rng.shuffle(out)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("limits", [{"hot_count": 16}, {"hot_count": 16, "hot_keys": 1 << 14, "bitmap_bits": 12}])
def test_many_unlinked_documents_in_one_list(spark, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    texts = crowd()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(docs, **limits).collect()}
    want = groups(list(enumerate(texts)))
    assert got == want and len({c for _, c in want.values()}) < len(texts)


def test_frequent_keys_are_a_share_of_all_postings(spark):
    """No quota: what has one in hot_keys of all postings is in the table, in whatever bucket it falls."""
    docs = spark.createDataFrame([(i, f"a b c d e f g own{i} of it {i}") for i in range(200)], "doc_id bigint, text string")
    sets = docs.selectExpr("doc_id", "10L AS n")
    order = jaccard.common_order(docs, sets, bitmap_bits=20, hot_keys=40, hot_count=1)
    assert len(order.hot) == 3  # of 2,000 postings 50 or more
    assert len(jaccard.common_order(docs, sets, bitmap_bits=20, hot_keys=8, hot_count=1).hot) == 0


def test_boundary_is_the_size_of_least_cost():
    sizes = {n: 10 for n in [*range(1, 300), 5000]}
    assert jaccard.choose_boundary({}, 0.5, 10) == 0
    chosen = {(again, length): jaccard.choose_boundary(sizes, again, length) for again in (0.02, 0.1, 0.5) for length in (2, 50, 2000)}
    assert len(set(chosen.values())) > 3 and chosen[0.02, 2000] > chosen[0.1, 2000] > chosen[0.5, 2000]
