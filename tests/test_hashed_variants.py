"""The fuzzy join on hashed variants, held by the plain distance of all pairs."""

import random

import pytest
from test_correct import plain_osa

from lexiloom.functions import edits
from lexiloom.operators import fuzzy
from lexiloom.operators.dictionary import delete_variants


@pytest.mark.parametrize("k", [1, 2, 3])
def test_every_pair_is_found(spark, k):
    rng = random.Random(k)
    word = lambda a, n: "".join(rng.choices(a, k=n))
    words = {word("abé", rng.randint(1, 6)) for _ in range(60)} | {word("ab", rng.randint(9, 15)) for _ in range(30)}
    typed = {word("abé", rng.randint(1, 6)) for _ in range(60)} | {w[:i] + x + w[i + n :] for w in words for x in ("", "b", "日") for n in (0, 1) for i in (0, len(w) // 2, len(w) - 1)} - {""}
    got = {tuple(r) for r in fuzzy.matches(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(w,) for w in words], "word string"), k).select("typed", "word", "distance").collect()}
    v = spark.createDataFrame([(x,) for x in typed | words], "x string")
    share = {r.x: set(r.v) for r in v.select("x", delete_variants(v.x, k, 99).alias("v")).collect()}
    assert got == {(t, w, d) for t in typed for w in words if share[t] & share[w] and (d := plain_osa(t, w)) <= k}


def test_few_pairs_that_are_not_near_meet(spark, monkeypatch):
    """Words with equal beginnings shared variants of seven letters."""
    typed = spark.createDataFrame([(f"parallel{i:04d}",) for i in range(0, 3000, 10)], "typed string")
    words = spark.createDataFrame([(f"parallel{i:04d}",) for i in range(3000)], "word string")
    seen = []
    monkeypatch.setattr(fuzzy, "within", lambda joined, *_: seen.append(joined.select("typed", "word").distinct().count()) or joined.withColumn("distance", joined.hash))
    fuzzy.matches(typed, words, 2)
    assert seen[0] < 300 * 3000 / 3  # all of them before


def test_pairs_are_aligned_some_at_a_time(monkeypatch):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("abéß1Q", k=rng.randint(0, 9))), "".join(rng.choices("abéß1Q", k=rng.randint(0, 9)))) for _ in range(200)]
    whole = [edits._align(*map(list, zip(*pairs, strict=True)), w).tolist() for w in (False, True)]
    monkeypatch.setattr(edits, "CELLS", 40)
    assert whole == [edits._align(*map(list, zip(*pairs, strict=True)), w).tolist() for w in (False, True)]
    assert whole[0] == [plain_osa(a, b) for a, b in pairs]


def test_variants_of_a_dictionary_are_not_broadcast(spark):
    """Their size is taken for that of the words, so a large table of them went to the driver."""
    words = spark.createDataFrame([(f"word{i}",) for i in range(50)], "word string")
    plan = fuzzy.matches(words.withColumnRenamed("word", "typed"), words, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
