"""The corrector against a plain one that compares every word with the whole dictionaries."""

import math
import random

from lexiloom.functions import edits
from lexiloom.operators import correct, dictionary, fuzzy
from test_correct import plain_osa

LETTERS = "abdeinorst"


def made_words(rng, n, least=3):
    return sorted({"".join(rng.choice(LETTERS) for _ in range(rng.randint(least, 8))) for _ in range(n)})


def off(rng, word):
    """The word with one or two edits."""
    for _ in range(rng.choice([1, 1, 2])):
        i = rng.randrange(len(word))
        word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(LETTERS) + word[i:], word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :], word[:i] + rng.choice(LETTERS) + word[i + 1 :]]) or word
    return word


def near(word, freqs, total, k):
    """(word, distance, cost, freq, score, place) of the first candidates of one dictionary."""
    found = []
    for w, f in freqs.items():
        if abs(len(w) - len(word)) <= k and (d := plain_osa(word, w)) <= k:
            cost = float(edits.weighted_osa([word], [w])[0])
            found.append((w, d, cost, f, math.log(f / total) - fuzzy.COST_WEIGHT * cost))
    found.sort(key=lambda c: (c[1] != 0, -c[4], c[0]))
    return [(*c, i) for i, c in enumerate(found[: fuzzy.RESULTS])]


def sure(word, c, second):
    clamp = lambda x: max(0.0, min(1.0, x))
    out = clamp(1 - c[2] / len(word) * 1.5)
    if second is not None:
        out *= 0.45 + 0.55 * clamp((c[4] - second) / 3)
    if len(word) == 3:
        out *= 0.82
    return clamp(out * 0.85 if c[3] < 100 else out)


def best_of(word, cands):
    """(candidate, confidence, score of the candidate in first place) that a ranker by frequency picks, or None."""
    if not cands:
        return None
    ranked = sorted(cands, key=lambda c: (-c[4], c[5]))
    c = ranked[0]
    if c[1] == 0 or len(word) <= 2:
        return None
    return c, sure(word, c, ranked[1][4] if len(ranked) > 1 else None), min(cands, key=lambda c: c[5])[4]


def plain_check(word, first, second, level, s):
    """(to, confidence, auto) for a lower-case word that no table has, or None."""
    totals = [sum(d.values()) for d in (first, second)]
    p, q = first.get(word, 0), second.get(word, 0)
    if p >= s.solid_primary or q >= s.solid_secondary:
        return None
    if not p and not q:
        found = [(b, i) for i, (d, t) in enumerate(zip((first, second), totals, strict=True)) if (b := best_of(word, near(word, d, t, s.max_edit)))]
        if not found:
            return None
        (c, conf, _), _ = min(found, key=lambda x: (-x[0][2], x[1]))
        return (c[0], conf, conf >= correct.AUTO_THRESHOLD[level]) if conf >= correct.FLAG_THRESHOLD[level] else None
    for i, (d, t, own) in enumerate(((first, totals[0], p), (second, totals[1], q))):
        if i and p:
            continue
        b = best_of(word, [c for c in near(word, d, t, 1) if c[1] > 0])
        if b and b[0][3] >= correct.REAL_WORD_RATIO * max(own, 1):
            conf = min(b[1], correct.REAL_WORD_CEILING)
            return (b[0][0], conf, False) if conf >= correct.REAL_WORD_FLAG else None
    return None


def test_every_word_gets_what_a_plain_corrector_says(spark):
    rng = random.Random(12)
    both = [{w: rng.choice([1, 3, 30, 90, 400, 9000]) for w in made_words(rng, 160)} for _ in range(2)]
    tables = [dictionary.with_probability(spark.createDataFrame(list(d.items()), "word string, freq bigint")) for d in both]
    none = spark.createDataFrame([], "wrong string, right string")
    r = correct.Resources(*tables, none, none)
    known = [*both[0], *both[1]]
    texts = [" ".join(rng.choice([off(rng, rng.choice(known)), rng.choice(known)]) for _ in range(40)) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    said = 0
    for level in ("conservative", "aggressive"):
        s = correct.Settings(aggressiveness=level, min_dict_size=1, affixes=False, slang=False)
        got = {(x.doc_id, x.pos): (x.to, round(x.confidence, 9), x.auto) for x in correct.check(docs, r, s).collect()}
        want = {}
        for i, t in enumerate(texts):
            for pos, w in enumerate(t.split()):
                if (c := plain_check(w, *both, level, s)) is not None:
                    want[i, pos] = (c[0], round(c[1], 9), c[2])
        assert got == want
        said += len(got)
    assert said > 300


def test_all_pairs_within_two_edits(spark):
    """The join on variants loses no pair, whatever the words' lengths, but words of one or two letters without a common
    one: nothing is left of these after two deletions, and a variant is never empty."""
    rng = random.Random(13)
    words = made_words(rng, 250, 1) + ["s" * 9, "abdeinorstab", "abdeinorstabd"]
    typed = sorted({off(rng, rng.choice(words)) for _ in range(250)})
    got = fuzzy.matches(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(w,) for w in words], "word string"), 2).collect()
    share = lambda t, w: max(len(t), len(w)) > 2 or set(t) & set(w)
    assert {tuple(x) for x in got} == {(t, w, d) for t in typed for w in set(words) if abs(len(t) - len(w)) <= 2 and (d := plain_osa(t, w)) <= 2 and share(t, w)}
