import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import edits, morphology
from lexiloom.operators import correct, dictionary, fuzzy
from lexiloom.operators.tokenize import tokens, tokens_of, with_neighbours, words, zones


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa_against_plain():
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcé", k=rng.randint(0, 7))), "".join(rng.choices("abcé", k=rng.randint(0, 7)))) for _ in range(600)]
    assert edits.osa([a for a, _ in pairs], [b for _, b in pairs]) == [plain_osa(a, b) for a, b in pairs]


@pytest.mark.parametrize("typed, meant, cost", [("makan", "makan", 0), ("mkaan", "makan", 0.5), ("makn", "makan", 0.85), ("makkan", "makan", 0.75), ("makzan", "makan", 1.5), ("mskan", "makan", 0.7), ("mpkan", "makan", 1.0), ("Makan", "makan", 0.1), ("", "ab", 1.7), ("ab", "", 3.0)])
def test_weighted(typed, meant, cost):
    assert edits.weighted_osa([typed], [meant])[0] == pytest.approx(cost)


def test_keys():
    assert edits.key_distance("q", "w") == 1.0
    assert edits.key_distance("q", "é") is None
    assert edits.substitution_cost("a", "A") == 0.10
    assert edits.substitution_cost("q", "p") == 1.0


@pytest.mark.parametrize("word, root", [("menulis", "tulis"), ("memukul", "pukul"), ("menyapu", "sapu"), ("mengarang", "karang"), ("bukunya", "buku"), ("makanan", "makan"), ("anak-anak", "anak"), ("berlari", "lari"), ("pengetahuan", "tahu")])
def test_stems(word, root):
    found = morphology.stems(word)
    assert root in found and found[0] == word and len(found) == len(set(found))


def test_short_roots_are_kept_out():
    assert all(len(s) >= 3 for s in morphology.stems("dia")[1:])


@pytest.mark.parametrize(
    "text, word, reason",
    [
        ("---\na: b\n---\nx", "a", "frontmatter"), ("```\ncode", "code", "code_fence"), ("a `b c` d", "b", "inline_code"), ("see https://a.b/c, ok", "https", "url"), ("www.site.com)", "site", "url"),
        ("me@site.com.", "me", "email"), ("hi @bob", "bob", "mention"), ("(#tag/x)", "tag", "tag"), ("[t](the target)", "target", "link_target"), ("h2o", "h2o", "has_digit"), ("NATO", "NATO", "acronym"),
        ("plain don't", "don't", None), ("a@b", "b", None), ("mid#tag", "tag", None), ("É", "É", None), ("'quoted'", "quoted", None),
    ],
)
def test_zones(text, word, reason):
    found = {text[s:e]: why for s, e, why in tokens_of(text)}
    assert found[word] == reason


def test_unterminated_zones():
    assert zones("---\nno end") == []
    assert zones("a `b") == []
    assert zones("[x](y") == []
    assert zones("```x```") [0] == (0, 7, "code_fence")


def test_token_rows_have_both_offsets(spark):
    df = spark.createDataFrame([(1, "é ab"), (2, None), (3, "")], "doc_id bigint, text string")
    got = [(r.doc_id, r.pos, r.byte_start, r.byte_end, r.char_start, r.char_end, r.word) for r in tokens(df).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, 0, 2, 0, 1, "é"), (1, 1, 3, 5, 2, 4, "ab")]


def test_neighbours_skip_protected(spark):
    df = spark.createDataFrame([(1, "one NASA two")], "doc_id bigint, text string")
    rows = with_neighbours(tokens(df)).orderBy("pos").collect()
    assert [(r.prev_word, r.next_word) for r in rows] == [(None, "two"), ("one", "two"), ("one", None)]


def test_delete_variants(spark):
    def plain(word, depth):
        out, layer = {word[:7]}, {word[:7]}
        for _ in range(depth):
            layer = {s[:i] + s[i + 1 :] for s in layer if len(s) > 1 for i in range(len(s))}
            out |= layer
        return out

    some = ["a", "ab", "hello", "abcdefghij", "aaa"]
    df = spark.createDataFrame([(w,) for w in some], "word string")
    for depth in (1, 2):
        got = {r.word: set(r.v) for r in df.withColumn("v", dictionary.delete_variants(F.col("word"), depth)).collect()}
        assert got == {w: plain(w, depth) for w in some}


def test_fuzzy_join_is_complete(spark):
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choices("abcde", k=rng.randint(3, 8))) for _ in range(150)})
    typed = sorted({"".join(rng.choices("abcde", k=rng.randint(3, 8))) for _ in range(80)})
    d = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    t = spark.createDataFrame([(w,) for w in typed], "typed string")
    for k in (1, 2):
        got = {(r.typed, r.word, r.distance) for r in fuzzy.matches(t, d, k).collect()}
        assert got == {(a, b, n) for a in typed for b in vocabulary if (n := plain_osa(a, b)) <= k}


@pytest.fixture(scope="module")
def resources(spark):
    padding = [("".join(x), 30) for x in ((a, b, c, "qzx") for a in "bcdfg" for b in "jkmpq" for c in "vwxzr")]
    padding = [("".join(map(str, w)), f) for w, f in padding]
    first = dictionary.with_probability(spark.createDataFrame([("makan", 9000), ("malam", 800), ("saya", 9000), ("nasi", 4000), ("tulis", 900), ("makam", 60), ("anak", 900), *padding], "word string, freq bigint"))
    second = dictionary.with_probability(spark.createDataFrame([("the", 90000), ("house", 4000), ("horse", 3000), ("hause", 20), *padding], "word string, freq bigint"))
    pairs = spark.createDataFrame([("saya", "makan", 500), ("makan", "nasi", 900)], "left string, right string, count bigint")
    typos = spark.createDataFrame([("yagn", "yang"), ("teh", "the")], "wrong string, right string")
    slang = spark.createDataFrame([("gk", "tidak")], "wrong string, right string")
    return correct.Resources(first, second, typos, slang, pairs)


def run(spark, resources, text, **settings):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = correct.check(df, resources, correct.Settings(min_dict_size=50, **settings))
    rows = {(r["from"], r.to, r.source, r.auto) for r in found.collect()}
    return rows, correct.apply(df, found, only_auto=True).first().corrected


def test_tables_and_case(spark, resources):
    rows, text = run(spark, resources, "Yagn Gk teh `gk`")
    assert rows == {("Yagn", "Yang", "typo", True), ("Gk", "Tidak", "slang", True), ("teh", "the", "typo", True)}
    assert text == "Yang Tidak the `gk`"
    assert run(spark, resources, "gk", slang=False)[0] == set()


def test_doubling_and_affixes(spark, resources):
    rows, text = run(spark, resources, "anak2 menulis")
    assert rows == {("anak2", "anak-anak", "slang", True)} and text == "anak-anak menulis"


def test_unknown_word(spark, resources):
    rows, _ = run(spark, resources, "the nassi")
    assert ("nassi", "nasi") in {r[:2] for r in rows}


def test_context(spark, resources):
    rows, _ = run(spark, resources, "saya makam nasi")
    assert rows == {("makam", "makan", "context", False)}
    assert run(spark, resources, "saya makan nasi")[0] == set()


def test_weak_word(spark, resources):
    rows, _ = run(spark, resources, "the hause", solid_secondary=1000)
    assert rows == {("hause", "house", "dictionary", False)}


def test_gate(spark, resources):
    df = spark.createDataFrame([(1, "nassi teh")], "doc_id bigint, text string")
    rows = correct.check(df, resources, correct.Settings()).collect()
    assert [(r["from"], r.source) for r in rows] == [("teh", "typo")]


def test_user_words_and_undo(spark, resources):
    mine = spark.createDataFrame([("Teh",)], "word string")
    undo = spark.createDataFrame([("makam", "makan", 2)], "from_word string, to_word string, count bigint")
    r = correct.Resources(resources.primary, resources.secondary, resources.typos, resources.slang, resources.pairs, mine, undo)
    assert run(spark, r, "teh saya makam nasi")[0] == set()


def test_apply(col, spark):
    edit = F.array(*(F.struct(F.lit(a).alias("char_start"), F.lit(b).alias("char_end"), F.lit(t).alias("to")) for a, b, t in ((0, 2, "X"), (1, 3, "Y"), (4, 5, ""), (90, 99, "Z"))))
    assert col(correct.edited(F.col("t"), edit), t="abcdefé") == "Xcdfé"
    one = correct.apply_one(F.col("t"), F.col("a"), F.col("b"), F.col("o"), F.col("n"))
    assert col(one, t="a teh", a=0, b=3, o="teh", n="the") == "a the"
    assert col(one, t="a tea", a=0, b=3, o="teh", n="the") == "a tea"
    assert tuple(col(correct.changed_span(F.col("t"), F.col("a"), F.col("n")), t="a the", a=0, n="the")) == (2, 5)


def test_words_agree_with_tokens(spark):
    df = spark.createDataFrame([(1, "It's élan-vital 'x' 9a -- b_c"), (2, ""), (3, None)], "doc_id bigint, text string")
    a = [(r.doc_id, r.pos, r.word) for r in words(df).orderBy("doc_id", "pos").collect()]
    b = [(r.doc_id, r.pos, r.word) for r in tokens(df).orderBy("doc_id", "pos").collect()]
    assert a == b


def test_readiness():
    assert dictionary.is_ready({"a": 5000}, ("a",))
    assert not dictionary.is_ready({"a": 4999}, ("a",))
    assert not dictionary.is_ready({"a": 9999}, ())


def plain_edits(text, edits):
    out, at = "", 0
    for a, b, to in edits:
        if a >= at and b <= len(text):
            out, at = out + text[at:a] + to, b
    return out + text[at:]


def test_edits_apart_and_overlapping(spark):
    rng, rows = random.Random(8), []
    for i in range(200):
        text = "".join(rng.choice("ab é😀<&") for _ in range(rng.randint(0, 40)))
        edits = sorted((a, a + rng.choice([0, 1, 2, 9]), rng.choice(["", "X", "long"])) for a in (rng.randint(0, 45) for _ in range(rng.randint(0, 6))))
        rows.append((i, text, edits))
    rows += [(900, "no edits", None), (901, None, [(0, 1, "x")])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, e array<struct<char_start:int,char_end:int,to:string>>")
    got = {r.doc_id: r.out for r in docs.select("doc_id", correct.edited(F.col("text"), F.col("e")).alias("out")).collect()}
    assert got == {i: None if t is None else plain_edits(t, e or []) for i, t, e in rows}


def test_thousands_of_edits_in_one_text(spark):
    import time

    n = 20_000
    docs = spark.createDataFrame([(1, "word é " * n)], "doc_id int, text string")
    edits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 7).cast("int").alias("char_start"), (i * 7 + 4).cast("int").alias("char_end"), F.lit("W").alias("to")))
    began = time.time()
    assert docs.select(correct.edited(F.col("text"), edits).alias("x")).first().x == "W é " * n and time.time() - began < 30


def test_corrections_have_utf16_places(spark, resources):
    texts = ["teh 😀 teh é𝒳 teh", "teh", "😀😀teh", "é teh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    typos = spark.createDataFrame([("teh", "the")], "wrong string, right string")
    r = correct.Resources(resources.primary, resources.secondary, typos, resources.slang)
    got = [r for r in correct.check(docs, r).collect() if r["from"] == "teh"]
    assert len(got) == 6
    for x in got:
        units = texts[x.doc_id].encode("utf-16-le")
        assert units[2 * x.utf16_start : 2 * x.utf16_end].decode("utf-16-le") == "teh" and set(correct.CORRECTION) == set(x.asDict()) - {"doc_id"}
