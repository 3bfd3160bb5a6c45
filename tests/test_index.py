"""The stored search index, exact percentiles, file names, ids and hashes against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import ranks, search, store
from lexiloom.sources import export


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(7)
    words = ["Red", "réd", "house", "houses", "well-known", "it's", "known", "wells", "x1", "日本"]
    rows = [(f"n{i}", " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randint(0, 40))), i, i % 4 == 0, None if i % 5 else 9) for i in range(120)]
    return spark.createDataFrame([*rows, ("none", None, None, 1, False, None)], "id string, title string, body string, updated_at bigint, pinned boolean, trashed_at bigint")


@pytest.mark.parametrize("query, variants", [("red hou", ()), ("well-kn", ()), ("it's well-known x", ("house",)), ("réd", ("zzz",)), ("!!", ()), ("nothing", ())])
def test_postings_find_what_a_scan_finds(notes, query, variants):
    index = search.build(notes)
    for limit in (None, 5):
        said = lambda df: sorted((r.id, r.snippet, round(r.score, 9)) for r in df.collect())
        assert said(search.search_index(index, query, variants, limit)) == said(search.search(search.indexed(notes), query, variants, limit))


def test_postings_are_read_by_term(notes):
    plan = search.search_index(search.build(notes), "hou", limit=None)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,hou)" in plan


@pytest.mark.parametrize("n", [0, 1, 2, 99, 100, 1000])
def test_percentiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
    got = ranks.percentiles(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", (0.5, 0.99, 1.0))
    plain = lambda p: sorted(values)[max(-(-n * round(p * 100) // 100), 1) - 1] if n else None
    assert got == [plain(p) for p in (0.5, 0.99, 1.0)]


def test_every_note_gets_a_file(spark):
    rows = [(str(i), t, f"body {i}") for i, t in enumerate(["Same", "same", "Same", "Other", "", "a/b", "a b"])]
    made = export.exported(spark.createDataFrame(rows, "id string, title string, body string"), "txt").collect()
    assert sorted(r.path for r in made) == ["Other.txt", "Same-0.txt", "Same-2.txt", "a b-5.txt", "a b-6.txt", "catatan.txt", "same-1.txt"]


def test_wrapping_in_the_writer_equals_the_column_function(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice(["a", "bcd", " ", "  ", "x" * 30, "\u00a0"]) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, s string")
    got = {r.i: r.w for r in df.select("i", T.wrap_line(F.col("s"), 20).alias("w")).collect()}
    assert [got[i] for i in range(len(lines))] == [export.wrapped(x, 20) for x in lines]


def test_hashes_of_many_texts():
    rng = random.Random(5)
    texts = ["", "é", *("".join(rng.choices("abcé日", k=rng.randint(0, 90))) for _ in range(300)), "z" * 5000]
    assert store.fnv1a_all(texts) == [store.fnv1a(t) for t in texts] and store.fnv1a("a") == "af63dc4c8601ec8c" and store.fnv1a_all([]) == []


def test_sortable_ids(spark):
    df = spark.createDataFrame([(0, "0" * 20), (1_469_918_176_385, "f" * 20), (2**48 - 1, "0123456789abcdef0123")], "ms bigint, hex string")
    got = [r.x for r in df.select(store.sortable_id(F.col("ms"), F.col("hex")).alias("x")).collect()]
    assert got[0] == "0" * 26 and got[1] == "01ARYZ6S41" + "Z" * 16 and got[2].startswith("7" + "Z" * 9) and len(got[2]) == 26


def test_list_lines(col):
    go = lambda t, p=None: tuple(col(T.continue_list(F.col("t"), F.lit(len(t) if p is None else p)), t=t) or ())
    assert go("- one") == ("- one\n- ", 8) and go("a\n  2) x") == ("a\n  2) x\n  3) ", 14) and go("- ") == ("", 0) and go("plain") == ()
    assert go("h. x\ni. y") == ("h. x\ni. y\nj. ", 13) and go("i. y") == ("i. y\nii. ", 9) and go("* a b", 3) == ("* a\n*  b", 6)
    assert col(T.previous_marker(F.col("t"), F.lit(5), F.lit(""), F.lit(".")), t="a. x\nb. y") == "a"
    assert tuple(col(T.indented(F.col("t"), F.lit(3), F.lit(5)), t="ab\ncd\ne")) == ("ab\n  cd\ne", 5, 7)
    assert tuple(col(T.indented(F.col("t"), F.lit(1), F.lit(1)), t="ab")) == ("a  b", 3, 3)
    assert tuple(col(T.outdented(F.col("t"), F.lit(1), F.lit(10)), t="   a\n\tb\n c")) == (" a\nb\nc", 0, 6)


def test_byte_offsets(col):
    t = "aé😀b"
    assert [col(T.utf16_of_byte(F.col("t"), F.lit(k)), t=t) for k in range(9)] == [0, 1, None, 2, None, None, None, 4, 5]


def plain_snippet(body, hits, sizes, n=search.SNIPPET_TOKENS):
    """The window with most different phrases, found by trying every one; hits: (at, phrase)."""
    import regex

    terms = [m.span() for m in regex.finditer(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*", body)]
    inside = lambda s: {p for a, p in hits if s <= a and a + sizes[p] <= s + n}
    most = max((len(inside(s)) for s in range(len(terms))), default=0)
    start = next((s for s in sorted({a for a, _ in hits}) if len(inside(s)) == most), 0)
    start = max(min(start, len(terms) - n), 0)
    near = [(a, a + sizes[p]) for a, p in hits if start <= a and a + sizes[p] <= start + n]
    out = ""
    for k in range(start, min(start + n, len(terms))):
        covered, joined, goes_on = (any(test(a, b) for a, b in near) for test in (lambda a, b: a <= k < b, lambda a, b: a < k < b, lambda a, b: a < k + 1 < b))  # noqa: B023
        out += (body[terms[k - 1][1] : terms[k][0]] if k > start else "") + ("«" if covered and not joined else "") + body[terms[k][0] : terms[k][1]] + ("»" if covered and not goes_on else "")
    return ("…" if start else "") + out + ("…" if start + n < len(terms) else "")


def test_snippets_equal_trying_every_window(spark):
    rng = random.Random(9)
    words = ["red", "Réd", "house", "wells", "x", "y", "known,", "well-known", "(it's)", "éte", "日本", "\n", "--"]
    bodies = ["", None, "red", "x " * 40 + "red house", *(" ".join(rng.choices(words, k=rng.randint(0, 70))) for _ in range(150))]
    phrases = [search.Phrase(("red",), False), search.Phrase(("well", "known"), False), search.Phrase(("hou",), True), search.Phrase(("it", "s", "red"), False)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    listed = search.hit_list(search.terms(F.coalesce("body", F.lit(""))), phrases)
    got = rows.select("n", "body", listed.alias("hits"), search.snippet(F.col("body"), listed, phrases).alias("snippet")).collect()
    assert sum(len(r.hits) for r in got) > 100
    for r in got:
        assert r.snippet == plain_snippet(r.body or "", [tuple(h) for h in r.hits], [len(p.parts) for p in phrases]), r


@pytest.mark.parametrize("query, variants", [("red hou", ()), ("well-kn", ()), ("it's well-known x", ("ho",)), ("réd", ("hous",)), ("house", ())])
def test_prefix_rows_find_what_terms_find(notes, query, variants):
    index = search.build(notes, with_prefixes=True)
    plain = search.Index(index.documents, index.postings, index.bodies, index.totals)
    said = lambda x: sorted((r.id, r.snippet, round(r.score, 9)) for r in search.search_index(x, query, variants, None).collect())
    assert said(index) == said(plain)
    if query == "red hou":
        rows = index.prefixes.where("prefix = 'hou'")
        assert rows.count() == index.postings.where("startswith(term, 'hou')").select("id", "column").distinct().count() < index.postings.where("startswith(term, 'hou')").count()
        explained = search.phrase_hits(index, [search.Phrase(("hou",), True)])._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(prefix,hou)" in explained and "StringStartsWith" not in explained
