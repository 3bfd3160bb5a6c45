import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.sources import notes as note_files

C = F.col


@pytest.mark.parametrize(
    "body, title",
    [("\n\n# Plans\nmore", "Plans"), ("##\n  second ", "second"), ("", "none"), ("x" * 200, "x" * 120), ("###   \n#a", "a")],
)
def test_derive_title(col, body, title):
    assert col(T.derive_title(C("b"), "none"), b=body) == title


@pytest.mark.parametrize("title, slug", [("Hello, World!", "hello-world"), ("Élan vital", "élan-vital"), ("!!", "catatan"), ("a" * 80, "a" * 60), ("  a -- b  ", "a-b")])
def test_slug(col, title, slug):
    assert col(T.slug(C("t")), t=title) == slug


def test_times(col):
    assert col(T.parse_time(C("t")), t="2024-05-01T10:00:00+07:00") == 1714532400
    assert col(T.parse_time(C("t")), t="2024-05-01T03:00:00Z") == 1714532400
    assert col(T.parse_time(C("t")), t="yesterday") is None
    assert col(T.format_time(C("t")), t=1714532400) == "2024-05-01T03:00:00Z"


def test_tags_and_scalars(col):
    assert col(T.parse_tags(C("t")), t='[work, "big idea", \'x\', ]') == ["work", "big idea", "x"]
    for s in ("plain", 'with: colon "q" \\ end', "#tag", " space", "- list"):
        assert col(T.unescape_scalar(T.escape_scalar(C("s"))), s=s) == s
    assert col(T.parse_bool(C("b")), b=" Yes ") is True
    assert col(T.parse_bool(C("b")), b="no") is False
    assert col(T.unquote(C("s")), s="'a'") == "a"


def test_pages(col):
    body = f"one\n{T.PAGE_MARKER}\n\ntwo\n=== halaman ===\n"
    assert col(T.split_pages(C("b")), b=body) == ["one", "two", ""]
    assert col(T.count_pages(C("b")), b=body) == 3
    assert col(T.split_pages(C("b")), b="") == [""]
    assert col(T.page_at(C("b"), C("p")), b=body, p=0) == 1
    assert col(T.page_at(C("b"), C("p")), b=body, p=len(body)) == 3
    assert col(T.join_pages(C("p")), p=["a", "b"]) == f"a\n{T.PAGE_MARKER}\nb"
    assert col(T.insert_page_break(C("b"), C("s"), C("s")), b="ab\n\ncd", s=3) == f"ab\n\n{T.PAGE_MARKER}\n\ncd"
    banner = col(T.page_banner(C("n")), n=2)
    assert " Halaman 2 " in banner and len(banner) == 58


@pytest.mark.parametrize("line, yes", [("=== HALAMAN ===", True), ("  =====halaman=====  ", True), ("== halaman ==", False), ("=== page ===", False)])
def test_page_marker(col, line, yes):
    assert col(T.is_page_marker(C("x")), x=line) is yes


def test_pdf_text(col):
    assert col(T.sanitize_for_pdf(C("s")), s="“Hi”—it’s 5€… \U0001f600é→") == '"Hi"-it\'s 5EUR... é->'


@pytest.mark.parametrize("line, width, want", [("", 5, [""]), ("aa bb cc", 5, ["aa bb", "cc"]), ("abcdefgh ij", 3, ["abc", "def", "gh", "ij"]), ("a  b", 9, ["a  b"])])
def test_wrap_line(col, line, width, want):
    assert col(T.wrap_line(C("s"), width), s=line) == want


@pytest.mark.parametrize(
    "code, language",
    [
        ("<?php echo 1;", "php"), ("<div class='a'>x</div>", "html"), ("body { color: red; }", "css"), ("import x from 'y'", "javascript"), ("def f(x):\n  return x", "python"),
        ("#include <stdio.h>", "cpp"), ("public static void main", "java"), ("fn main() {}", "rust"), ("func main() {", "go"), ("SELECT a FROM b", "sql"), ("$ git status", "bash"), ('{"a": 1}', "json"), ("hello there", ""),
    ],
)
def test_language(col, code, language):
    assert col(T.detect_language(C("c")), c=code) == language


@pytest.mark.parametrize("code, yes", [("<b>x</b>", True), ("x", False), ("const a = 1", True), ("plain words here", False), ("a && b\n  c", True), ("a++ only", False), ("npm install x", True)])
def test_looks_like_code(col, code, yes):
    assert col(T.looks_like_code(C("c")), c=code) is yes


def test_fences(col):
    assert col(T.inside_fence(C("t"), C("p")), t="```\ncode", p=8) is True
    assert col(T.inside_fence(C("t"), C("p")), t="```\ncode\n```\n", p=13) is False
    assert col(T.wrap_in_fence(C("t"), C("s"), C("s"), C("c"), C("l")), t="ab", s=1, c="x\r\n y \n", l="py") == "a\n```py\nx\n y\n```\nb"
    assert col(T.paste(C("t"), C("s"), C("s"), C("c")), t="", s=0, c="const a = 1;").startswith("```javascript\n")
    assert col(T.paste(C("t"), C("s"), C("s"), C("c")), t="xy", s=1, c=" hi ") == "x hi y"


@pytest.mark.parametrize("age, said", [(0, "baru saja"), (60, "1 menit"), (200, "3 menit"), (7300, "2 jam"), (90000, "kemarin"), (3 * 86400, "3 hari"), (15 * 86400, "2 minggu"), (70 * 86400, "2 bulan"), (800 * 86400, "2 tahun"), (-5, "baru saja")])
def test_age(col, age, said):
    assert col(T.relative_time(F.lit(10**9) - C("a"), F.lit(10**9)), a=age) == said


def test_roman_round_trip(spark):
    rows = spark.range(1, 4000).withColumn("r", T.to_roman(C("id"))).withColumn("v", T.parse_roman(C("r"))).collect()
    assert all(r.v == r.id for r in rows)
    assert {r.id: r.r for r in rows}[1994] == "mcmxciv"


@pytest.mark.parametrize("bad", ["iiii", "vx", "abc", ""])
def test_not_roman(col, bad):
    assert col(T.parse_roman(C("r")), r=bad) is None


@pytest.mark.parametrize("marker, before, kind, after", [("9", None, "numeric", "10"), ("i", None, "roman", "ii"), ("i", "h", "alpha", "j"), ("iv", "iii", "roman", "v"), ("B", "A", "alpha", "C"), ("c", None, "alpha", "d"), ("z", "y", "alpha", "z"), ("X", "IX", "roman", "XI")])
def test_markers(col, marker, before, kind, after):
    assert col(T.marker_kind(C("m"), C("p")), m=marker, p=before) == kind
    assert col(T.next_marker(C("m"), C("p")), m=marker, p=before) == after


@pytest.mark.parametrize("original, new, want", [("TEH", "the", "THE"), ("Teh", "the", "The"), ("teh", "the", "the"), ("T", "the", "The"), ("teh", "iPhone", "iPhone")])
def test_match_case(col, original, new, want):
    assert col(T.match_case(C("o"), C("n")), o=original, n=new) == want


def test_counts_and_names(col):
    got = col(T.words_and_chars(C("t")), t=" a b\U0001f600 ")
    assert (got.words, got.chars) == (2, 7)
    assert col(T.safe_file_name(C("t")), t=' a/b:*"c" ') == "a b c"
    assert col(T.safe_file_name(C("t")), t="///") == "catatan"
    assert col(T.highlight_snippet(C("t")), t="a<«b»") == "a&lt;<mark>b</mark>"
    assert col(T.body_starts_with_title(C("t"), C("b")), t="Plan", b="# plan\nx") is True
    assert col(T.utf16_offset(C("t"), C("p")), t="\U0001f600a", p=1) == 2


@pytest.mark.parametrize("text, language", [("a," * 500_000, ""), ("a{" + "x:" * 500_000, ""), ("a{b:c;" * 100_000, "css"), ("import " * 150_000, ""), ("\n" * 500_000 + ".a, .b > .c {\n color: red }", "css"), ("import {a,\n b} from 'c'", "javascript")])
def test_language_of_long_texts(col, text, language):
    assert col(T.detect_language(F.col("t")), t=text) == language


def test_long_front_matter(col):
    header = "".join(f"key{i}: value\n" for i in range(20_000))
    made = col(note_files.split_front_matter(F.col("t")), t=f"---\n{header}---\n\nbody\n---\n")
    assert tuple(made) == (header, "body\n---\n")
    assert tuple(col(note_files.split_front_matter(F.col("t")), t=f"---\n{header}")) == ("", f"---\n{header}")
