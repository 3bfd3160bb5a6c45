"""Scalar text functions as column expressions: titles, slugs, pages, code, list markers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
PAGE_MARKER = "=============== HALAMAN ==============="
PAGE_CHAR_LIMIT = 3000
TITLE_CHARS = 120
SLUG_CHARS = 60
SLUG_FALLBACK = "catatan"
TITLE_FALLBACK = "Tanpa judul"
FILE_NAME_CHARS = 80
BANNER_WIDTH = 58
_MARKER = r"(?i)^\s*={3,}\s*halaman\s*={3,}\s*$"
STRONG_SIGNALS = (
    r"(?i)</?[a-z][\w-]*(\s[^<>]*)?/?>",
    r"(?i)<!DOCTYPE",
    r"(?i)<\?php",
    r"\b(function|const|let|var|class|def|import|export|public\s+static|#include|using\s+namespace|fn\s+\w+|func\s+\w+|struct|interface|package)\b",
    r"=>|::|:=|->|std::|println!|console\.(log|error|warn)|System\.out",
    r"\b(console|printf|println|System|echo|puts|fmt|print)\s*[.(]",
    r"(?im)^\s*(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE)\b",
    r"(?m)[{};]\s*$",
    r"(?m)^\s*[$#>]?\s*(npm|npx|yarn|pnpm|git|cargo|docker|kubectl|pip|apt|brew|sudo|make|chmod|mkdir|curl|wget)\s+\S",
)
WEAK_SIGNALS = (
    r"===|!==|&&|\|\||\+\+|--|\}\s*else|\)\s*\{",
    r"(?im)^\s*(@[\w.]+|#\w+|//|/\*|\*\s)",
    r"\b(if|for|while|switch|elif|foreach|return)\s*[({]",
    r"(?m)^\s{2,}\S",
    r"[\"'][^\"']*[\"']\s*[:=]",
)
HTML_TAGS = (
    "a abbr article aside audio b blockquote body br button canvas caption code col datalist dd details dialog div dl dt em embed "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label legend li link main map "
    "mark menu meta nav noscript object ol optgroup option output p param picture pre progress q s samp script section select small "
    "source span strong style sub summary sup table tbody td template textarea tfoot th thead time title tr track u ul var video wbr"
).split()
#: In order: the first pattern of which all parts are found gives the language.
LANGUAGES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("php", (r"(?i)<\?php",)),
    ("html", (r"(?i)<!DOCTYPE\s+html",)),
    ("html", (rf"(?i)</?({'|'.join(HTML_TAGS)})(\s[^<>]*)?/?>",)),
    ("css", (r"(?i)(^|\n)\s*(@media|@import|@keyframes|@font-face)\b",)),
    ("css", (r"(^|\n)\s*[.#]?[\w-]+(\s*[,>+~]\s*[.#]?[\w-]+)*\s*\{[^{}]*:[^{}]*(;|\s*\})",)),
    ("javascript", (r"\bimport\s+[\w{},*\s]+\s+from\s+['\"]",)),
    ("javascript", (r"\bexport\s+(default|const|function|class|\{)",)),
    ("javascript", (r"\brequire\s*\(\s*['\"]",)),
    ("python", (r"(?m)^\s*from\s+[\w.]+\s+import\b",)),
    ("python", (r"(?m)^\s*def\s+\w+\s*\(.*\)\s*:",)),
    ("python", (r"(?m)^\s*import\s+[\w.]+(\s+as\s+\w+)?\s*$",)),
    ("python", (r"(?m)^\s*(class\s+\w+.*:|if\s+__name__\s*==)",)),
    ("cpp", (r"#include\s*[<\"]|std::|int\s+main\s*\(|printf\s*\(|cout\s*<<",)),
    ("java", (r"\b(public\s+(static\s+)?(void|class)|System\.out\.print|package\s+[\w.]+;)",)),
    ("rust", (r"\bfn\s+\w+\s*\(|\blet\s+mut\b|println!|\buse\s+std::",)),
    ("go", (r"\bfunc\s+\w+\s*\(|\bpackage\s+main\b",)),
    ("sql", (r"(?im)^\s*(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+(TABLE|DATABASE)|ALTER\s+TABLE|DROP\s+TABLE)\b",)),
    ("bash", (r"(?m)^\s*[$#>]?\s*(npm|npx|yarn|pnpm|git|cd|ls|dir|mkdir|rm|cp|mv|cat|echo|curl|wget|node|python3?|pip|cargo|docker|kubectl|make|sudo|apt|brew|chmod)\b",)),
    ("json", (r"^\s*[\[{]", r"\"[^\"]+\"\s*:")),
    ("javascript", (r"\b(function|const|let|var)\b|=>|console\.(log|error|warn)|document\.|window\.",)),
)
#: Typographic characters and what replaces them in a Latin-1 document.
PDF_REPLACEMENTS = {
    "'": "\u2018\u2019\u201a\u2032", '"': "\u201c\u201d\u201e\u2033", "-": "\u2013\u2014\u2015\u2212\u2022\u2023\u25e6\u00b7", "...": "\u2026", "EUR": "\u20ac", "(TM)": "\u2122",
    "%o": "\u2030", "+": "\u2020\u2021", "~": "\u2248", "!=": "\u2260", "<=": "\u2264", ">=": "\u2265", "->": "\u2192", "<-": "\u2190", " ": "\u00a0\u2007\u202f",
}
#: Words of a humanised age.
AGE_WORDS = {"now": "baru saja", "minute": "menit", "hour": "jam", "yesterday": "kemarin", "day": "hari", "week": "minggu", "month": "bulan", "year": "tahun"}
# ---- end of fixed values ------------------------------------------------------------------

_WORDISH = r"[\w{},*\s]"
#: Forms of two language patterns that match the same texts in one pass: the JVM recurses in a repeated group and
#: goes back over every colon or comma of a long run, so the group is possessive and a run is entered once.
_ONE_PASS = {
    LANGUAGES[4][1][0]: r"(?:^|(?<!\s)[^\S\n]*+\n)\s*+[.#]?[\w-]++(?:\s*+[,>+~]\s*+[.#]?[\w-]++)*+\s*+\{[^{}:]*+:(?:[^{};]*+;|[^{}]*+\})",
    LANGUAGES[5][1][0]: rf"(?<!{_WORDISH})(?>{_WORDISH}*?\bimport\s){_WORDISH}+\s+from\s+['\"]",
}

_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def lines(c: Column) -> Column:
    """Lines of a text: a last newline ends the last line and a carriage return before one goes."""
    return F.transform(F.split(F.regexp_replace(c, r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))


#: Lines that have nothing but number signs and white space, and what stands before the text of the next one.
_BEFORE_TITLE = r"\A(?:{s}*+#*+{s}*+\n)*+{s}*+#*+{s}*+".replace("{s}", r"[ \t\x0b\f\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def derive_title(body: Column, fallback: str | Column = "") -> Column:
    """The first line that has text beside leading number signs, without them, cut at 120 characters. Only the
    text's beginning is looked at."""
    line = F.regexp_extract(body, rf"{_BEFORE_TITLE}([^\n]*)", 1)
    title = F.nullif(F.substring(trimmed(line), 1, TITLE_CHARS), F.lit(""))
    return F.coalesce(title, F.lit(fallback) if isinstance(fallback, str) else fallback)


def parse_time(c: Column) -> Column:
    """RFC 3339 -> Unix seconds; null if it is no such time."""
    t = F.trim(c)
    shape = t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(shape, F.unix_timestamp(F.try_to_timestamp(F.upper(t))))


def format_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_tags(c: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(trimmed(c), r"^\[+", ""), r"\]+$", "")
    bare = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), '^"+|"+$', ""), "^'+|'+$", ""))
    return F.filter(bare, lambda x: x != "")


def parse_bool(c: Column) -> Column:
    return F.lower(trimmed(c)).isin("true", "yes", "1")


def unquote(c: Column) -> Column:
    t = trimmed(c)
    quoted = (F.length(t) >= 2) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")))
    return F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def escape_scalar(c: Column) -> Column:
    """Quoted if a reader could take it for something else; unescape_scalar() undoes it."""
    needs = c.contains(":") | c.contains("#") | c.rlike(r"""^[\[{\-*&!|>'"%@]""") | (trimmed(c) != c)
    return F.when(needs, F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def unescape_scalar(c: Column) -> Column:
    t = trimmed(c)
    bare = unquote(t)
    return F.when(t.startswith('"') & t.endswith('"') & (F.length(t) >= 2), F.regexp_replace(bare, r'\\(["\\])', "$1")).otherwise(bare)


def slug(c: Column, fallback: str = SLUG_FALLBACK) -> Column:
    """Runs of letters and digits of the first 60 characters, joined by hyphens."""
    s = F.regexp_replace(F.lower(F.substring(c, 1, SLUG_CHARS)), r"[^\p{IsAlphabetic}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^-+|-+$", ""), F.lit("")), F.lit(fallback))


def safe_file_name(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(trimmed(title), r'[\\/:*?"<>|]+', " "), rf"{_SPACE}+", " ")
    return F.coalesce(F.nullif(F.substring(trimmed(s), 1, FILE_NAME_CHARS), F.lit("")), F.lit(SLUG_FALLBACK))


def is_page_marker(line: Column) -> Column:
    return line.rlike(_MARKER)


def split_pages(body: Column) -> Column:
    """Pages between marker lines, without newlines at their ends; one page at least. Cut in one pass: a marker
    line goes with the newline before it, and a page begins after the newline that ends it."""
    text = F.array_join(lines(body), "\n")
    marker = r"(?i)(?:\A|\n)[^\S\n]*+={3,}[^\S\n]*+halaman[^\S\n]*+={3,}[^\S\n]*+(?=\n|\z)"
    return F.transform(F.split(text, marker, -1), lambda p: F.regexp_replace(p, r"\A\n+|\n+\z", ""))


def join_pages(pages: Column) -> Column:
    return F.array_join(pages, f"\n{PAGE_MARKER}\n")


def count_pages(body: Column) -> Column:
    return F.size(F.filter(F.split(body, "\n"), is_page_marker)) + 1


def page_at(body: Column, position: Column) -> Column:
    """Number of the page that a character position is on."""
    walked = F.aggregate(
        F.split(body, "\n"),
        F.struct(F.lit(1).alias("n"), F.lit(0).alias("at")),
        lambda a, x: F.struct((a["n"] + F.when((a["at"] < position) & is_page_marker(x), 1).otherwise(0)).alias("n"), (a["at"] + F.length(x) + 1).alias("at")),
    )
    return walked["n"]


def insert_page_break(body: Column, start: Column, end: Column) -> Column:
    """The text between two character positions replaced by a page break."""
    left = F.regexp_replace(F.substring(body, F.lit(1), start), r"\n+\z", "")
    right = F.regexp_replace(F.substring(body, end + 1, F.length(body)), r"\A\n+", "")
    return F.concat(F.when(left == "", left).otherwise(F.concat(left, F.lit("\n\n"))), F.lit(f"{PAGE_MARKER}\n\n"), right)


def page_banner(number: Column) -> Column:
    label = F.concat(F.lit(" Halaman "), number.cast("string"), F.lit(" "))
    rest = F.greatest(F.lit(BANNER_WIDTH) - F.length(label), F.lit(0))
    left = F.floor(rest / 2).cast("int")
    return F.concat(F.repeat(F.lit("="), left), label, F.repeat(F.lit("="), (rest - left).cast("int")))


def body_starts_with_title(title: Column, body: Column) -> Column:
    first = trimmed(F.element_at(lines(body), 1))
    return F.lower(trimmed(F.regexp_replace(first, "^#+", ""))) == F.lower(trimmed(title))


def sanitize_for_pdf(c: Column) -> Column:
    """Typographic characters spelt in Latin-1; whatever Latin-1 lacks goes."""
    singles = {s: t for t, all_ in PDF_REPLACEMENTS.items() for s in all_ if len(t) == 1}
    out = F.translate(c, "".join(singles), "".join(singles.values()))
    for t, all_ in PDF_REPLACEMENTS.items():
        if len(t) > 1:
            out = F.regexp_replace(out, f"[{all_}]", t.replace("$", "\\$"))
    return F.regexp_replace(out, r"[^\n\t\x20-\x7e\u00a1-\u00ff]", "")


def wrap_line(line: Column, width: int) -> Column:
    """Words filled into lines of at most `width` characters; longer words are cut."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / width).cast("int") - 1, F.lit(0))), lambda i: F.substring(s, i * width + 1, F.lit(width)))

    def add(a: Column, word: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.when(last == "", word).otherwise(F.concat_ws(" ", last, word))
        fits = (last == "") | (F.length(last) + 1 + F.length(word) <= width)
        before = F.slice(a, F.lit(1), F.size(a) - 1)
        return F.when(fits, F.concat(before, cut(joined))).otherwise(F.concat(a, cut(word)))

    filled = F.aggregate(F.split(line, " "), F.array(F.lit("")), add)
    done = F.when((F.element_at(filled, -1) == "") & (F.size(filled) > 1), F.slice(filled, F.lit(1), F.size(filled) - 1)).otherwise(filled)
    return F.when(trimmed(line) == "", F.array(F.lit(""))).otherwise(done)


def looks_like_code(c: Column) -> Column:
    """One strong signal, or two weak ones, in a text of three characters or more."""
    t = trimmed(c)
    strong = F.lit(False)
    for p in STRONG_SIGNALS:
        strong = strong | t.rlike(p)
    weak = sum((t.rlike(p).cast("int") for p in WEAK_SIGNALS), F.lit(0))
    return (F.length(t) >= 3) & (strong | (weak >= 2))


def detect_language(c: Column) -> Column:
    """Label of the first language whose pattern is found, or an empty text."""
    t = F.regexp_replace(trimmed(c), r"\n\s{16,}\n", "\n" * 18)  # no pattern tells long gaps of blank lines apart
    out = None
    for name, patterns in LANGUAGES:
        found = F.lit(True)
        for p in patterns:
            found = found & t.rlike(_ONE_PASS.get(p, p))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("")


def inside_fence(text: Column, position: Column) -> Column:
    """Whether an odd number of fence lines begins before a character position."""
    before = F.split(F.substring(text, F.lit(1), position), "\n")
    return F.size(F.filter(before, lambda x: x.rlike(r"^\s*```"))) % 2 == 1


def wrap_in_fence(text: Column, start: Column, end: Column, code: Column, language: Column) -> Column:
    """The selection replaced by code in a fence on lines of its own."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    body = F.regexp_replace(F.regexp_replace(code, r"\r\n", "\n"), r"\s+\z", "")
    nl_before = F.when((before != "") & ~before.endswith("\n"), "\n").otherwise("")
    nl_after = F.when((after != "") & ~after.startswith("\n"), "\n").otherwise("")
    return F.concat(before, nl_before, F.lit("```"), language, F.lit("\n"), body, F.lit("\n```"), nl_after, after)


def paste(text: Column, start: Column, end: Column, pasted: Column) -> Column:
    """Pasted text put in place of the selection, in a fence if it is code outside of one."""
    wrap = looks_like_code(pasted) & ~inside_fence(text, start)
    plain = F.concat(F.substring(text, F.lit(1), start), pasted, F.substring(text, end + 1, F.length(text)))
    return F.when(wrap, wrap_in_fence(text, start, end, pasted, detect_language(pasted))).otherwise(plain)


def relative_time(seconds: Column, now: Column) -> Column:
    diff = F.greatest(now - seconds, F.lit(0))
    minutes = F.floor(diff / 60)
    hours, days = F.floor(minutes / 60), F.floor(F.floor(minutes / 60) / 24)
    say = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {AGE_WORDS[unit]}"))
    return (
        F.when(diff < 45, AGE_WORDS["now"]).when(diff < 90, f"1 {AGE_WORDS['minute']}").when(minutes < 60, say(minutes, "minute")).when(hours < 24, say(hours, "hour"))
        .when(days == 1, AGE_WORDS["yesterday"]).when(days < 7, say(days, "day")).when(days < 30, say(F.floor(days / 7), "week")).when(days < 365, say(F.floor(days / 30), "month"))
        .otherwise(say(F.floor(days / 365), "year"))
    )


def match_case(original: Column, replacement: Column) -> Column:
    """Replacement in the case of the original: all capitals, first capital, or as it is."""
    letters = F.regexp_replace(original, r"[^\p{IsAlphabetic}]", "")
    all_caps = (F.length(letters) > 1) & ~letters.rlike(r"[^\p{Lu}]")
    first_cap = F.substring(original, 1, 1).rlike(r"^\p{Lu}")
    return F.when(all_caps, F.upper(replacement)).when(first_cap, F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))).otherwise(replacement)


def words_and_chars(c: Column) -> Column:
    """Words, and characters as UTF-16 units."""
    t = trimmed(c)
    units = F.length(c) + F.length(F.regexp_replace(c, r"[\x{0}-\x{ffff}]", ""))
    return F.struct(F.when(t == "", 0).otherwise(F.size(F.split(t, rf"{_SPACE}+"))).alias("words"), units.alias("chars"))


def utf16_offset(text: Column, char_offset: Column) -> Column:
    """UTF-16 units before a code point offset."""
    before = F.substring(text, F.lit(1), char_offset)
    return F.length(before) + F.length(F.regexp_replace(before, r"[\x{0}-\x{ffff}]", ""))


def highlight_snippet(snippet: Column) -> Column:
    """Markup of a snippet: escaped, its marks as <mark> elements."""
    out = snippet
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("«", "<mark>"), ("»", "</mark>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# Units of Roman numerals.
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def to_roman(n: Column) -> Column:
    """Small Roman numerals for 1 to 3999, else the number. A digit of each decade names its letters."""
    digit = lambda base, one, five, ten: F.element_at(
        F.array(*map(F.lit, ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))), (F.floor(n / base) % 10 + 1).cast("int")
    )
    roman = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))
    return F.when((n > 0) & (n <= 3999), roman).otherwise(n.cast("string"))


def parse_roman(c: Column) -> Column:
    """Value of a canonical Roman numeral, else null."""
    s = F.lower(c)
    canonical = s.rlike(r"^(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
    worth = F.create_map(*(F.lit(v) for n, x in _ROMAN if len(x) == 1 for v in (x, n)))

    def add(a: Column, letter: Column) -> Column:
        """From the right: a letter before a greater one is taken off."""
        n = F.coalesce(F.element_at(worth, letter), F.lit(0))
        return F.struct((a["n"] + F.when(n < a["last"], -n).otherwise(n)).alias("n"), n.alias("last"))

    value = F.aggregate(F.reverse(F.split(s, "")), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), add)["n"]
    return F.when(canonical, value)


def marker_kind(marker: Column, previous: Column) -> Column:
    """numeric, alpha or roman; the marker before decides where a letter could be both."""
    low, before = F.lower(marker), F.lower(previous)
    one = lambda c: c.rlike("^[a-z]$")
    roman, roman_before = parse_roman(low), parse_roman(before)
    follows = one(before) & one(low) & (F.ascii(low) == F.ascii(before) + 1)
    return (
        F.when(marker.rlike(r"^\d+$"), "numeric").when(F.coalesce(follows, F.lit(False)), "alpha").when(F.coalesce(roman == roman_before + 1, F.lit(False)), "roman")
        .when(roman.isNotNull() & ((F.length(marker) > 1) | (low == "i")), "roman").when(one(low), "alpha").when(roman.isNotNull(), "roman").otherwise("alpha")
    )


def next_marker(marker: Column, previous: Column) -> Column:
    kind, low = marker_kind(marker, previous), F.lower(marker)
    upper = (marker == F.upper(marker)) & (marker != low)
    roman = to_roman(F.coalesce(parse_roman(low), F.lit(0)) + 1)
    letter = F.when(F.ascii(low) >= 122, "z").otherwise(F.char(F.ascii(low) + 1))
    said = F.when(kind == "roman", roman).otherwise(letter)
    return F.when(kind == "numeric", (marker.try_cast("long") + 1).cast("string")).when(upper, F.upper(said)).otherwise(said)


#: Where an ordered list line begins: indentation, marker, its sign, content; and a bulleted one.
_ORDERED = rf"\A({_SPACE}*)([0-9]+|[A-Za-z]+)([.)])[ \t]+([^\r\n]*)"
_BULLET = rf"\A({_SPACE}*)([-*+])[ \t]+([^\r\n]*)\z"
INDENT = "  "


def _line_before(text: Column, position: Column) -> Column:
    """What stands between the beginning of the position's line and the position."""
    return F.regexp_extract(F.substring(text, F.lit(1), position), r"[^\n]*\z", 0)


def previous_marker(text: Column, line_start: Column, indent: Column, sign: Column) -> Column:
    """The marker of an ordered list line just before a line, of the same indentation and sign, else null."""
    line = _line_before(text, line_start - 1)
    part = lambda k: F.regexp_extract(line, _ORDERED, k)
    return F.when((line_start > 0) & line.rlike(_ORDERED) & (part(1) == indent) & (part(3) == sign), part(2))


def continue_list(text: Column, position: Column) -> Column:
    """struct(text, caret) after a line break at a position in a list line: the next line gets the bullet or the next
    marker; a line without content loses its marker instead. Null outside of a list."""
    line = _line_before(text, position)
    start = position - F.length(line)
    bullet, number = line.rlike(_BULLET), line.rlike(_ORDERED + r"\z")
    part = lambda k: F.regexp_extract(line, _ORDERED, k)
    content = F.when(bullet, F.regexp_extract(line, _BULLET, 3)).otherwise(part(4))
    following = next_marker(part(2), F.coalesce(previous_marker(text, start, part(1), part(3)), F.lit("")))
    added = F.when(bullet, F.concat(F.lit("\n"), F.regexp_extract(line, _BULLET, 1), F.regexp_extract(line, _BULLET, 2), F.lit(" "))).otherwise(F.concat(F.lit("\n"), part(1), following, part(3), F.lit(" ")))
    after = F.substring(text, position + 1, F.length(text))
    ends = F.struct(F.concat(F.substring(text, F.lit(1), start), after).alias("text"), start.cast("int").alias("caret"))
    goes_on = F.struct(F.concat(F.substring(text, F.lit(1), position), added, after).alias("text"), (position + F.length(added)).cast("int").alias("caret"))
    return F.when(bullet | number, F.when(trimmed(content) == "", ends).otherwise(goes_on))


def _block_start(text: Column, start: Column) -> Column:
    """Where the selection's first line begins; an empty first line before position 0 is left out."""
    return F.when((start == 0) & text.startswith("\n"), 1).otherwise(start - F.length(_line_before(text, start)))


def _selected(text: Column, start: Column, end: Column) -> tuple[Column, Column, Column, Column]:
    at = _block_start(text, start)
    return at, F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.greatest(end - at, F.lit(0))), F.substring(text, F.greatest(end, at) + 1, F.length(text))


def indented(text: Column, start: Column, end: Column) -> Column:
    """struct(text, start, end): one step before every line of the selection, or at the caret if nothing is selected."""
    at, before, block, after = _selected(text, start, end)
    n = F.size(F.split(block, "\n"))
    lines_ = F.concat(before, F.lit(INDENT), F.replace(block, F.lit("\n"), F.lit(f"\n{INDENT}")), after)
    caret = F.concat(F.substring(text, F.lit(1), start), F.lit(INDENT), F.substring(text, start + 1, F.length(text)))
    return F.struct(F.when(start == end, caret).otherwise(lines_).alias("text"), (start + len(INDENT)).cast("int").alias("start"), F.when(start == end, end + len(INDENT)).otherwise(end + len(INDENT) * n).cast("int").alias("end"))


def outdented(text: Column, start: Column, end: Column) -> Column:
    """struct(text, start, end): up to two spaces or one tab taken from every line of the selection."""
    at, before, block, after = _selected(text, start, end)
    step = r"(?:\A|(?<=\n))(?: {1,2}|\t)"
    left = F.regexp_replace(block, step, "")
    first = F.length(F.regexp_extract(block, r"\A(?: {1,2}|\t)?", 0))
    return F.struct(F.concat(before, left, after).alias("text"), F.greatest(at, start - first).cast("int").alias("start"), (end - (F.length(block) - F.length(left))).cast("int").alias("end"))


def utf16_of_byte(text: Column, byte_offset: Column) -> Column:
    """UTF-16 units before a UTF-8 byte offset; null inside a character."""
    before = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_offset).cast("string")
    return F.when(F.is_valid_utf8(before), F.length(before) + F.length(F.regexp_replace(before, r"[\x{0}-\x{ffff}]", "")))
