"""Main text of web pages by differencing nearest-URL neighbours.

Pages are read into text lines, one for each block, with the zone each line stands in. Within a
host, pages are ordered by URL path and each is paired with the pages 1, 2 and 4 places before and
after it. The lines of a pair are aligned by their longest common subsequence, and what both share is
deleted: menus, notices and footers that the site repeats. Zones that markup names as not of the
article (nav, aside, form, class="ad", comments ...) are deleted even where no neighbour repeats them.

Two things keep shared lines. Inside an explicit <article> a line goes only if nearly all neighbours share it, IN_MOST of
them and at least MOST: articles quote one another, and a quotation stands in few pages, a site's own line in all. And a neighbour may be
a copy of the page: a pair that shares COPY of both is alike,
and an alike neighbour deletes only where it shares less than half of what unlike neighbours leave, so that a
site whose pages are mostly menu is told from copies. Where all neighbours are alike, three or more of them
delete what two of them share if enough is left.

Markup is believed as far as it goes: elements and roles always, classes and ids on boxes. Names that only say where a box
stands (side, bottom, banner ...), and forms, which some sites put around the whole page, count only if the box holds less text than what is outside of it.

Pages travel once, as compressed lines, to the task of their run of the order of (host, path, page): the
order's boundaries come from the keys alone, and the few pages before and after a run go to it
as well. So each page is parsed once, no fingerprint stands in for a line, and a host of any size is dealt over all tasks.

Defined results: a null or empty html gives an empty text; a null url is a page of its own host;
repeated rows each get a row; html without an end to a comment, tag or script is read to its end
as if it ended there; a null page_id comes first in its path; an empty table gives an empty result. Only
page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.sharding import ranked
from lexiloom.session import ship

#: Two pages of which each has this share of its open characters in common with the other are alike.
COPY = 0.8
#: What must be left of a page all of whose neighbours are alike.
OWN_CHARS, OWN_SHARE = 200, 0.05
#: A line inside an article is the site's own if so many of the neighbours that aren't copies share it.
IN_MOST, MOST = 5 / 6, 4
#: Places before and after a page at which its neighbours stand.
NEAR = (1, 2, 4)
#: Runs of the order are at least this long.
RUN = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg|math|select|object)\b[^>]*+(?<!/)>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_MAIN = frozenset("nav aside footer menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar side aside rail ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies notice notices consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social follow related recommended recommendations widget comment comments "
    "respond reply replies disqus discussion search toolbar pagination pager copyright legal form".split()
)
#: Names that say where a box stands rather than what it is; they count on plain boxes, and not on one that holds the text.
_PLACES = frozenset("header banner bottom side aside rail notice notices alert share sharing social follow search discussion form".split())
_BOXES = frozenset("div section span td center".split())
#: Elements of running text, on which names other than those of adverts are an author's.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt".split())
#: Names that also stand on an article's own paragraphs: they say nothing inside of it.
_OWN_NAMES = frozenset("header legal search discussion bottom side notice notices alert copyright follow form".split())
#: What a name may have beside it in one class: "site-footer", "share-buttons"; not "no-sidebar" or "layout-sidebar".
_BESIDE = frozenset("site page global main primary secondary top left right box bar block area list item items link links button buttons wrap wrapper container inner section unit slot".split())
_ARTICLE_NAMES = frozenset("comment comments reply ad ads advert sponsored related promo".split())
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th"}


def _named(classes: set[tuple[str, ...]], names: frozenset[str]) -> bool:
    """Whether a class is, as a whole, one of the names or made of them and words that may stand beside them."""
    return any(not names.isdisjoint(c) and all(w in names or w in _BESIDE for w in c) for c in classes)


def _names(attributes: str) -> tuple[set[tuple[str, ...]], bool]:
    """The classes and the id, each as its words, and whether the element isn't shown or has another role."""
    words: set[tuple[str, ...]] = set()
    off = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words.update(tuple(re.findall("[a-z]+", x)) for x in value.split())
        elif name == "role":
            off |= value in _ROLES
        elif name == "style":
            off |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
        elif name == "hidden":
            off = True
        elif name == "aria-hidden":
            off |= value == "true"
    return words, off


def lines_of(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block with text. Zones: x is not of the article, a inside an
    explicit article, m inside <main> alone, b anywhere else. An article or main below elements that only
    their class or id names as not of the article, or below a form, is the text of a page that has less of it elsewhere."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = [("", "b")]  # open blocks and their zones
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1][1], text))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "head":  # its elements have no text of their own; it ends where others begin
            if not closing:
                held.clear()
            continue
        if tag not in _BLOCKS:
            if tag == "button" and (all(t != tag for t, _ in stack) if closing else stack[-1][1] in "acm" and "".join(held).strip()):
                continue  # a word of a sentence
            if tag in _NOT_MAIN or (attributes and not closing and tag not in _VOID and _drops(tag, attributes, stack[-1][1])):
                pass  # an inline element that drops its text is handled as a block
            else:
                if tag == "br":
                    held.append(" ")
                if stack[-1][0] == tag:  # inside an inline element that drops its text
                    flush()
                    if closing:
                        stack.pop()
                    else:
                        stack.append((tag, stack[-1][1]))
                continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p":
            stack.pop()
        for other in _CLOSES.get(tag, "").split():
            if stack[-1][0] == other:
                stack.pop()
        if tag in _VOID:
            continue
        zone = stack[-1][1]
        if zone != "x":
            drops = _drops(tag, attributes, zone)
            if drops:
                zone = "x" if drops == "x" or zone in "AMc" else "s" if zone == "s" else drops
            elif tag == "article":
                zone = "A" if zone in "swfAM" else "c" if zone in "mc" else "a"  # c: below <main>
            elif tag == "main" and zone in "bswf":
                zone = "M" if zone in "swf" else "m"
        stack.append((tag, zone))
    if at < len(page):
        held.append(page[at:])
    flush()
    return _resolved(out)


def _resolved(lines: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Zones s (named by class alone), w (named by its place alone), f (in a form), A and M (article and main below these)
    made x, a, m and b. The larger of A, else M, counts where it has more characters than the zone that would be the text
    without it. Articles in a <main> that says more outside of them are cards of other pages. Without article or main, w and f
    are open text where they hold more than what is outside."""
    zones = {z for z, _ in lines}
    if "c" in zones:
        size = dict.fromkeys("cm", 0)
        for z, t in lines:
            if z in size:
                size[z] += len(t)
        card = "x" if size["m"] > size["c"] and "a" not in zones else "a"
        lines = [(card if z == "c" else z, t) for z, t in lines]
    if all(z in "xamb" for z, _ in lines):
        return lines
    size = dict.fromkeys("xambswfAM", 0)
    for z, t in lines:
        size[z] += len(t)
    if not any(n for z, n in size.items() if z not in "xs"):  # a class on what holds the whole text says nothing
        return [("b" if z == "s" else z, t) for z, t in lines]
    main = main_zone("".join(z for z, _ in lines))
    if main == "b":
        for z in "wf":
            if size[z] > size["b"]:
                lines = [("b" if y == z else y, t) for y, t in lines]
                size["b"] += size[z]
    held = size[main]
    won = "" if size["a"] else "A" if size["A"] > held else "M" if size["M"] > held and not size["A"] else ""
    return [(z.lower() if z == won else z if z in "xamb" else "x", t) for z, t in lines]


def _drops(tag: str, attributes: str, zone: str) -> str:
    """x where the element itself isn't of the article, s where only its class or id says so, w where these only say
    where it stands, f for a form around other text, else nothing."""
    if tag in _NOT_MAIN:
        return "x"
    inside = zone in "acmAM"
    if tag == "header" and not inside:
        return "x"
    if tag == "form":
        return "x" if inside else "f"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    classes, off = _names(attributes)
    if off:
        return "x"
    if tag == "article":
        return "x" if _named(classes, _ARTICLE_NAMES) else ""
    if tag in _RUNNING and inside:
        return "s" if _named(classes, _ARTICLE_NAMES) else ""
    if inside:
        return "s" if _named(classes, _NAMES - _OWN_NAMES) else ""
    if _named(classes, _NAMES - _PLACES):
        return "s"
    return "w" if tag in _BOXES and _named(classes, _NAMES) else ""


def main_zone(zones: str) -> str:
    """The zone that holds the page's text: that of articles, else of main, else the open one."""
    return "a" if "a" in zones else "m" if "m" in zones else "b"


def shared_lines(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places of a longest common subsequence in both, by bit vectors over b; long middles are halved
    where the lengths of their halves add up to most, so the vectors kept stay few."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    ia = [i for i in range(head, len(a) - tail) if a[i] in both]
    ib = [j for j in range(head, len(b) - tail) if b[j] in both]
    found = [(k, k) for k in range(head)] + [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail)]
    todo = [(ia, ib)]
    while todo:
        ia, ib = todo.pop()
        if not ia or not ib:
            continue
        if len(ia) > 1 and len(ia) * len(ib) > VECTOR_BITS:
            half = len(ia) // 2
            first = _lengths([a[i] for i in ia[:half]], [b[j] for j in ib])
            last = _lengths([a[i] for i in reversed(ia[half:])], [b[j] for j in reversed(ib)])
            cut = max(range(len(ib) + 1), key=lambda j: first[j] + last[len(ib) - j])
            todo += [(ia[:half], ib[:cut]), (ia[half:], ib[cut:])]
            continue
        rows = list(_states([a[i] for i in ia], [b[j] for j in ib]))
        i, j = len(ia), len(ib)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                found.append((ia[i - 1], ib[j - 1]))
                i, j = i - 1, j - 1
    return sorted(i for i, _ in found), sorted(j for _, j in found)


#: Bits of the vectors that one alignment keeps.
VECTOR_BITS = 1 << 26


def _states(a: list, b: list) -> Iterator[int]:
    """After each line of a, a vector over b; a zero bit says that the column adds one to the length."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    state = full = (1 << len(b)) - 1
    for x in a:
        u = state & where.get(x, 0)
        state = ((state + u) | (state - u)) & full
        yield state


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of a and each beginning of b."""
    for state in _states(a, b):
        pass
    out = [0]
    for bit in f"{state:0{len(b)}b}"[::-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def shared_by_neighbours(zones: str, sizes: list[int], marks: list[tuple[list[int], bool]]) -> set[int]:
    """Lines that neighbours which aren't copies share. marks: for each neighbour, the shared lines and whether
    the two pages are alike."""
    size = lambda lines: sum(sizes[i] for i in lines if zones[i] != "x")
    whole = size(range(len(zones)))
    unlike = [set(s) for s, alike in marks if not alike]
    out = set().union(*unlike)
    alike = [set(s) for s, like in marks if like]
    if unlike:
        own = whole - size(out)
        return out.union(*(s for s in alike if 2 * size(s - out) < own))
    twice = {i for k, s in enumerate(alike) for i in s if any(i in t for t in alike[:k])}
    left = whole - size(twice)
    return twice if len(alike) >= 3 and left >= max(OWN_CHARS, OWN_SHARE * whole) else set()


def strike(zones: str, sizes: list[int], marks: list[tuple[list[int], bool]]) -> tuple[list[bool], set[int]]:
    """Which lines stay, and which of the others differencing deletes."""
    main = main_zone(zones)
    unlike = [set(s) for s, alike in marks if not alike]
    often = Counter(i for s in unlike for i in s)
    own = lambda i: often[i] < max(MOST, IN_MOST * len(unlike))
    gone = {i for i in shared_by_neighbours(zones, sizes, marks) if zones[i] != "a" or not own(i)}
    return [z == main and i not in gone for i, z in enumerate(zones)], gone


def _place(host: str, path: str, page: int | None) -> tuple:
    return (host, path, page is not None, page or 0)


def _parsed(starts: list[tuple], lows: list[tuple], highs: list[tuple]):
    """Pages -> their compressed lines, in the run of their place and, near its ends, in the run beside it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in it:
            rows, runs, own, packed = [], [], [], []
            for i, (host, path, page, _, html) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                at = _place(host, path, page)
                mine = bisect_right(starts, at)
                z = press.compress("\n".join(f"{zone}{text}" for zone, text in lines_of(html or "")).encode("utf-8", "surrogatepass"))
                for run in (mine, *((mine + 1,) if mine < len(lows) and at >= lows[mine] else ()), *((mine - 1,) if mine and at < highs[mine - 1] else ())):
                    rows.append(i)
                    runs.append(run)
                    own.append(run == mine)
                    packed.append(z)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), pa.array(own), *(batch.column(c).take(take) for c in range(4)), pa.array(packed, pa.binary())], ["run", "own", "host", "path", "page", "url", "z"])

    return run


class _Page:
    """Lines of a page, and what its neighbours share of it."""

    def __init__(self, run: int, own: bool, host: str, page: int | None, url: str | None, z: bytes):
        packed = zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")
        lines = packed.split("\n") if packed else []
        self.key, self.own, self.page, self.url = (run, host), own, page, url
        self.zones, self.lines = "".join(x[0] for x in lines), [x[1:] for x in lines]
        self.marks: list[tuple[list[int], bool]] = []

    def open_share(self, shared: list[int]) -> float:
        size = sum(len(t) for z, t in zip(self.zones, self.lines, strict=True) if z != "x")
        return sum(len(self.lines[i]) for i in shared if self.zones[i] != "x") / max(1, size)

    def pair(self, other: _Page) -> None:
        i, j = shared_lines(self.lines, other.lines)
        alike = self.open_share(i) >= COPY and other.open_share(j) >= COPY
        self.marks.append((i, alike))
        other.marks.append((j, alike))

    def row(self) -> tuple:
        sizes = [len(t) for t in self.lines]
        keep, gone = strike(self.zones, sizes, self.marks)
        text = "\n".join(t for t, k in zip(self.lines, keep, strict=True) if k)
        main = main_zone(self.zones)
        return self.page, self.url, text, len(text), len({i for s, _ in self.marks for i in s}), len(gone), len(keep) - sum(keep) - len(gone), sum(self.zones[i] == main for i in gone)


OUT = "page_id bigint, url string, text string, n_chars bigint, n_shared_lines bigint, n_struck_lines bigint, n_marked_lines bigint, n_only_struck_lines bigint"


def _differenced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages -> texts. The last pages stay until those after them have been seen."""
    held: list[_Page] = []

    def out(pages: list[_Page]) -> pa.RecordBatch:
        rows = [p.row() for p in pages if p.own]
        types = (pa.int64(), pa.string(), pa.string(), *(pa.int64(),) * 5)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in OUT.split(", ")])

    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = _Page(*row)
            for d in NEAR:
                if len(held) >= d and held[-d].key == page.key:
                    page.pair(held[-d])
            held.append(page)
            if len(held) >= RUN + NEAR[-1]:
                yield out(held[: -NEAR[-1]])
                held = held[-NEAR[-1] :]
    yield out(held)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared_lines, n_struck_lines, n_marked_lines, n_only_struck_lines): text is the article's blocks
    joined by one newline; n_shared_lines are the page's lines that a neighbour shares, n_struck_lines those that are
    deleted for it, n_marked_lines those that only markup deletes, n_only_struck_lines those that markup would have left."""
    spark = ship(pages.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    keyed = pages.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("long").alias("page"), "url", "html")
    placed = ranked(keyed.select("host", "path", "page"), "host", "path", "page")
    first = placed.select("total").first()
    total = first.total if first else 0
    runs = max(1, min(total // RUN, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    begin = [k * total // runs for k in range(1, runs)]
    wanted = sorted({r + d for r in begin for d in (-NEAR[-1], 0, NEAR[-1])})
    edges = {r.rank: _place(r.host, r.path, r.page) for r in placed.where(F.col("rank").isin(wanted)).collect()} if wanted else {}  # three rows a run
    starts, lows, highs = ([edges[r + d] for r in begin] for d in (0, -NEAR[-1], NEAR[-1]))
    dealt = keyed.mapInArrow(_parsed(starts, lows, highs), "run int, own boolean, host string, path string, page bigint, url string, z binary")
    ordered = dealt.repartitionById(max(1, runs // 4), F.col("run")).sortWithinPartitions("run", "host", "path", "page", "url", "z")
    return ordered.select("run", "own", "host", "page", "url", "z").mapInArrow(_differenced, OUT)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
