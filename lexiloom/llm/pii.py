"""Personal data by regular expressions, checksum validators and nearby context words.

Main path: DataFrame functions only. An expression cuts the text at its matches; the lengths of
what lies between give the spans in code points. Validators then decide (Luhn for cards, mod-97
for IBANs, ranges and digit counts for the rest), and words within CONTEXT code points before a
span raise its score.

Base kinds are email, ip, card and phone, and a base span always stays. Added kinds are iban (mod-97), ssn
(area, group and serial rules) and national phone numbers, which have no checksum and so need a
context word to reach the threshold.

Defined results: a null or empty text has no spans; text-less columns and repeated rows pass
through; an empty table gives an empty result. Only doc_id and text are read, so clashing names
of other columns can't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.columns import let

CONTEXT = 40
THRESHOLD = 0.5
SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


@dataclass(frozen=True)
class Kind:
    """pattern may not match an empty text. Where the contract's pattern could try every start
    inside one long run, the pattern starts at the run's start or where the last match ended,
    and takes runs whole: the same matches without the retries."""

    name: str
    pattern: str
    must: str  # a text without a match of this cheap test has none of the pattern
    words: str  # context
    base: bool
    score: float


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|e-mail|contact|write", True, 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", "ip|host|server|addr", True, 0.8),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", "card|visa|master|amex|credit|carte|tarjeta|karte", True, 0.9),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "tel|phone|call|fax|mobile|cell", True, 0.8),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "iban|account|konto|compte|cuenta|bank", False, 0.9),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}", "ssn|social|security|tax", False, 0.6),
    Kind("national_phone", r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", r"[0-9][.-][0-9]{4}", "tel|phone|call|fax|mobile|cell", False, 0.3),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN: first four characters last, letters as 10 to 35."""
    compact = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + (code - 48)) % 97).otherwise((rest * 100 + (code - 55)) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # "at most 255" with leading zeros allowed
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        d = digits(value)
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        n = F.length(F.regexp_replace(value, " ", ""))
        return n.between(15, 34) & (mod97(value) == 1)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


#: Matches folded at once: a fold copies what it has for each match, so long texts are folded in runs.
RUN = 64


def matches_of(kind: Kind, text: Column) -> Column:
    """Array of (gap, value): the characters before each match and the match; last what follows, without a match.
    The text between matches stays out of the rows."""
    pieces = F.arrays_zip(F.transform(F.split(text, kind.pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, _lit(kind.pattern), F.lit(0)).alias("value"))
    return F.when(text.rlike(kind.must), pieces).otherwise(F.array().cast("array<struct<gap:int,value:string>>"))


def spans_of(kind: Kind, matches: Column, text: Column) -> Column:
    """Array of SPAN of a column of matches_of(): valid matches in order, with their scores."""
    size = lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))
    runs = F.sequence(F.lit(0), F.greatest(((F.size(matches) - 1) / RUN).cast("int"), F.lit(0)))
    run = lambda i: F.slice(matches, i * RUN + 1, F.lit(RUN))
    ends = F.transform(runs, lambda i: F.aggregate(run(i), F.lit(0), lambda a, x: a + size(x)))
    begins = F.aggregate(ends, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def valid_of(x: Column) -> Column:
        return F.aggregate(
            run(x["i"]),
            F.struct(x["at"].alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out")),
            lambda a, m: F.struct((a["at"] + size(m)).alias("at"), F.when(m["value"].isNull() | ~valid(kind.name, m["value"]), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct((a["at"] + m["gap"]).alias("start"), m["value"].alias("value"))))).alias("out")),
            lambda a: a["out"],
        )

    start = F.flatten(F.transform(F.arrays_zip(runs.alias("i"), F.slice(begins, F.lit(1), F.size(begins) - 1).alias("at")), valid_of))
    before = lambda s: F.lower(F.substring(text, F.greatest(s - CONTEXT, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT))))
    scored = F.transform(
        start,
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
            (F.lit(kind.score) + F.when(before(x["start"]).rlike(rf"(?<![a-z])(?:{kind.words})"), F.lit((1 - kind.score) * 0.8)).otherwise(F.lit(0.0))).alias("score"),
        ),
    )
    kept = scored if kind.base else F.filter(scored, lambda x: x["score"] >= THRESHOLD)
    return F.when(F.size(matches) > 1, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with one array column of spans for each kind, named pii_<kind>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({f"pii_{k.name}": matches_of(k, text) for k in KINDS})
    return found.withColumns({f"pii_{k.name}": spans_of(k, F.col(f"pii_{k.name}"), text) for k in KINDS})


def joined(names: tuple[str, ...]) -> Column:
    said = lambda n: F.transform(F.col(f"pii_{n}"), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(F.concat(*(said(n) for n in names)), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, widest span first where
    spans overlap. Columns stay as they are; a null text stays null."""
    columns = docs.columns
    spans = F.array_sort(F.concat(*(F.transform(F.col(f"pii_{k.name}"), lambda x: F.struct(x["start"], (-x["end"]).alias("neg"), x["kind"])) for k in KINDS)))
    return find_spans(docs).withColumn("text", let(F.struct(spans.alias("spans"), F.col("text").alias("text")), replaced)).select(*columns)


def replaced(v: Column) -> Column:
    """v.text with v.spans (sorted structs of start, neg, kind) replaced, but those that begin before an earlier one ends. The
    greatest end before each run of spans is known first, so runs are cut independently, each out of its own part of the text."""
    spans, text = v["spans"], v["text"]
    runs = F.sequence(F.lit(0), F.greatest(((F.size(spans) - 1) / RUN).cast("int"), F.lit(0)))
    run = lambda i: F.slice(spans, i * RUN + 1, F.lit(RUN))
    ends = F.transform(runs, lambda i: -F.array_min(F.transform(run(i), lambda x: x["neg"])))
    begins = F.aggregate(ends, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.greatest(F.element_at(a, -1), n))))

    def cut(x: Column) -> Column:
        return F.aggregate(
            run(x["i"]),
            F.struct(x["at"].alias("at"), F.array().cast("array<string>").alias("out")),
            lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], -s["neg"]).alias("at"), a["out"].alias("out"))).otherwise(
                F.struct((-s["neg"]).alias("at"), F.concat(a["out"], F.array(F.substring(x["part"], a["at"] - x["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
            ),
            lambda a: F.array_join(a["out"], ""),
        )

    def whole(at: Column) -> Column:
        parts = F.transform(runs, lambda i: F.struct(i.alias("i"), F.get(at, i).alias("at"), F.substring(text, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i)).alias("part")))
        return F.concat(F.array_join(F.transform(parts, cut), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(begins, whole)).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    found = find_spans(docs.select("doc_id", "text"))
    return found.select("doc_id", *(F.size(f"pii_{n}").cast("long").alias(f"n_{n}") for n in BASE), F.sha2(joined(BASE), 256).alias("base_sha256"), joined(tuple(k.name for k in KINDS)).alias("spans"))
