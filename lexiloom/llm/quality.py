"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the measurements beside one 64-bit
mask of failed rules. `apply_policy` turns a mask into a verdict by one bitwise AND with a
versioned policy; `ablation` counts, from masks alone, what each rule of a policy rejects and
what it alone rejects. A new policy, or the effect of leaving a rule out, needs no second look
at the texts.

Defined results: a null text measures as an empty one; empty and word-less texts have zero in
every measurement and fail TOO_FEW_WORDS; repeated rows give repeated ledger rows; an empty
table gives an empty ledger. Of the input only doc_id and text are read; other columns are
carried on by `keep=...` and may not be named like a measurement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bangs")
WINDOW = 8

#: Bit of each rule and the condition of failing it, over the measurements.
RULES: dict[str, tuple[int, str]] = {
    "TOO_FEW_WORDS": (0, "n_words < 20"),
    "REPEATED_WORDS": (1, "100 * n_repeat_words > 30 * n_words"),
    "SYMBOLS": (2, "n_words >= 20 AND 10 * n_symbols > n_words"),
    "SHOUTING": (3, "n_words >= 20 AND 2 * n_upper > n_letters AND n_letters > 0"),
    "BANGS": (4, "n_words >= 20 AND 4 * n_bangs > n_words"),
    "DUPLICATE_LINES": (5, "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    "LONG_WORDS": (6, "n_words >= 20 AND word_chars > 25 * n_words"),
    "SHORT_WORDS": (7, "n_words >= 20 AND 2 * word_chars < 3 * n_words"),
}


@dataclass(frozen=True)
class Policy:
    """A named version: a document is rejected if it fails any rule of it."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE = Policy("base", 1, ("TOO_FEW_WORDS", "REPEATED_WORDS"))
POLICIES = {
    ("base", 1): BASE,
    ("corpus", 1): Policy("corpus", 1, (*BASE.rules, "SYMBOLS", "SHOUTING")),
    ("corpus", 2): Policy("corpus", 2, tuple(RULES)),
    ("corpus", 3): Policy("corpus", 3, tuple(r for r in RULES if r != "DUPLICATE_LINES")),
}
#: The policy of the verdicts: a few repeated lines in a short text don't make it a bad one.
DEFAULT = ("corpus", 3)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    sums = K.prefix_sums(data)
    w = K.words(data, bounds, K.PLAIN_WORDS, sums)
    n_words = np.diff(w.first)
    inside = np.zeros(len(data) + 1, np.int64)  # code points inside words, up to each byte
    np.cumsum(((data & 0xC0) != 0x80) & (K.PLAIN_WORDS[data] != 0), out=inside[1:])
    at = lambda mask: K.per_doc(mask, bounds)

    newline = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], newline + 1]))
    start = start[start < len(data)]
    doc = np.searchsorted(bounds, start, side="right") - 1
    nearest = np.searchsorted(newline, start)
    end = np.append(newline, len(data))[nearest]
    end = np.minimum(end, bounds[doc + 1])
    full = inside[end] > inside[start]
    start, end, doc = start[full], end[full], doc[full]
    n_lines = np.bincount(doc, minlength=len(n_words))
    key = K.mix(K.span_hash(sums, start, end) + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, firsts, like = np.unique(key, return_index=True, return_inverse=True)
    n_dup = n_lines - np.bincount(doc[firsts], minlength=len(n_words))
    again = np.flatnonzero(firsts[like] != np.arange(len(key)))
    of = firsts[like[again]]
    for i in np.unique(doc[again[~K.same_spans(data, start[again], end[again], start[of], end[of]) | (doc[again] != doc[of])]]):  # equal fingerprints, other lines: told by bytes
        n_dup[i] = n_lines[i] - len({data[a:b].tobytes() for a, b in zip(start[doc == i], end[doc == i], strict=True)})

    w.hash = K.exact(w)
    first, h = K.windows(w, WINDOW)
    owner = w.doc[first]
    key = K.mix(h + owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    near = np.flatnonzero(same)
    one, two = order[near], order[near + 1]
    right = owner[one] == owner[two]
    for k in range(WINDOW):
        right &= w.hash[first[one] + k] == w.hash[first[two] + k]
    if not right.all():  # another window between equal ones: order by all of it
        order = np.lexsort((*(w.hash[first + k] for k in range(WINDOW)), owner))
        one, two = order[:-1], order[1:]
        same = owner[one] == owner[two]
        for k in range(WINDOW):
            same &= w.hash[first[one] + k] == w.hash[first[two] + k]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(w.hash) + 1, np.int64)
    hit = first[order[twice]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    lower, upper = (data >= 0x61) & (data <= 0x7A), (data >= 0x41) & (data <= 0x5A)
    return {
        "n_words": n_words,
        "word_chars": inside[bounds[1:]] - inside[bounds[:-1]],
        "n_symbols": at(_SYMBOLS[data]),
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": K.per_doc(repeated, w.first),
        "n_letters": at(lower | upper),
        "n_upper": at(upper),
        "n_bangs": at(data == 0x21),
    }


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    K.begin()
    for batch in it:
        names = batch.schema.names
        text = batch.column(names.index("text"))
        rest = [i for i, x in enumerate(names) if x != "text"]
        for a, b, data, bounds in K.slices(text):
            got = _measure(data, bounds)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in rest), *(pa.array(got[m], pa.int64()) for m in MEASURES)], [*(names[i] for i in rest), *MEASURES])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: `keep`, the measurements and fail_bits."""
    from lexiloom.session import ship

    ship(docs.sparkSession)
    clash = set(keep) & {*MEASURES, "fail_bits", "text"}
    if clash:
        raise ValueError(f"columns named like the ledger's own: {sorted(clash)}")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    measured = docs.select(*keep, "text").mapInArrow(_batches, ", ".join([*fields, *(f"{m} bigint" for m in MEASURES)]))
    bits = F.lit(0).cast("long")
    for bit, test in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def rejected(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy, version and kept; nothing is measured again."""
    return led.withColumns({"policy": F.lit(policy.name), "policy_version": F.lit(policy.version), "kept": ~rejected(policy)})


def kept_rows(docs: DataFrame, policy: Policy) -> DataFrame:
    """The rows of docs that the policy keeps, with docs' columns; measurements are dropped as
    soon as the verdict is there."""
    columns = docs.columns
    places = [f"_{i}" for i in range(len(columns))]  # names of docs may be anything
    held = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(columns, places, strict=True)), F.col("text"))
    found = ledger(held, tuple(places)).where(~rejected(policy))
    return found.select(*(F.col(p).alias(c) for c, p in zip(columns, places, strict=True)))


def ablation(led: DataFrame, policies: tuple[Policy, ...] = tuple(POLICIES.values())) -> DataFrame:
    """Per policy and rule: documents failing it, failing only it, and kept if it were left out.
    One aggregate of bit tests; its state is a few counters however many documents there are."""
    tests = [(p, r, 1 << RULES[r][0]) for p in policies for r in p.rules]
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = led.agg(F.count(F.lit(1)).alias("n"), *(x for i, (p, _, b) in enumerate(tests) for x in (count(hit(b) != 0).alias(f"f{i}"), count(hit(p.mask) == b).alias(f"o{i}"), count(hit(p.mask & ~b) == 0).alias(f"k{i}"))))
    rows = F.array(*(F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only"), F.col(f"k{i}").alias("n_kept_without")) for i, (p, r, _) in enumerate(tests)))
    return sums.select("n", F.explode(rows).alias("x")).select("x.*", F.col("n").alias("n_docs"))


def query(docs: DataFrame) -> DataFrame:
    led = apply_policy(ledger(docs.select("doc_id", "text")), POLICIES[DEFAULT])
    base = rejected(BASE)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits")
