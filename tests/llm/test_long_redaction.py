"""Operator 7: redaction of texts with more spans than a run holds, against a plain loop over them."""

import random

from lexiloom.llm import pii


def plain(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redaction_equals_a_plain_loop(spark):
    rng = random.Random(5)
    some = ("ann.lee@example.com", "10.0.0.7", "4111 1111 1111 1111", "+49 30 1234567", "x@+49 30 1234567.de", "4111111111111111@example.com", "a@10.1.2.3", "ü😀", "word", "call", "\n", "DE89 3704 0044 0532 0130 00")
    texts = [" ".join(rng.choices(some, k=k)) for k in (0, 1, 5, pii.RUN - 1, pii.RUN, pii.RUN + 1, 3 * pii.RUN, 900)] + ["a.b@c.de " * (2 * pii.RUN), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r.doc_id: [(int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in r.spans.split(",") if s] for r in pii.query(docs).collect()}
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert max(map(len, spans.values())) > 4 * pii.RUN
    assert got == {i: t if t is None else plain(t, spans[i]) for i, t in enumerate(texts)}
