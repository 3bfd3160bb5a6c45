"""Operators 1, 3, 4, 7, 9, 10 and the pipeline against libraries and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import public_tokenizers
from lexiloom.llm import bpe, html, license, pieces, pii, tokenfile

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens string"


def texts(seed=2, n=250):
    rng = random.Random(seed)
    parts = list("aaab \n\t'sté日本😀<>0.1-!\x1c\x85\xa0　▁½²ß") + ["<|endoftext|>", "</s>", "<0x0A>", "the", " tion", "  ", "हिन्दी"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 70))) for _ in range(n)]
    return [None, "", " ", "a" * 3000, "ab " * 5000, " " * 500, *made, made[0], made[0]]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_counts_equal_the_library(spark, library):
    rows = texts()
    got = {r.doc_id: r for r in bpe.count_tokens(table(spark, rows), BPE).collect()}
    for i, t in enumerate(rows):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), repr(t)[:80]
    assert bpe.count_tokens(table(spark, rows).limit(0), BPE).count() == 0


def test_merger_gives_the_ids(library):
    m = bpe.merger(BPE)
    words = ["hello", " hello", "aaaaaaa", "日本", "x", "", " Straße", "abababab"]
    assert [list(x) for x in m.merge([w.encode() for w in words])] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_counts_when_the_table_is_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 10)
    m = bpe.RankMerger(BPE)
    for t in texts(3, 40):
        assert m.count_texts([t or ""]) == [len(library.encode(t or "", add_special_tokens=False).ids)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = texts()
    got = {r.doc_id: r for r in pieces.encode_digests(table(spark, rows), PIECES).collect()}
    plain = {r.doc_id: r for r in pieces.encode_documents(table(spark, rows), PIECES).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    c = pieces.codec(PIECES)
    for i, t in enumerate(rows):
        ids = [*model.encode(t or ""), 2]
        said = " ".join(map(str, ids))
        assert (plain[i].n_tokens, plain[i].ids, plain[i].decoded) == (len(ids), said, model.decode(ids)), repr(t)[:80]
        assert (got[i].ids_sha256, got[i].decoded_sha256) == (sha(said), sha(model.decode(ids)))
        assert c.decode(ids) == model.decode(ids)


def test_backtracking_equals_merging():
    c = pieces.codec(PIECES)
    rng = random.Random(8)
    known = sorted(p for p in c.ids if p.isascii() and p.isalpha())
    for _ in range(400):
        t = "".join(rng.choices(known, k=rng.randint(1, 6)))
        assert [c.text[i] for i in c._known(t)] == c.merge(t)


def test_token_files(spark, library, tmp_path):
    rows = texts()
    ids = list(range(len(rows)))
    random.Random(1).shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in tokenfile.query(docs, BPE).collect()}
    at = 0
    for i, t in sorted(zip(ids, rows, strict=True)):
        x = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    path = str(tmp_path / "ids")
    tokenfile.write(docs, BPE, path)
    assert [r.doc_id for r in tokenfile.find(spark, path, [ids[5]]).collect()] == [ids[5]]
    found = {r.doc_id: list(r.ids) for r in tokenfile.read(spark, path).collect()}
    assert found[ids[3]][-1] == 0 and sum(map(len, found.values())) == at


def test_token_files_with_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b c"), (0, None)], "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in tokenfile.query(docs, BPE).collect())
    assert [r[1] for r in rows] in ([0, 1, 3], [0, 1, 4]) and len(rows) == 3
    assert tokenfile.query(docs.limit(0), BPE).count() == 0


def luhn(digits):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(t):
    for kind, pattern in BASE:
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(v) > 255 for v in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            yield kind, m.start(), m.end()


def personal(seed=3, n=500):
    rng = random.Random(seed)
    parts = ["a", "b1", "@", "x.y", "@ab.c", "_d@e.f", "1.2.3.4", "255", "256", ".", "+", "+1 (234) 567-8901", "4785380592391139", "4785 3805-9239 1139", " ", "-", "é", "😀", "\n", "9", "00.1.2.3", "+44 20", "mail "]
    return [None, "", "1" * 20_000 + " " + "a." * 5000 + "@" + "b." * 5000, "1 " * 9000, *("".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n))]


def test_base_spans(spark):
    rows = personal()
    got = {r.doc_id: r for r in pii.query(table(spark, rows)).collect()}
    for i, t in enumerate(rows):
        found = list(base_spans(t or ""))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(f[0] == k for f in found) for k in pii.BASE], repr(t)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    "text, spans",
    [
        ("GB82 WEST 1234 5698 7654 32", "iban:0:27"), ("GB83 WEST 1234 5698 7654 32", ""), ("id 078-05-1120.", "ssn:3:14"), ("000-05-1120", ""), ("call 212-555-0143", "national_phone:5:17"), ("part 212-555-0143", ""),
    ],
)
def test_added_spans(spark, text, spans):
    assert pii.query(table(spark, [text])).first().spans == spans


def test_redaction(spark):
    docs = table(spark, ["é me@x.org, 1.2.3.4 end", None, "clean"])
    rows = pii.redact(docs).orderBy("doc_id")
    assert rows.columns == docs.columns
    assert [r.text for r in rows.collect()] == ["é [EMAIL], [IP] end", None, "clean"]


def test_shared_lines_are_longest():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randint(0, rng.choice([2, 6, 20])) for _ in range(rng.randint(0, 12))] for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        i, j = html.shared_lines(a, b)
        assert [a[k] for k in i] == [b[k] for k in j] and len(i) == length[-1][-1]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Big &amp; small</h1><p>One<br>two   <b>three</b><p>Four&nbsp;&lt;p&gt;<script>var t="</p>"</script>
<aside>side</aside><form><label>name</label></form><ul><li>x<li>y</ul></article><section id="comments"><p>First!</p></section></main><!-- ad --><footer>&copy; us</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, text string")


def test_article_text(spark):
    rows = [("http://a.com/1", PAGE), ("http://a.com/2", PAGE), (None, None), ("http://a.com/1", PAGE), ("http://b.com", ""), ("http://b.com/x", "<p>open <!-- never closed"), ("http://b.com/y", "<p>" + "z" * 50_000)]
    got = {r.page_id: r for r in html.extract(pages(spark, rows)).collect()}
    want = "Big & small\nOne two three\nFour <p>\nx\ny"
    assert [got[i].text for i in range(6)] == [want, want, "", want, "", "open"]
    assert got[6].n_chars == 50_000 and got[0].url == "http://a.com/1"
    assert html.extract(pages(spark, rows).limit(0)).count() == 0


def test_differencing_strikes_what_neighbours_share(spark):
    page = lambda n: f"<div>Home | About | Contact</div><div>{' '.join(f'story{n}w{k}' for k in range(40))}</div><div>Example Ltd</div>"
    rows = [(f"http://a.com/news/{n}", page(n)) for n in range(5)] + [("http://b.com/", page(9))]
    got = {r.page_id: r.text.split("\n") for r in html.extract(pages(spark, rows)).collect()}
    assert all(len(got[n]) == 1 and got[n][0].startswith(f"story{n}") for n in range(5))
    assert len(got[5]) == 3


def test_licence_model_holds_out():
    m = license.train()
    rows = license.labelled_rows(seed=99, limit=1200)
    right = wrong = plain = 0
    for t, label in rows:
        p = m.probabilities(t)
        best = max(range(len(p)), key=p.__getitem__)
        said = best if p[best] >= m.threshold else -1
        right += said == label
        plain += label < 0
        wrong += label < 0 <= said
    assert right / len(rows) > 0.95 and wrong / plain <= 0.02


def test_licence_scan(spark):
    rows = ["intro\nReleased under the MIT License.\nend", "Licensed under CC BY-NC 4.0.\nAll rights reserved.", None, "", "The driver's license expired.", "mit der Bahn"]
    docs = table(spark, [*rows, rows[0]])
    got = sorted((r.doc_id, r.n_licensed, r.families) for r in license.scan(docs).collect())
    assert got == [(0, 1, "MIT"), (1, 2, "CC-BY-NC,Proprietary"), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 0, ""), (6, 1, "MIT")]
    m = license.train()
    for r in license.paragraphs(docs).collect():
        assert max(m.probabilities(r.line)) == pytest.approx(r.probability, abs=1e-3)
    assert license.scan(docs.limit(0)).count() == 0


def test_groups_keep_one_row(spark, tmp_path):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (1, a), (1, a), (2, b), (None, b), (None, b), (5, None), (6, ""), (7, b + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert got == sorted([(1, a), (2, b), (0, b), (0, b), (5, ""), (6, "")])


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece
    from test_corpus_ops import contaminated, groups

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    plain = lambda n: " ".join(rng.choices(words, k=n))
    item = plain(30)
    base = plain(60)
    made = [base, base, base.replace("w1 ", "w2 ", 1), None, "", "short", "LOUD WORDS " * 30, f"{plain(20)} {item}", f"{plain(60)} me@x.org", *(plain(rng.randint(20, 80)) for _ in range(20))]
    folder = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(made)], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(folder)).collect()}

    left = {}
    for i, t in enumerate(made):
        w = (t or "").split()
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in range(k, k + 8)}
        if len(w) >= 20 and 100 * len(cover) <= 30 * len(w):
            left[i] = t
    left = {i: t for i, t in left.items() if groups(list(left.items()))[i][1] == i}
    dirty = contaminated(list(left.items()), [(1, item)])
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {}
    for i, t in left.items():
        if not dirty[i][4]:
            for k, a, b in sorted(base_spans(t), key=lambda s: -s[1]):
                t = f"{t[:a]}[{k.upper()}]{t[b:]}"
            ids = [*model.encode(t), 2]
            want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert got == want and len(want) > 15
