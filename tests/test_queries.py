"""Queries over whole tables, held by brute force and by their SQL."""

import hashlib
import unicodedata

import duckdb

from lexiloom import queries


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.execute(queries.ORACLE_SQL[name]).fetchall()


def replaced(text):
    """text with each nd that stands alone made and, and how many there are."""
    part = lambda c: c == "_" or unicodedata.category(c)[0] in "LMN"
    out, n, i = "", 0, 0
    while i < len(text):
        alone = text.startswith("nd", i) and not (i and part(text[i - 1])) and not (i + 2 < len(text) and part(text[i + 2]))
        out, n, i = out + ("and" if alone else text[i]), n + alone, i + (2 if alone else 1)
    return out, n


def test_corrections_reach_every_text(spark, tmp_path):
    texts = ["salt nd pepper", "nd", "", "nd nd_nd nd1 end nd.", "né nd à", "énd ndé nd", "😀nd nd😀 nd日 日 nd", "ndé nd́ nd", "\n\nnd\nnd nd"]
    folder = saved(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {tuple(r) for r in queries.apply_corrections(spark, folder).collect()}
    made = [replaced(t) for t in texts]
    assert got == {(i, hashlib.md5(t.encode()).hexdigest(), n) for i, (t, n) in enumerate(made)}
    assert set(by_sql("apply_corrections", folder, "documents")) == got


def one_edit(a, b):
    """Edits from a to b if there are one at most: none, a letter lost, added or changed, or two neighbours swapped."""
    if a == b:
        return 0
    lost = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
    swapped = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    changed = len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return 1 if changed or b in swapped or b in lost(a) or a in lost(b) else None


def test_fuzzy_join_takes_every_word(spark, tmp_path):
    often = ["garden", "straße", "l'eau", "été", "x86", "années"]
    seldom = ["gardn", "gadren", "strasse", "strase", "straßee", "leau", "l'aeu", "éte", "été1", "x87", "x68", "anées", "2024", "é", "日本"]
    rows = [(0, " ".join(often * 25), "fr"), (1, " ".join(seldom), "de"), (2, "garden gardem " * 25, "en")]
    folder = saved(spark, tmp_path, documents=(rows, "doc_id bigint, text string, lang string"))
    got = {tuple(r) for r in queries.fuzzy_candidates_k1(spark, folder).collect()}
    dictionary = [*often, "gardem"]
    want = {(t, w, d) for t in {*dictionary, *seldom} for w in dictionary if (d := one_edit(t, w)) is not None}
    assert got == want and ("x68", "x86", 1) in want and ("anées", "années", 1) in want
    assert set(by_sql("fuzzy_candidates_k1", folder, "documents")) == got


def test_texts_with_newlines_at_their_ends_stay(spark, tmp_path):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    texts = ["Tips\nrow", "Tips\nrow\n", "Tips\n\n", "\nTips\nrow\n"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    folder = saved(spark, tmp_path, documents=(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), labels=([(9, 1, 0)], "doc_id bigint, quality int, toxic int"))
    got = {tuple(r) for r in queries.page_split(spark, folder).collect()}
    assert got == {(i, len(t.split("\n")), md5("|".join(t.split("\n")))) for i, t in enumerate(texts)}
    said = {r.name: r.content_hash for r in queries.export_txt(spark, folder).collect()}
    assert sorted(said) == [f"{i}|Tips" for i in range(4)]
    assert [said[f"{i}|Tips"] for i in range(3)] == [md5("Tips\nrow"), md5("Tips\nrow"), md5("Tips")]
    assert said["3|Tips"] in (md5("Tips\nrow"), md5("Tips\n\nTips\nrow"))
    for name in ("page_split", "export_txt"):
        assert set(by_sql(name, folder, "documents", "labels")) == {tuple(r) for r in getattr(queries, name)(spark, folder).collect()}
