import sqlite3

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import correct, dictionary, search, store
from lexiloom.plans.workspace import Workspace, store_columns
from lexiloom.sources import export, notes as note_files, resources
from lexiloom.streaming.notes import corrected_stream


def note(i, title="t", body="b", updated=0, **more):
    base = {"id": str(i), "path": f"{i}.md", "title": title, "body": body, "created_at": 0, "updated_at": updated, "pinned": False, "archived": False, "trashed_at": None, "content_hash": "h", "opened_count": 0, "last_opened_at": None, "tags": [], "title_manual": False}
    return tuple((base | more)[c] for c in store_columns())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), store.SCHEMA)


def test_listing(spark):
    df = frame(spark, note(1, updated=5), note(2, updated=9), note(3, updated=1, pinned=True), note(4, trashed_at=3), note(5, archived=True))
    assert [r.id for r in store.listing(df).collect()] == ["3", "2", "1"]
    assert "body" not in store.listing(df).columns
    assert store.count_live(df).first().n == 4
    pinned, rest = store.pinned_and_rest(store.listing(df))
    assert (pinned.count(), rest.count()) == (1, 2)


def test_upsert_touch_trash(spark):
    old = frame(spark, note(1, "a", updated=1, created_at=1, opened_count=7, trashed_at=9), note(2, "b"))
    new = frame(spark, note(1, "x", updated=2, created_at=5), note(1, "y", updated=3, created_at=6), note(3, "c"))
    rows = {r.id: r for r in store.upsert(old, new).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert (rows["1"].title, rows["1"].created_at, rows["1"].opened_count, rows["1"].trashed_at) == ("y", 1, 7, None)
    opens = spark.createDataFrame([("2", 5), ("2", 8), ("9", 1)], "id string, ts bigint")
    r = store.touched(old, opens).where("id = '2'").first()
    assert (r.opened_count, r.last_opened_at) == (2, 8)
    gone = store.trash(old, spark.createDataFrame([("2",)], "id string"), F.lit(77))
    assert {r.id: r.trashed_at for r in gone.collect()} == {"1": 9, "2": 77}


def test_tags(spark):
    df = frame(spark, note(1, tags=["B", "a", "b"]), note(2))
    rows = {r.id: r.tags for r in store.with_tags(df, store.tag_rows(df)).collect()}
    assert rows == {"1": ["a", "b"], "2": []}
    assert store.tags_of(store.tag_rows(df), df.where("id = '2'")).count() == 0


def test_hash_and_changes(spark):
    assert store.fnv1a("") == "cbf29ce484222325" and store.fnv1a("a") == "af63dc4c8601ec8c"
    a, b = frame(spark, note(1), note(2), note(3)), frame(spark, note(1), note(2, content_hash="x"), note(4))
    assert {r.id for r in store.changed_ids(a, b).collect()} == {"2", "3", "4"}


@pytest.mark.parametrize(
    "content, title, body",
    [
        ("---\nid: a\ntitle: \"T: 1\"\ntags: [x, 'y z']\ncreated: 2024-01-01T00:00:00Z\nupdated: 2023-01-01T00:00:00Z\npinned: yes\nodd: 1\n---\n\nbody\n", "T: 1", "body\n"),
        ("# Head\ntext", "Head", "# Head\ntext"), ("---\nno end", "---", "---\nno end"), ("﻿---\ntitle: t\n---\nb", "t", "b"), ("", "Tanpa judul", ""), ("---\ntitle:\ncreated: never\n---\nfirst", "first", "first"),
    ],
)
def test_front_matter(spark, content, title, body):
    r = note_files.parse(spark.createDataFrame([("d/n.md", content, 50)], "path string, content string, modified bigint")).first()
    assert (r.title, r.body) == (title, body)
    if "T: 1" in content:
        assert (r.id, r.tags, r.pinned, r.created_at, r.updated_at) == ("a", ["x", "y z"], True, 1704067200, 1704067200)
    else:
        assert r.id == "n" and r.created_at == 50


def test_files_round_trip(spark, tmp_path):
    rows = frame(spark, note(1, 'Say: "hi" \\', "body\n\nmore", 5, tags=["a", "b"], pinned=True, path="x/1.md"), note(2, "plain", "", 6, path="2.md", title_manual=True))
    root = str(tmp_path / "vault")
    assert note_files.write_files(note_files.rendered(rows), root) == 2
    (tmp_path / "vault" / ".trash").mkdir()
    (tmp_path / "vault" / ".trash" / "old.md").write_text("gone")
    back = {r.id: r for r in note_files.parse(note_files.scan(spark, root)).collect()}
    assert set(back) == {"1", "2"}
    for r in rows.collect():
        b = back[r.id]
        assert (b.path, b.title, b.body, b.created_at, b.updated_at, b.pinned, b.tags, b.title_manual) == (r.path, r.title, r.body, r.created_at, r.updated_at, r.pinned, r.tags, r.title_manual)


def test_resource_loaders(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\nTeh\tthe\n\nteh\tthee\nx\nsame\tsame\n\ta\n")
    (tmp_path / "w.txt").write_text("# c\none\ntwo 7\nbad x\nzero 0\n")
    (tmp_path / "p.tsv").write_text("A\tb\t2\na\tb\t3\na\tc\tx\n")
    t = resources.replacements(resources.numbered(spark, str(tmp_path / "t.tsv")))
    assert [tuple(r) for r in t.collect()] == [("teh", "thee")]
    w = {r.word: r.freq for r in resources.word_list(resources.numbered(spark, str(tmp_path / "w.txt"))).collect()}
    assert w == {"one": 4, "two": 7, "bad": 2, "zero": 1}
    p = resources.pair_list(resources.numbered(spark, str(tmp_path / "p.tsv")))
    assert [tuple(r) for r in p.collect()] == [("a", "b", 5)]
    assert resources.or_empty(spark, str(tmp_path / "none.txt"), resources.word_list, "word string, freq bigint").count() == 0


def test_dictionary_merge(spark):
    a = spark.createDataFrame([(" The", 5), ("teh", 99), ("x", 1)], "word string, freq bigint")
    b = spark.createDataFrame([("the", 9)], "word string, freq bigint")
    typos = spark.createDataFrame([("teh", "the")], "wrong string, right string")
    rows = {r.word: r.freq for r in dictionary.merged(dictionary.filtered(a, typos, 2), b).collect()}
    assert rows == {"the": 9}


TEXTS = ["the quick brown fox", "quick quick foxes", "élan vital and the fox's den", "nothing here", "THE fox, the fox", "don't stop"]


@pytest.mark.parametrize("query, variants", [("fox", ()), ("the fox", ()), ("quick fo", ()), ("elan", ()), ("nothin", ("quick",)), ("don't", ()), ("fox's d", ()), ("zzz", ()), ("!!", ())])
def test_search_equals_sqlite(spark, query, variants):
    rows = [note(i, f"note {i} " + t.split()[0], t, i) for i, t in enumerate(TEXTS)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no text index here")
    for i, r in enumerate(rows):
        db.execute("INSERT INTO f(rowid, title, body) VALUES (?, ?, ?)", (i, r[2], r[3]))
    match = search.query_text(query, variants)
    want = dict(db.execute("SELECT rowid, bm25(f, 12.0, 1.0) FROM f WHERE f MATCH ?", (match,)).fetchall()) if match else {}
    got = {int(r.id): r.score for r in search.search(search.indexed(frame(spark, *rows)), query, variants).collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_search_order_and_trash(spark):
    df = frame(spark, note(1, "fox", "fox"), note(2, "x", "fox", pinned=True), note(3, "fox", "fox", trashed_at=1), note(4, "no", "no"), note(5, "a", "b"), note(6, "c", "d"))
    rows = search.search(search.indexed(df), "fox").collect()
    assert [r.id for r in rows] == ["2", "1"]
    assert rows[0].snippet == "«fox»"


def test_query_text():
    assert search.query_text('a"b c*', ()) == '("ab" AND "c"*)'
    assert search.query_text("a", ("a", "b")) == '("a"*) OR ("b"*)'
    assert search.query_text(" ?! ", ()) is None


def test_exports(spark, tmp_path):
    import io
    import zipfile

    body = "# Plan\nline (one)\n=== HALAMAN ===\nsecond é €"
    df = frame(spark, note(1, "Plan", body), note(2, "A/B", "x " * 400))
    for kind, head in (("pdf", b"%PDF-1.4"), ("word", b"PK"), ("TXT", None), ("markdown", None)):
        made = {r.path: bytes(r.content) for r in export.exported(df, kind).collect()}
        ext = export.parse_format(kind)
        assert set(made) == {f"Plan.{ext}", f"A B.{ext}"}
        one = made[f"Plan.{ext}"]
        if head:
            assert one.startswith(head)
        if ext == "pdf":
            assert one.count(b"/Type /Page ") == 2 and rb"line \(one\)" in one and "é EUR".encode("latin-1") in one
        if ext == "docx":
            xml = zipfile.ZipFile(io.BytesIO(one)).read("word/document.xml").decode()
            assert 'w:type="page"' in xml and "second é €" in xml
        if ext == "txt":
            assert one.decode() == "# Plan\nline (one)\f\nsecond é €"
        if ext == "md":
            assert " Halaman 2 " in one.decode()
    with pytest.raises(ValueError):
        export.parse_format("odt")


@pytest.fixture
def workspace(spark, tmp_path):
    words = dictionary.with_probability(spark.createDataFrame([("the", 9000), ("house", 400)], "word string, freq bigint"))
    typos = spark.createDataFrame([("teh", "the")], "wrong string, right string")
    slang = spark.createDataFrame([("gk", "tidak")], "wrong string, right string")
    return Workspace(spark, str(tmp_path / "ws"), correct.Resources(words, words, typos, slang))


def test_workspace(workspace, tmp_path):
    w = workspace
    assert w.stats() == {"notes": 0} and w.list_notes().count() == 0
    a = w.create_note("# First\nteh fox")
    w.create_note("second")
    assert w.stats() == {"notes": 2}
    n = w.load_note(a)
    assert n["title"] == "First" and w.notes().where(F.col("id") == a).first().opened_count == 1
    w.save_note(n | {"body": "# Renamed\nfox", "title_manual": False})
    assert w.load_note(a)["title"] == "Renamed"
    assert [r.id for r in w.search_notes("fo").collect()] == [a]
    assert w.export_note(a, "md", str(tmp_path / "out")) == 1
    w.snapshot()
    w.trash_note(a)
    assert w.load_note(a) is None and w.stats() == {"notes": 1}
    assert w.fix_all("teh gk") == "the tidak"
    w.add_to_user_dict("Teh")
    w.record_undo("x", "y")
    w.record_undo("X", "y")
    assert w.fix_all("teh gk") == "teh tidak" and w.undo().first()["count"] == 2
    assert w.set_corrector_settings(slang=False).slang is False and w.fix_all("gk") == "gk"
    assert len(w.aggressiveness_options()) == 3 and w.dict_status()["ready"] is False


def test_stream(spark, tmp_path, workspace):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "teh"), (2, "ok")], "doc_id bigint, text string").coalesce(1).write.parquet(source)
    arriving = spark.readStream.schema("doc_id bigint, text string").parquet(source)
    corrected_stream(arriving, workspace.resources, workspace.settings, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(90)
    assert {r.doc_id: r.corrected for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "the", 2: "ok"}


def test_workspace_files(workspace, tmp_path):
    w, files = workspace, tmp_path / "ws" / "files"
    a = w.create_note("# First\nfox")
    path = w.load_note(a)["path"]
    assert (files / path).read_text().endswith("# First\nfox")
    (files / path).write_text((files / path).read_text().replace("fox", "edited elsewhere"))
    n = w.load_note(a)
    assert n["body"] == "# First\nedited elsewhere" and n["opened_count"] == 1
    w.save_note(n | {"body": "# Second\nfox"})
    assert w.load_note(a)["path"] == path and (files / path).read_text().endswith("# Second\nfox")
    w.trash_note(a)
    assert not (files / path).exists() and (files / ".trash" / path).exists() and w.load_note(a) is None
    b = w.create_note("gone")
    (files / w.load_note(b)["path"]).unlink()
    assert w.load_note(b) is None
    with pytest.raises(ValueError):
        note_files.write_files(w.spark.createDataFrame([("x.md", b"1"), ("x.md", b"2")], "path string, content binary"), str(tmp_path / "two"))
