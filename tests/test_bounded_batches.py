"""Python workers put out rows in bounded parts, whatever a batch of texts holds."""

import pyarrow as pa

from lexiloom.operators import tokenize

TEXTS = ["The old house, 12 trees and NASA", None, "", "añb 😀 x1 wörd " * 40, "7 8 9 " * 30, "solo", "end 5"]


def _plain(text):
    rows = list(tokenize._words_of(text))
    free = [w if why is None else None for *_, w, why in rows]
    near = lambda some: next((w for w in some if w is not None), None)
    size = lambda part, code: len(part.encode(code, "surrogatepass")) // (2 if code == "utf-16-le" else 1)
    for k, (s, e, w, why) in enumerate(rows):
        yield k, size(text[:s], "utf-8"), size(text[:e], "utf-8"), s, e, w, why, near(reversed(free[:k])), near(free[k + 1 :]), size(text[:s], "utf-16-le"), size(text[:e], "utf-16-le")


def test_words_come_in_parts_and_are_all_there(monkeypatch):
    monkeypatch.setattr(tokenize, "PART", 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], ["doc_id", "_text"])
    parts = list(tokenize._batches(1, ["doc_id", "_text"], True)(iter([batch])))
    assert len(parts) > 10
    # a part is closed before a word that nothing protects, so the run of 90 numbers stays together
    assert max(p.num_rows for p in parts) <= 8 + 90 + 8
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [(i, *row) for i, t in enumerate(TEXTS) if t for row in _plain(t)]


def test_memory_of_a_worker_follows_no_batch():
    """A batch of as many words as twelve parts."""
    import tracemalloc

    text = "plain words that nobody protects " * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array([text] * 800, pa.string())], ["doc_id", "_text"])
    tracemalloc.start()
    n = sum(p.num_rows for p in tokenize._batches(1, ["doc_id", "_text"], True)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < 50_000_000


def test_files_come_in_parts(monkeypatch):
    from lexiloom.sources import export

    monkeypatch.setattr(export, "PART_BYTES", 5_000)
    names = [f"n{i}" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(["t", None] * 20), pa.array([["one\ntwo", "three"], None] * 20), pa.array([False, None] * 20)], ["path", "title", "pages", "twice"])
    parts = list(export._writer(export._pdf)(iter([batch])))
    assert len(parts) > 3 and max(p.nbytes for p in parts) < 10_000
    assert [(r["path"], r["content"]) for p in parts for r in p.to_pylist()] == [(n, export._pdf("" if i % 2 else "t", [] if i % 2 else ["one\ntwo", "three"], False)) for i, n in enumerate(names)]


def test_texts_are_aligned_in_parts(spark, monkeypatch):
    from lexiloom.operators import measure

    seen = []
    monkeypatch.setattr(measure, "ROWS", 3)
    monkeypatch.setattr(measure, "paired", lambda a, b: seen.append(0) or b)
    texts = spark.createDataFrame([(i, "a b", "a", "a b", "a b", [None, None]) for i in range(7)], "doc_id int, typed string, by_itself string, in_full string, meant string, classes array<string>")
    run = []
    frame = type(texts)
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema: run.append(f) or df)
    measure.aligned(texts)
    columns = ["doc_id", "classes", "typed", "by_itself", "in_full", "meant"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int32()), *(pa.array([["a", "b"]] * 7, pa.list_(pa.string())) for _ in columns[1:])], columns)
    assert [p.num_rows for p in run[0](iter([batch]))] == [3, 3, 1] and len(seen) == 21
