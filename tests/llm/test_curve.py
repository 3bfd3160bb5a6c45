"""Operator 8: cells in the order of the values, shards as runs of the curve, equal texts, nulls, files that filters skip."""

import random

import pytest

from lexiloom.llm import sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, curve string"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = [(i, "same text" if i % 5 == 0 else "x" * rng.randint(0, 300) + str(i), rng.choice(["de", "en", "en", None]), rng.choice([*(f"src{k}" for k in range(25)), None]), 1, "clash") for i in range(n)]
    return [*out, *out[:3], (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def placed(spark):
    return sharding.query(spark.createDataFrame(rows(), SCHEMA)).collect()


def test_shards_are_runs_of_the_curve(placed):
    assert len(placed) == len(rows())
    in_order = sorted(placed, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in in_order] == sorted(r.curve for r in placed)


def test_equal_texts_with_equal_labels_stand_side_by_side(placed):
    told = {r[0]: r for r in rows()}
    places = {}
    for at, r in enumerate(sorted(placed, key=lambda r: (r.shard, r.slot))):
        t = told[r.doc_id]
        if t[1] == "same text":
            places.setdefault((t[2], t[3]), []).append(at)
    assert len(places) > 20 and all(v[-1] - v[0] == len(v) - 1 for v in places.values())


def test_cells_keep_the_order_of_labels(spark):
    labels = [None, "", "a", "src1", "src10", "src19", "src2", "src3", "sré", "z" * 40]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, c string")
    number = [r.n for r in df.select("i", sharding.label_number(df["c"], 0).alias("n")).orderBy("i").collect()]
    assert number == sorted(number) and len(set(number)) == len(number)
    assert sharding.shared_bytes("src0", "src9") == 3 and sharding.shared_bytes("a", "ab") == 1 and sharding.shared_bytes(None, None) == 0
    import numpy as np

    bounds = [1, 5, 5, 5, 9]
    assert sharding.cells(np.array([-1, 0, 1, 2, 5, 6, 10]), bounds, 3).tolist() == [0, 0, 0, 1, 1, 4, 5]


def test_written_rows_keep_their_columns_and_filters_skip_files(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    files = sharding.write_shards(docs, str(tmp_path / "out")).cache()
    back = spark.read.parquet(str(tmp_path / "out")).select(*docs.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    n = files.count()
    for ranges in ({"source": ("src7", "src7")}, {"lang": ("de", "de")}, {"size": (250, 320)}):
        assert 0 < sharding.prune(files, **ranges).count() < 0.8 * n, ranges
