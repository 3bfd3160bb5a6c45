"""The stored variant index against the fuzzy join, line numbers over splits, and passes that check only what changed."""

import random

import pytest

from lexiloom.operators import correct, dictionary, fuzzy
from lexiloom.operators.variant_index import VariantIndex
from lexiloom.sources import resources


def test_index_finds_what_the_join_finds(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8)))
    words = spark.createDataFrame([(w, 100, -1.0) for w in sorted({word() for _ in range(300)})], "word string, freq bigint, log_prob double")
    typed = spark.createDataFrame([(word().upper() if rng.random() < 0.2 else word(),) for _ in range(200)] + [("",), (None,)], "typed string")
    index = VariantIndex(spark, str(tmp_path / "v"), 2, 4)
    assert index.matches(typed).count() == 0
    index.add(words.where("word < 'c'"))
    index.add(words.where("word >= 'b'"))  # some for the second time
    for k in (1, 2):
        assert sorted(map(tuple, index.matches(typed, k).collect())) == sorted(map(tuple, fuzzy.matches(typed, words, k).collect()))
    again = VariantIndex(spark, str(tmp_path / "v"), 2, 4)  # as another session would open it
    a, b = (fuzzy.candidates(typed, words, 2, found=found) for found in (again.matches(typed), None))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError):
        index.matches(typed, 3)


def test_the_dictionary_side_is_not_shuffled(spark, tmp_path):
    index = VariantIndex(spark, str(tmp_path / "v"), 1, 4)
    index.add(spark.createDataFrame([(f"w{i}",) for i in range(500)], "word string"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.createDataFrame([("w1",)], "typed string").selectExpr("typed", "xxhash64(typed) AS hash")
        plan = left.join(index.table(), "hash")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan.split("\n")
    at = next(i for i, line in enumerate(scan) if "FileScan" in line)
    assert "Bucketed: true" in scan[at] and plan.count("Exchange hashpartitioning") == 1
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    join = next(i for i, line in enumerate(scan) if "SortMergeJoin" in line)
    side = [line for line in scan[join + 1 : at] if depth(line) < depth(scan[at])]
    last = max(i for i, line in enumerate(side) if depth(line) == depth(scan[join]) + 3)
    assert not any("Exchange" in line for line in side[last:])


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng = random.Random(2)
    for name in ("a", "b"):
        lines = [rng.choice(["", "word", "w é", "x\t7"]) + (rng.choice("xyz") * rng.randint(0, 30)) for _ in range(400)]
        (tmp_path / name).write_bytes("\n".join(x + rng.choice(["", "\r"]) for x in lines).encode() + rng.choice([b"", b"\n"]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for name in ("a", "b"):
            got = resources.numbered(spark, str(tmp_path / name))
            assert got.rdd.getNumPartitions() > 4
            text = (tmp_path / name).read_bytes().decode().removesuffix("\n")
            assert sorted((r.n, r.line) for r in got.collect()) == [(i, x.removesuffix("\r")) for i, x in enumerate(text.split("\n"))]
        both = resources.numbered(spark, str(tmp_path))
        assert both.count() == sum(resources.numbered(spark, str(tmp_path / n)).count() for n in "ab") and both.where("n = 0").count() == 2
        ranked = resources.word_list(resources.numbered(spark, str(tmp_path / "a")))
        assert ranked.count() > 100
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_passes_check_only_what_changed(spark, monkeypatch):
    none = spark.createDataFrame([], "word string, freq bigint, log_prob double")
    typos = spark.createDataFrame([("aa", "bb"), ("bb", "cc"), ("cc", "dd"), ("x", "y")], "wrong string, right string")
    r = correct.Resources(dictionary.with_probability(none.select("word", "freq")), none, typos, typos.where("false"))
    docs = spark.createDataFrame([(1, "aa end"), (2, "bb"), (3, "none"), (4, None), (5, "x aa x"), (6, "")], "doc_id bigint, text string")
    read = []
    check = correct.check
    monkeypatch.setattr(correct, "check", lambda d, *a, **k: (read.append(sorted(x.doc_id for x in d.select("doc_id").collect())), check(d, *a, **k))[1])
    want = {1: {1: "bb end", 2: "cc", 5: "y bb y"}, 2: {1: "cc end", 2: "dd", 5: "y cc y"}, None: {1: "dd end", 2: "dd", 5: "y dd y"}}
    for passes, some in want.items():
        read.clear()
        got = {x.doc_id: x.corrected for x in correct.fix_all(docs, r, passes=passes).collect()}
        assert got == {3: "none", 4: None, 6: ""} | some
        assert read == [[1, 2, 3, 4, 5, 6], [1, 2, 5], [1, 2, 5], [1, 5]][: passes or 9]


def test_dictionary_folders_of_any_file_system(spark, tmp_path):
    (tmp_path / "dict").mkdir()
    (tmp_path / "file").write_text("x")
    for there, want in ((f"file://{tmp_path}/dict", True), (f"file://{tmp_path}/none", False), (f"file://{tmp_path}/file", False), (str(tmp_path / "dict"), True), (None, False), ("", False)):
        assert resources.dictionary_folder(there, "own", spark) == (there if want else "own")
    assert resources.dictionary_folder(str(tmp_path / "dict"), "own") == str(tmp_path / "dict") and resources.dictionary_folder("/no/such", "own") == "own"
