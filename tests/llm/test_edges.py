"""Edge cases of operators 3, 4, 6, 7 and 10 and of the pipeline."""

import json
import time

import pytest

import public_tokenizers
from lexiloom.llm import bpe, decontam, pii
from lexiloom.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_long_texts_full_of_personal_data(spark):
    text = "write to me@example.org now, " * 8000
    docs = spark.createDataFrame([(1, text), (2, "1.2.3.4 " * 130), (3, "")], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.query(docs).collect()}
    assert time.time() - began < 60
    assert (got[1].n_email, got[2].n_ip, got[3].spans) == (8000, 130, "")
    assert got[1].spans.split(",")[-1] == f"email:{29 * 7999 + 9}:{29 * 7999 + 23}"
    assert [s.split(":")[1] for s in got[2].spans.split(",")] == [str(8 * k) for k in range(130)]
    assert pii.query(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_clean_rows_keep_columns_of_any_name(spark):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, item, "mine", "zero", 3), (2, "all else", "x", "y", 4), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _0 string, n_hit bigint")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontam.clean_rows(docs, items)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id = 2").collect()))


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    spec = json.load(open(BPE, encoding="utf-8"))
    bpe.refuse_others(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.refuse_others(spec | change)


def test_pipeline_of_empty_tables_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = " ".join(f"w{i}" for i in range(40))
    for name, docs, items in (("a", [], []), ("b", [(None, text, None, None, None), (1, text, "en", "s", 9), (2, None, "en", "s", 0)], [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(str(r.doc_id) for r in got) == ([] if name == "a" else ["1", "None"])


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4)], "u bigint, v bigint")
    assert sorted(tuple(r) for r in components(edges).collect()) == [(4, 4), (5, 4)]
    assert components(edges.limit(0)).count() == 0
