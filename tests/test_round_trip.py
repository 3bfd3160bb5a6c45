"""Notes and their files compared in one row."""

from test_queries import by_sql, saved

from lexiloom import queries


def test_each_note_is_compared_with_its_own_file(spark, tmp_path):
    texts = ["# Title\n\nbody", "---\na: b\n---\nbody", "one", "two: #x\nline", "", "one"]
    docs = [(min(i, 4), t, "en", "s", len(t)) for i, t in enumerate(texts)]  # the last two rows have one id
    folder = saved(spark, tmp_path, documents=(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), labels=([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    found = queries.front_matter_round_trip(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(by_sql("front_matter_round_trip", folder, "documents", "labels"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # with labels; texts aren't joined with texts
