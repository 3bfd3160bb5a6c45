"""The join of overlapping ranges against comparing all pairs, and labels from a stored zone table against the tokenizer."""

import random
import time

from pyspark.sql import functions as F

from lexiloom.operators import intervals
from lexiloom.operators.tokenize import tokens

LEFT, RIGHT = "doc_id bigint, n int, char_start int, char_end int", "doc_id bigint, m int, zone_start int, zone_end int"


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    for width in (1, 7, 256):
        span = lambda: (lambda a: (a, a + rng.choice([0, 1, 3, 9, 60])))(rng.randint(0, 90))  # noqa: E731, B023
        left = [(rng.randint(0, 2), i, *span()) for i in range(150)] + [(0, 990, None, 3), (None, 991, 1, 3)]
        right = [(rng.randint(0, 3), i, *span()) for i in range(120)] + [(1, 992, 4, None), (None, 993, 1, 9)]
        got = intervals.overlap_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), width=width).select("n", "m").collect()
        want = [(n, m) for d, n, a, b in left for e, m, c, f in right if None not in (d, a, b, c, f) and d == e and a < f and c < b]
        assert sorted(map(tuple, got)) == sorted(want)


def test_many_ranges_in_one_document(spark):
    """A hundred thousand ranges on each side of one document meet in many small groups."""
    n = 100_000
    left = spark.range(n).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("int").alias("n"), (F.col("id") * 10).cast("int").alias("char_start"), (F.col("id") * 10 + 8).cast("int").alias("char_end"))
    right = left.select("doc_id", F.col("n").alias("m"), (F.col("char_start") + 5).alias("zone_start"), (F.col("char_end") + 5).alias("zone_end"))
    began = time.time()
    joined = intervals.overlap_join(left, right)
    assert joined.count() == 2 * n - 1 and time.time() - began < 60
    assert intervals._cut(left, "char_start", "char_end", intervals.CELL).groupBy("doc_id", "_cell").count().agg(F.max("count")).first()[0] < 40


def test_labels_equal_the_tokenizer(spark):
    rng = random.Random(3)
    parts = ["---\na: b\n---\n", "```\ncode x\n```", "`x y`", "https://a.b/c,", "www.site.com)", "me@site.com.", "@bob", "#tag/x", "[t](the target)", "h2o", "NATO", "plain", "don't", "\n", " ", "é😀", "a@b", "(", "word "]
    texts = ["", None, *("".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(120))]
    docs = spark.createDataFrame([(i % 40, i, t) for i, t in enumerate(texts)], "a bigint, b bigint, text string")
    keys = ("a", "b")
    row = lambda r: (r.a, r.b, r.pos, r.byte_start, r.byte_end, r.char_start, r.char_end, r.word, r.reason)
    got = sorted(map(row, intervals.tokens_with(docs, intervals.zone_rows(docs, keys), keys).collect()))
    assert got == sorted(map(row, tokens(docs, keys).collect())) and {r[-1] for r in got} > {"frontmatter", "code_fence", "inline_code", "url", "email", "mention", "tag", "link_target", None}


def test_lines(spark):
    text = "\none\n\ntwo three\n"
    got = [(r.zone_start, r.zone_end) for r in intervals.line_rows(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).collect()]
    assert [text[a:b] for a, b in got] == ["one", "two three"]
