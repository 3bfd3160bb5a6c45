"""Queries over the driver's tables, by name, and DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.morphology import stem_list
from lexiloom.operators import correct, dictionary, fuzzy, ranks, search, store
from lexiloom.operators.tokenize import tokens, words
from lexiloom.plans import notes as plan
from lexiloom.session import ship, stored, table
from lexiloom.sources import export, notes as note_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _settings() -> correct.Settings:
    """Thresholds that fit dictionaries made of a small corpus."""
    return correct.Settings(min_dict_size=50, solid_secondary=25, context_freq=20, context_strong=5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected text of every document."""
    return correct_text(spark, sf_dir)


# SQL that several oracles share
_TITLE = "coalesce(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x, ' '), '^#+', ''), ' ')), lambda x: x <> '')[1], 120), 'Tanpa judul')"
_NOTES = f"""notes AS (SELECT d.doc_id::VARCHAR AS id, {_TITLE} AS title, text AS body, (1704067200 + d.doc_id * 3600)::BIGINT AS created_at, (1704067200 + d.doc_id * 3600 + n_chars)::BIGINT AS updated_at,
 coalesce(toxic = 1, false) AS pinned, coalesce(quality = 0, false) AS archived, CASE WHEN n_chars < 100 THEN (1704067200 + d.doc_id * 3600 + n_chars)::BIGINT END AS trashed_at, lang, source, md5(text) AS content_hash
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_LIST = "list_filter(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}''’]+'), lambda w: trim(w, '''’')), lambda w: w <> '')"
_WORDS = f"words AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, lang, {_LIST} AS w FROM documents))"
_TYPO_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in plan.TYPOS)
_SLANG_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in plan.SLANG)


def _case(word: str, right: str) -> str:
    letters = f"regexp_replace({word}, '[^\\p{{L}}]', '', 'g')"
    return f"CASE WHEN length({letters}) > 1 AND NOT regexp_matches({letters}, '[^\\p{{Lu}}]') THEN upper({right}) WHEN regexp_matches({word}, '^\\p{{Lu}}') THEN upper({right}[1]) || {right}[2:] ELSE {right} END"


@query(f"WITH {_NOTES} SELECT id, title, updated_at, pinned FROM notes WHERE trashed_at IS NULL AND NOT archived ORDER BY pinned DESC, updated_at DESC LIMIT 500")
def note_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listing(plan.notes(spark, sf_dir)).select("id", "title", "updated_at", "pinned")


@query(f"WITH {_NOTES} SELECT count(*)::BIGINT AS n FROM notes WHERE trashed_at IS NULL")
def note_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_live(plan.notes(spark, sf_dir))


@query(f"WITH {_NOTES} SELECT id, array_to_string(list_sort(list_distinct([lower(lang), lower(source)])), ',') AS tags FROM notes")
def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.notes(spark, sf_dir)
    return store.with_tags(rows, store.tag_rows(rows)).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {_NOTES}, changed AS (SELECT item_id::VARCHAR AS id, text AS body, {_TITLE} AS title FROM benchmark)
SELECT coalesce(n.id, c.id) AS id, coalesce(c.title, n.title) AS title, md5(coalesce(c.body, n.body)) AS body_hash, coalesce(n.created_at, 1800000000)::BIGINT AS created_at, CASE WHEN c.id IS NULL THEN n.updated_at ELSE 1800000000 END::BIGINT AS updated_at,
 CASE WHEN c.id IS NULL THEN n.trashed_at END AS trashed_at FROM notes n FULL JOIN changed c ON n.id = c.id""")
def note_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = plan.notes(spark, sf_dir)
    at = F.lit(1_800_000_000).cast("bigint")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("body"))
    new = items.select(
        "id", F.lit("").alias("path"), T.derive_title(F.col("body"), T.TITLE_FALLBACK).alias("title"), "body", at.alias("created_at"), at.alias("updated_at"), F.lit(False).alias("pinned"), F.lit(False).alias("archived"),
        F.lit(None).cast("bigint").alias("trashed_at"), F.md5("body").alias("content_hash"), F.lit(0).cast("bigint").alias("opened_count"), F.lit(None).cast("bigint").alias("last_opened_at"), F.array().cast("array<string>").alias("tags"), F.lit(False).alias("title_manual"),
    )
    return store.upsert(old, new).select("id", "title", F.md5("body").alias("body_hash"), "created_at", "updated_at", "trashed_at")


@query(f"WITH {_NOTES} SELECT id, title, archived FROM notes WHERE trashed_at IS NULL")
def soft_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(plan.notes(spark, sf_dir)).select("id", "title", "archived")


@query(f"WITH {_NOTES} SELECT id, CASE WHEN id IN (SELECT item_id::VARCHAR FROM benchmark) THEN 1900000000 ELSE trashed_at END::BIGINT AS trashed_at FROM notes")
def note_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return store.trash(plan.notes(spark, sf_dir), ids, F.lit(1_900_000_000)).select("id", "trashed_at")


@query(f"WITH {_NOTES} SELECT id, coalesce(o.n, 0)::BIGINT AS opened_count, o.last::BIGINT AS last_opened_at FROM notes LEFT JOIN (SELECT user_id::VARCHAR AS u, count(*) AS n, max(floor(epoch(ts))) AS last FROM events WHERE event_type = 'view' GROUP BY 1) o ON id = o.u")
def note_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").cast("string").alias("id"), F.unix_timestamp("ts").alias("ts"))
    return store.touched(plan.notes(spark, sf_dir), opens).select("id", "opened_count", "last_opened_at")


@query("SELECT user_id, count(*)::BIGINT AS opened_count, max(floor(epoch(ts)))::BIGINT AS last_opened_at FROM events GROUP BY user_id")
def open_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_counts(table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("ts")), "user_id")


@query("SELECT lower(event_type) AS from_word, props AS to_word, count(*)::BIGINT AS count FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def rejected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.rejected_pairs(table(spark, sf_dir, "events").select(F.col("event_type").alias("from_word"), F.col("props").alias("to_word")))


@query(f"SELECT doc_id, {_TITLE} AS title FROM documents")
def title_from_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.derive_title(F.col("text"), T.TITLE_FALLBACK).alias("title"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(left({0}, 60)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'catatan')"


@query(f"SELECT 'd' || doc_id AS id, {_SLUG.format(_TITLE)} AS slug FROM documents UNION ALL SELECT 'p' || p_partkey, {_SLUG.format('p_name')} FROM part")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), T.slug(T.derive_title(F.col("text"), T.TITLE_FALLBACK)).alias("slug"))
    return docs.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), T.slug(F.col("p_name")).alias("slug")))


@query(f"SELECT doc_id, {_SLUG.format(_TITLE)} || '-' || lower(left(reverse('note' || doc_id), 6)) || '.md' AS file FROM documents")
def note_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", store.file_name(T.derive_title(F.col("text"), T.TITLE_FALLBACK), F.concat(F.lit("note"), "doc_id")).alias("file"))


@query("SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(regexp_replace(p_name || ': ' || p_type || '/' || p_brand, '[\\\\/:*?\"<>|]+', ' ', 'g'), '\\s+', ' ', 'g')), 80), ''), 'catatan') AS name FROM part")
def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_file_name(F.concat("p_name", F.lit(": "), "p_type", F.lit("/"), "p_brand")).alias("name"))


@query(f"WITH {_WORDS} SELECT doc_id, pos::INT AS pos, word FROM words")
def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(table(spark, sf_dir, "documents"))


@query(f"WITH {_WORDS} SELECT lower(word) AS word, count(*)::BIGINT AS freq FROM words GROUP BY 1")
def word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.from_tokens(words(table(spark, sf_dir, "documents")))


@query(f"WITH {_WORDS}, typos(wrong, right_word) AS (VALUES {_TYPO_ROWS}) SELECT word, freq FROM (SELECT lower(word) AS word, count(*)::BIGINT AS freq FROM words GROUP BY 1) WHERE freq >= 25 AND word NOT IN (SELECT wrong FROM typos)")
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.filtered(dictionary.from_tokens(words(table(spark, sf_dir, "documents"))), plan.typos(spark))


_TALK = _LIST.replace("text", "c.text")
_MERGED = f"""both_lists AS (SELECT lower(word) AS word, count(*) AS freq FROM words GROUP BY 1 UNION ALL
 SELECT lower(w) AS word, count(*) AS freq FROM (SELECT unnest({_TALK}) AS w FROM conversations c) GROUP BY 1), merged AS (SELECT word, max(freq)::BIGINT AS freq FROM both_lists GROUP BY word)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = words(table(spark, sf_dir, "conversations"), ("conv_id", "turn"))
    return dictionary.merged(dictionary.from_tokens(words(table(spark, sf_dir, "documents"))), dictionary.from_tokens(talk))


@query(f"WITH {_WORDS}, {_MERGED} SELECT word, freq FROM merged")
def vocabulary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"WITH {_WORDS}, {_MERGED} SELECT word, round(ln(freq / (SELECT sum(freq) FROM merged)), 6) AS log_prob FROM merged")
def vocabulary_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.with_probability(_merged(spark, sf_dir)).select("word", F.round("log_prob", 6).alias("log_prob"))


_PAIRS = "pairs AS (SELECT l AS left_word, r AS right_word, count(*)::BIGINT AS n FROM (SELECT lower(word) AS l, lower(lead(word) OVER (PARTITION BY doc_id ORDER BY pos)) AS r FROM words) WHERE r IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_WORDS}, {_PAIRS} SELECT left_word, right_word, n FROM pairs")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.pair_counts_of_texts(table(spark, sf_dir, "documents")).select(F.col("left").alias("left_word"), F.col("right").alias("right_word"), F.col("count").alias("n"))


_FREE = "(NOT regexp_matches(word, '\\p{N}') AND NOT (length(regexp_replace(word, '[^\\p{L}]', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(word, '[^\\p{L}]', '', 'g'), '[^\\p{Lu}]')))"
_NEAR = f"""near AS (SELECT doc_id, lang, pos, word, last_value(CASE WHEN free THEN word END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_word,
 first_value(CASE WHEN free THEN word END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_word FROM (SELECT *, {_FREE} AS free FROM words))"""


def _marked(docs: DataFrame) -> DataFrame:
    """Words with their neighbours; what zones protect is left to tests, as the SQL has no zones."""
    return tokens(docs, zoned=False, neighbours=True)


@query(f"WITH {_WORDS}, {_NEAR} SELECT doc_id, pos::INT AS pos, word, prev_word, next_word FROM near")
def neighbour_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(table(spark, sf_dir, "documents")).select("doc_id", "pos", "word", "prev_word", "next_word")


@query(f"""WITH {_WORDS}, {_PAIRS}, {_NEAR} SELECT doc_id, pos::INT AS pos, round(CASE WHEN prev_word IS NULL THEN 0 ELSE ln(coalesce(a.n, 0) + 0.5) END + CASE WHEN next_word IS NULL THEN 0 ELSE ln(coalesce(b.n, 0) + 0.5) END, 6) AS context,
 (coalesce(a.n > 0, false)::INT + coalesce(b.n > 0, false)::INT) AS evidence FROM near LEFT JOIN pairs a ON a.left_word = lower(prev_word) AND a.right_word = lower(word) LEFT JOIN pairs b ON b.left_word = lower(word) AND b.right_word = lower(next_word)""")
def bigram_context_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = _marked(docs).withColumn("lower", F.lower("word"))
    return fuzzy.with_context(rows, dictionary.pair_counts_of_texts(docs), "lower").select("doc_id", "pos", F.round("context", 6).alias("context"), "evidence")


def _fix(name: str, rows: str, pick):
    right = _case("word", "t.right_word")

    @query(f"WITH {_WORDS}, t(wrong, right_word) AS (VALUES {rows}) SELECT doc_id, pos::INT AS pos, word, {right} AS fixed FROM words JOIN t ON lower(word) = t.wrong")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = fuzzy.replaced(words(table(spark, sf_dir, "documents")), pick(spark)).where(F.col("right").isNotNull())
        return found.select("doc_id", "pos", "word", T.match_case(F.col("word"), F.col("right")).alias("fixed"))

    for d in (QUERIES, ORACLE_SQL):
        d[name] = d.pop("run")


_fix("typo_table_fix", _TYPO_ROWS, plan.typos)
_fix("slang_table_fix", _SLANG_ROWS, plan.slang)


@query(f"WITH {_WORDS} SELECT doc_id, pos::INT AS pos, {_case('word', chr(39) + 'swap' + chr(39))} AS cased FROM words")
def case_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(table(spark, sf_dir, "documents")).select("doc_id", "pos", T.match_case(F.col("word"), F.lit("swap")).alias("cased"))


_WORD_PART = r"[\p{L}\p{M}\p{N}_]"


@query("""SELECT doc_id, md5(array_to_string(list_transform(runs, lambda x: CASE WHEN x = 'nd' THEN 'and' ELSE x END), '')) AS corrected_hash, len(list_filter(runs, lambda x: x = 'nd'))::BIGINT AS n_edits
 FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+') AS runs FROM documents)""")
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word replaced wherever it stands alone, in every text: no letter, mark, number or underscore on either side."""
    docs = table(spark, sf_dir, "documents")
    parts = F.split("text", rf"(?<!{_WORD_PART})nd(?!{_WORD_PART})", -1)
    ends = F.transform(parts, F.length)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0), lambda a, n: a + n) + (i - 1) * 2)
    edits = F.when(F.size(parts) > 1, F.transform(F.slice(starts, F.lit(1), F.size(parts) - 1), lambda s: F.struct(s.alias("char_start"), (s + 2).alias("char_end"), F.lit("and").alias("to")))).otherwise(F.array().cast("array<struct<char_start:int,char_end:int,to:string>>"))
    return docs.select("doc_id", F.md5(correct.edited(F.col("text"), edits)).alias("corrected_hash"), F.size(edits).cast("long").alias("n_edits"))


_DROP = "list_transform(range(1, length({0}) + 1), lambda i: {0}[:i - 1] || {0}[i + 1:])"


@query(f"""WITH {_WORDS}, v AS (SELECT DISTINCT lower(word) AS word, left(lower(word), 7) AS p FROM words), one AS (SELECT word, unnest(CASE WHEN length(p) > 1 THEN list_append({_DROP.format('p')}, p) ELSE [p] END) AS variant FROM v) SELECT DISTINCT word, variant FROM one""")
def delete_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = words(table(spark, sf_dir, "documents")).select(F.lower("word").alias("word")).distinct()
    return dictionary.variants(some, 1)


_PREFIX = f"unnest(CASE WHEN length(p) > 1 THEN list_append({_DROP.format('p')}, p) ELSE [p] END)"
_ONE_EDIT = f"""CASE WHEN typed = word THEN 0 WHEN length(typed) = length(word) THEN CASE WHEN len(d) = 1 OR len(d) = 2 AND d[2] = d[1] + 1 AND typed[d[1]] = word[d[2]] AND typed[d[2]] = word[d[1]] THEN 1 END
 WHEN length(typed) = length(word) + 1 AND list_contains({_DROP.format('typed')}, word) THEN 1 WHEN length(word) = length(typed) + 1 AND list_contains({_DROP.format('word')}, typed) THEN 1 END"""


@query(f"""WITH {_WORDS}, v AS (SELECT lower(word) AS word, count(*) AS freq FROM words GROUP BY 1), d AS (SELECT word FROM v WHERE freq >= 25),
 vt AS (SELECT word AS typed, {_PREFIX} AS variant FROM (SELECT word, left(word, 7) AS p FROM v)), vd AS (SELECT word, {_PREFIX} AS variant FROM (SELECT word, left(word, 7) AS p FROM d)),
 near AS (SELECT DISTINCT typed, word FROM vt JOIN vd USING (variant) WHERE abs(length(typed) - length(word)) <= 1),
 one AS (SELECT typed, word, ({_ONE_EDIT})::INT AS distance FROM (SELECT *, list_filter(range(1, length(typed) + 1), lambda i: typed[i] <> word[i]) AS d FROM near))
SELECT typed, word, distance FROM one WHERE distance IS NOT NULL""")
def fuzzy_candidates_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every text with the frequent words one edit away at most."""
    freq = stored(dictionary.from_tokens(words(table(ship(spark), sf_dir, "documents"))), "freq")
    return fuzzy.matches(freq.select(F.col("word").alias("typed")), freq.where("freq >= 25"), 1).select("typed", "word", "distance")


@query()
def fuzzy_candidates_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = words(table(spark, sf_dir, "conversations"), ("conv_id",)).select(F.lower("word").alias("typed"))
    return fuzzy.candidates(talk, stored(plan.vocabulary(spark, sf_dir, "en", 25), "vocabulary"), 2).select("typed", "word", "distance", F.round("cost", 6).alias("cost"), "freq", F.round("score", 6).alias("score"), "place")


@query()
def ranked_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    return correct.check(talk, plan.resources(spark, sf_dir), _settings()).select("doc_id", "pos", "from", "to", F.round("confidence", 6).alias("confidence"), "source", "auto")


@query()
def correct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return correct.fix_all(docs, plan.resources(spark, sf_dir), _settings()).select("doc_id", "corrected")


@query()
def protected_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(ship(spark), sf_dir, "documents")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = words(table(ship(spark), sf_dir, "documents")).select(F.lower("word").alias("word")).distinct()
    return some.select("word", F.array_join(stem_list("word"), ",").alias("stems"))


@query()
def word_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = words(table(spark, sf_dir, "documents")).select(F.lower("word").alias("word"))
    return correct.word_status(some, plan.resources(spark, sf_dir, context=False), _settings())


# --- search: the same formula in SQL -----------------------------------------------------------
_QUERY = "the thin"
_FTS_TERMS = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(groups: list[list[tuple[str, bool]]], columns: str) -> str:
    """columns of the notes that match one of the groups of (term, whether it is a prefix)."""
    terms = list(dict.fromkeys(t for g in groups for t in g))
    count = lambda c, t, p: f"len(list_filter({c}, lambda x: {'starts_with(x, ' + chr(39) + t + chr(39) + ')' if p else 'x = ' + chr(39) + t + chr(39)}))"
    cols = ", ".join(f"{count('tt', t, p)} AS t{i}, {count('bt', t, p)} AS b{i}" for i, (t, p) in enumerate(terms))
    stat = ", ".join(f"count(*) FILTER (WHERE t{i} + b{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"ln((total - n{i} + 0.5) / (n{i} + 0.5))"
    part = lambda i: f"CASE WHEN {idf(i)} > 0 THEN {idf(i)} ELSE 1e-6 END * (12.0 * t{i} + b{i}) * 2.2 / ((12.0 * t{i} + b{i}) + 1.2 * (0.25 + 0.75 * (len(tt) + len(bt)) / mean))"
    holds = [" AND ".join(f"t{terms.index(t)} + b{terms.index(t)} > 0" for t in g) for g in groups]
    score = " + ".join(f"CASE WHEN {h} THEN {' + '.join(part(terms.index(t)) for t in g)} ELSE 0 END" for h, g in zip(holds, groups, strict=True))
    return f"""WITH {_NOTES}, f AS (SELECT *, {_FTS_TERMS.format('title')} AS tt, {_FTS_TERMS.format('body')} AS bt FROM notes), c AS (SELECT *, {cols} FROM f),
 s AS (SELECT count(*) AS total, avg(len(tt) + len(bt)) AS mean, {stat} FROM c), found AS (SELECT *, -({score}) AS score FROM c, s WHERE ({' OR '.join(f'({h})' for h in holds)}) AND trashed_at IS NULL)
SELECT {columns} FROM found"""


_HIT = "id, title, pinned, round(score, 6) AS score"


def _found(spark: SparkSession, sf_dir: str, text: str, variants: tuple[str, ...] = ()) -> DataFrame:
    return search.search_index(plan.note_index(spark, sf_dir), text, variants, limit=None)


@query(_bm25_sql([[("the", False), ("thin", True)]], _HIT))
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, _QUERY).select("id", "title", "pinned", F.round("score", 6).alias("score"))


@query(_bm25_sql([[("ele", True)]], _HIT))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "Éle").select("id", "title", "pinned", F.round("score", 6).alias("score"))


@query(f"WITH {_NOTES} SELECT id, term, column_name, count(*)::BIGINT AS n FROM (SELECT id, unnest({_FTS_TERMS.format('title')}) AS term, 'title' AS column_name FROM notes UNION ALL SELECT id, unnest({_FTS_TERMS.format('body')}), 'body' FROM notes) GROUP BY 1, 2, 3")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.note_index(spark, sf_dir).postings.select("id", "term", F.col("column").alias("column_name"), F.size("positions").cast("long").alias("n"))


@query(_bm25_sql([[("thnd", True)], [("then", True)]], "id, title, round(score, 6) AS score"))
def search_typo_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query and its corrected form: a known typo becomes the word that was meant."""
    text = "thnd"
    one = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    fixed = correct.apply(one, correct.check(one, plan.resources(spark, sf_dir), _settings())).first().corrected  # one row
    return _found(spark, sf_dir, text, (fixed,) if fixed != text else ()).select("id", "title", F.round("score", 6).alias("score"))


_PIECE = "[^\\p{L}\\p{N}]*[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*"
#: Of the phrases `the` and `thin*`: every window of 12 terms is tried, wherever it begins.
_SNIPPET = f"""(SELECT CASE WHEN st > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(st + 1, least(st + 12, len(w)) + 1), lambda i: CASE WHEN i > st + 1 THEN regexp_extract(w[i], '^[^\\p{{L}}\\p{{N}}]*') ELSE '' END
  || CASE WHEN h[i] > 0 THEN '«' ELSE '' END || regexp_replace(w[i], '^[^\\p{{L}}\\p{{N}}]+', '') || CASE WHEN h[i] > 0 THEN '»' ELSE '' END), '') || CASE WHEN st + 12 < len(w) THEN '…' ELSE '' END
 FROM (SELECT w, h, greatest(least(coalesce(list_position(list_transform(range(1, len(h) + 1), lambda i: h[i] > 0 AND n[i] = list_max(n)), true) - 1, 0), len(w) - 12), 0) AS st
 FROM (SELECT w, h, list_transform(range(1, len(h) + 1), lambda i: len(list_distinct(list_filter(h[i:i + 11], lambda x: x > 0)))) AS n
 FROM (SELECT regexp_extract_all(body, '{_PIECE}') AS w, list_transform(bt, lambda x: CASE WHEN x = 'the' THEN 1 WHEN starts_with(x, 'thin') THEN 2 ELSE 0 END) AS h))))"""


@query("SELECT id, snippet, replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '«', '<mark>'), '»', '</mark>') AS html FROM (" + _bm25_sql([[("the", False), ("thin", True)]], f"id, {_SNIPPET} AS snippet") + ")")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of all notes that match."""
    return _found(spark, sf_dir, _QUERY).select("id", "snippet", T.highlight_snippet(F.col("snippet")).alias("html"))


# --- text utilities ------------------------------------------------------------------------------
_PAGED = "replace(text, chr(10), chr(10) || '=== halaman ===' || chr(10))"


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_pages, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(10))), '|')) AS pages_hash FROM documents")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line a page; a text that ends in a newline ends in an empty page."""
    docs = table(spark, sf_dir, "documents")
    paged = F.replace(F.col("text"), F.lit("\n"), F.lit("\n=== halaman ===\n"))
    return docs.select("doc_id", T.count_pages(paged).alias("n_pages"), F.md5(F.array_join(T.split_pages(paged), "|")).alias("pages_hash"))


def _re2(p: str) -> str:
    """Whitespace as the JVM reads it: a vertical tab counts."""
    return p.replace("'", "''")


_STRONG = " OR ".join(f"regexp_matches(t, '{_re2(p)}')" for p in T.STRONG_SIGNALS)
_WEAK = " + ".join(f"regexp_matches(t, '{_re2(p)}')::INT" for p in T.WEAK_SIGNALS)
_GUESS = "CASE " + " ".join(f"WHEN {' AND '.join(f'regexp_matches(t, ' + chr(39) + _re2(p) + chr(39) + ')' for p in ps)} THEN '{n}'" for n, ps in T.LANGUAGES) + " ELSE '' END"
_SNIPPETS = "snippets AS (SELECT 'd' || doc_id AS id, trim(text, ' ' || chr(10)) AS t FROM documents UNION ALL SELECT 'p' || page_id, trim(html, ' ' || chr(10)) FROM pages)"


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("t")))


@query(f"WITH {_SNIPPETS} SELECT id, length(t) >= 3 AND (({_STRONG}) OR ({_WEAK}) >= 2) AS is_code FROM snippets")
def code_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snippets(spark, sf_dir).select("id", T.looks_like_code(F.col("t")).alias("is_code"))


@query(f"WITH {_SNIPPETS} SELECT id, {_GUESS} AS language FROM snippets")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snippets(spark, sf_dir).select("id", T.detect_language(F.col("t")).alias("language"))


@query("""SELECT event_id, CASE WHEN diff < 45 THEN 'baru saja' WHEN diff < 90 THEN '1 menit' WHEN diff // 60 < 60 THEN (diff // 60) || ' menit' WHEN diff // 3600 < 24 THEN (diff // 3600) || ' jam' WHEN diff // 86400 = 1 THEN 'kemarin'
 WHEN diff // 86400 < 7 THEN (diff // 86400) || ' hari' WHEN diff // 86400 < 30 THEN (diff // 86400 // 7) || ' minggu' WHEN diff // 86400 < 365 THEN (diff // 86400 // 30) || ' bulan' ELSE (diff // 86400 // 365) || ' tahun' END AS age
FROM (SELECT event_id, greatest(1706000000 - floor(epoch(ts))::BIGINT, 0) AS diff FROM events)""")
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.relative_time(F.unix_timestamp("ts"), F.lit(1_706_000_000)).alias("age"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+'))::INT AS words, length(text)::INT AS chars FROM documents")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.words_and_chars(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", counts["words"].alias("words"), counts["chars"].alias("chars"))


@query("SELECT count(*)::BIGINT AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and nearest-rank percentiles of measured values."""
    rows = table(spark, sf_dir, "events")
    found = ranks.percentiles(rows, "value", (0.5, 0.99))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("*", *(F.lit(v).alias(n) for n, v in zip(("p50", "p99"), found, strict=True)))


@query("SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 1)::BIGINT AS n_good, count(*) FILTER (WHERE toxic = 1)::BIGINT AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional tallies, as the quality harness keeps them."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


_DIGIT = lambda one, five, ten, place: f"['', '{one}', '{one * 2}', '{one * 3}', '{one}{five}', '{five}', '{five}{one}', '{five}{one * 2}', '{five}{one * 3}', '{one}{ten}'][(n // {place}) % 10 + 1]"


@query(f"SELECT n, CASE WHEN n BETWEEN 1 AND 3999 THEN repeat('m', n // 1000) || {_DIGIT('c', 'd', 'm', 100)} || {_DIGIT('x', 'l', 'c', 10)} || {_DIGIT('i', 'v', 'x', 1)} ELSE n::VARCHAR END AS roman, CASE WHEN n BETWEEN 1 AND 3999 THEN n END AS value FROM (SELECT p_partkey AS n FROM part)")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n")).withColumn("roman", T.to_roman(F.col("n")))
    return rows.select("n", "roman", T.parse_roman(F.col("roman")).cast("bigint").alias("value"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, strftime(to_timestamp(floor(epoch(ts)))::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS said FROM events")
def time_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as RFC 3339 in the session's zone and read again."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_utc_timestamp(F.date_trunc("second", "ts"), "UTC").alias("ts"))
    said = T.format_time(F.unix_timestamp("ts"))
    return rows.select("event_id", said.alias("said")).withColumn("seconds", T.parse_time(F.col("said")))


@query("SELECT doc_id, md5(regexp_replace(text, '[^\\n\\t\\x20-\\x7e\\x{a1}-\\x{ff}]', '', 'g')) AS text_hash FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' texts have no typographic characters, so only what Latin-1 lacks goes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize_for_pdf(F.col("text"))).alias("text_hash"))


@query(f"WITH {_WORDS}, mine AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS word FROM part UNION SELECT 'the') SELECT doc_id, count(*)::BIGINT AS n FROM words WHERE lower(word) NOT IN (SELECT word FROM mine) GROUP BY doc_id")
def personal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a personal dictionary doesn't know, counted for each document."""
    mine = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(spark.createDataFrame([("the",)], "word string"))
    return fuzzy.unknown_to(words(table(spark, sf_dir, "documents")), mine).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, replace(replace(replace(replace(replace('«' || title || '»', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '«', '<mark>'), '»', '</mark>') AS html FROM (SELECT doc_id, {_TITLE} AS title FROM documents)")
def snippet_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = T.derive_title(F.col("text"), T.TITLE_FALLBACK)
    return table(spark, sf_dir, "documents").select("doc_id", T.highlight_snippet(F.concat(F.lit("«"), title, F.lit("»"))).alias("html"))


@query("SELECT p_partkey, p_name || '|' || p_type AS tags FROM part")
def tag_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('["'), "p_name", F.lit("\", '"), "p_type", F.lit("', ]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.parse_tags(raw), "|").alias("tags"))


@query("SELECT p_partkey, repeat('=', (58 - length(l)) // 2) || l || repeat('=', 58 - length(l) - (58 - length(l)) // 2) AS banner FROM (SELECT p_partkey, ' Halaman ' || p_partkey || ' ' AS l FROM part)")
def page_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.page_banner(F.col("p_partkey")).alias("banner"))


@query(f"WITH {_NOTES} SELECT id AS note_id, md5(body) AS body_hash, 1800000000::BIGINT AS saved_at FROM notes")
def note_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.versions(plan.notes(spark, sf_dir), F.lit(1_800_000_000)).select("note_id", F.md5("body").alias("body_hash"), "saved_at")


@query(f"WITH {_NOTES}, old AS (SELECT * FROM notes WHERE NOT archived), new AS (SELECT * FROM notes WHERE trashed_at IS NULL) SELECT id FROM old FULL JOIN new USING (id) WHERE old.content_hash IS DISTINCT FROM new.content_hash")
def changed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to index anew between two states: what only one of them has, or has with other content."""
    rows = plan.notes(spark, sf_dir)
    return store.changed_ids(rows.where("NOT archived"), store.live(rows))


# --- files -----------------------------------------------------------------------------------------
@query(f"WITH {_NOTES} SELECT id, true AS same FROM notes")
def front_matter_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes rendered and parsed again, and whether anything changed: each note stays in its row beside its file."""
    rows = plan.notes(ship(spark), sf_dir)
    fields = ("id", "title", "body", "created_at", "updated_at", "pinned", "archived", "tags")
    files = note_files.rendered(rows).select("path", "content", F.lit(0).cast("bigint").alias("modified"), F.struct(*fields).alias("was"))
    back = note_files.parse(files, kept=("was",))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"was.{c}").eqNullSafe(F.col(c))
    return back.select("was.id", same.alias("same"))


@query(f"WITH {_NOTES} SELECT id || '|' || title AS name, md5(CASE WHEN lower(trim(regexp_replace(trim(string_split(body, chr(10))[1]), '^#+', ''))) = lower(title) THEN '' ELSE title || chr(10) || chr(10) END || trim(body, chr(10))) AS content_hash FROM notes")
def export_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.notes(spark, sf_dir)
    return rows.select(F.concat_ws("|", "id", "title").alias("name"), F.md5(export.as_txt(F.col("title"), F.col("body"))).alias("content_hash"))


@query()
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and first bytes of each note in each format."""
    rows = plan.notes(ship(spark), sf_dir)
    out = None
    for kind in ("md", "txt", "docx", "pdf"):
        made = export.exported(rows, kind).select("path", F.lit(kind).alias("format"), F.octet_length("content").alias("n_bytes"), F.hex(F.substring("content", 1, 4)).alias("head"))
        out = made if out is None else out.unionByName(made)
    return out


from lexiloom import harness_queries, unit_queries  # noqa: E402, F401  they add their queries to the two tables
