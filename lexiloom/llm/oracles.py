"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from lexiloom.llm import quality

_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _failed(*names: str) -> str:
    """A mask of the rules' conditions."""
    return " + ".join(f"CASE WHEN {quality.RULES[n][1]} THEN {1 << quality.RULES[n][0]} ELSE 0 END" for n in names)


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_PLAIN} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
hashed AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM hashed) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, ({_failed(*quality.RULES)})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {quality.BASE.mask}) <> 0 AS base_failed, (fail_bits & {quality.BASE.mask | quality.POLICIES[quality.DEFAULT].mask}) = 0 AS kept, fail_bits FROM f
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, hash(unnest(x)) AS h FROM s),
both_sides AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS o FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3, 4),
link AS (SELECT u, v FROM both_sides WHERE 100 * o >= 75 * (nu + nv - o)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN link l ON r.other = l.u)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM pat),
win AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, m, i, item_id FROM win JOIN pat USING (m, s)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: The checksum that chooses the damage, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The edits by a forward search: for every row and state of the grammar (0 nothing, 1 system, 2 user, 3 assistant) the least cost and, of that, the least letters.
CONVERSATIONS = rf"""
WITH RECURSIVE jump(s, t, c, x) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
move(t, u, role, x) AS (VALUES (0, 1, 's', 'K'), (0, 2, 'u', 'K'), (1, 2, 'u', 'K'), (2, 3, 'a', 'K'), (3, 2, 'u', 'K'), (0, 2, '', 'R'), (1, 2, '', 'R'), (2, 3, '', 'R'), (3, 2, '', 'R'), (0, 0, '', 'D'), (1, 1, '', 'D'), (2, 2, '', 'D'), (3, 3, '', 'D')),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {_CRC32} % 20 AS kind FROM keyed),
after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS time FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i, rtrim(text, {_BLANKS}) AS trimmed FROM after),
rows_ AS (SELECT *, left(role, 1) AS r, CASE WHEN trimmed = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(trimmed, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault FROM numbered),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM rows_) GROUP BY conv_id),
walk(conv_id, i, s, best) AS (SELECT conv_id, 0, 0, '000000000' FROM facts
  UNION ALL SELECT w.conv_id, w.i + 1, m.u, min(printf('%09d', left(w.best, 9)::BIGINT + j.c + CASE m.x WHEN 'K' THEN 0 WHEN 'R' THEN 1 ELSE 2 END + CASE WHEN m.x <> 'D' AND r.fault = 1 THEN 5 ELSE 0 END) || substr(w.best, 10) || j.x || m.x)
  FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN jump j ON j.s = w.s JOIN move m ON m.t = j.t AND (m.x = 'D' OR r.fault < 2) AND (m.x <> 'K' OR m.role = r.r) GROUP BY w.conv_id, w.i, m.u),
done AS (SELECT conv_id, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM (SELECT w.conv_id, min(printf('%09d', left(w.best, 9)::BIGINT + j.c) || substr(w.best, 10) || j.x) AS best FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN jump j ON j.s = w.s AND j.t IN (0, 3) GROUP BY w.conv_id)),
letter AS (SELECT conv_id, j, audit[j] AS x FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM done)),
placed AS (SELECT *, count(*) FILTER (x <> 'I') OVER w AS i, count(*) FILTER (x <> 'D') OVER w AS o FROM letter WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
kept AS (SELECT p.conv_id, o, x, CASE WHEN x = 'I' THEN '' ELSE text END AS text, role, bool_or(x = 'K' AND r = 's') OVER (PARTITION BY p.conv_id) AS headed FROM placed p LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE x <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (o - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o)) AS h FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SQL = {"op2_quality": QUALITY, "op5_jaccard_join": JACCARD, "op6_decontaminate": DECONTAMINATION, "op13_conversation_repair": CONVERSATIONS}
