"""DuckDB SQL with the rows of the queries that SQL can express, written without the methods above."""

from __future__ import annotations

from rangeloom.llm import quality, sharding

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM d)),
words AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, word, lead(word, 1) OVER (PARTITION BY r ORDER BY i) AS second, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS third FROM w),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, second, third) AS n FROM g WHERE third IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n, len(regexp_extract_all(line, {_str(quality.PUNCTUATION)})) AS p, len(regexp_extract_all(line, {_str(quality.MARKS)})) AS m FROM l WHERE regexp_matches(line, '{WORD}')),
lf AS (SELECT r, line, (n >= 2 AND p > {quality.PUNCTUATION_SHARE} * length(line)) OR (m >= {quality.NAVIGATION_MARKS} AND 5 * m >= n)
         OR (n <= {quality.FRAGMENT_WORDS} AND NOT regexp_matches(line, {_str(quality.END)})) OR regexp_matches(lower(line), {_str("|".join(quality.BOILERPLATE))}) AS fails FROM lw),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars, coalesce(sum(length(line)) FILTER (WHERE fails), 0) AS lost_chars FROM lf GROUP BY r),
s AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(line_chars, 0)::BIGINT AS line_chars
      FROM d LEFT JOIN words USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= {quality.LOST_SHARE} * line_chars AS kept
FROM s"""

OP3 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT r, unnest(list_transform(range(1, len(words) - 33), lambda i: array_to_string(words[i:i + 34], ' '))) AS win, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
k AS (SELECT r, i FROM w JOIN (SELECT win FROM w GROUP BY win HAVING count(*) > 1) USING (win)),
gone AS (SELECT DISTINCT r, i + k AS i FROM k, (SELECT unnest(range(0, 35)) AS k)),
stay AS (SELECT d.r, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS kept FROM
  (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d) x JOIN d USING (r) LEFT JOIN gone g ON g.r = x.r AND g.i = x.i WHERE g.i IS NULL GROUP BY d.r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN stay USING (r)"""

OP4 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id"""

_ESCAPED = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
OP5 = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""


def mixing_sql(documents: str = "documents") -> str:
    """The mix of op6: the shares are refilled until no target is above its bound."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
turn AS (
  SELECT 0 AS n, source, source_size, w, false AS stopped FROM s
  UNION ALL
  SELECT n + 1, source, source_size, w, stopped OR w * (total - bound) > 3 * source_size * others FROM (
    SELECT *, sum(source_size) OVER ()::HUGEINT AS total, coalesce(sum(3 * source_size) FILTER (WHERE stopped) OVER (), 0)::HUGEINT AS bound, coalesce(sum(w) FILTER (WHERE NOT stopped) OVER (), 0)::HUGEINT AS others FROM turn)
  WHERE n < (SELECT count(*) FROM s)),
final AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) FILTER (WHERE stopped) OVER (), 0) AS bound, sum(w) FILTER (WHERE NOT stopped) OVER () AS others FROM turn WHERE n = (SELECT max(n) FROM turn)),
t AS (SELECT source, source_size, CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE (w * (total - bound))::DOUBLE / others::DOUBLE END AS target FROM final),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (floor(rate) + (coin < rate - floor(rate))::INT)::BIGINT AS copies, size * (floor(rate) + (coin < rate - floor(rate))::INT)::BIGINT AS taken FROM r"""


OP6 = mixing_sql()

def sharding_sql(limit: int) -> str:
    """The shortest prefix of each hash that fits limit, from the sums of all prefixes."""
    return f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT h, n AS depth, h >> (60 - n) AS prefix, size FROM d, (SELECT unnest(range(0, 61)) AS n)),
b AS (SELECT depth, prefix FROM p GROUP BY depth, prefix HAVING sum(size) <= {limit} OR count(*) = 1),
f AS (SELECT h, min(depth) AS depth FROM p JOIN b USING (depth, prefix) GROUP BY h)
SELECT doc_id, size, right(lpad(bin(h), 60, '0'), 60)[1:f.depth] AS shard, f.depth::INT AS depth FROM d JOIN f USING (h)"""


OP10 = sharding_sql(sharding.SHARD_BYTES)
