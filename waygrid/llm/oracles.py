"""DuckDB SQL of the op queries that SQL can express."""

from __future__ import annotations

import re

from waygrid.llm.quality_rules import BOILERPLATE

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS src FROM s0),
s2 AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s1),
s3 AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS left_weight
  FROM s2 WINDOW f AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, weight * CAST(left_words AS DOUBLE) / CAST(left_weight AS DOUBLE) > cap AS over_cap FROM s3),
level AS (SELECT left_words, left_weight FROM s4 WHERE NOT over_cap ORDER BY cap / weight, src LIMIT 1),
goal AS (
  SELECT s4.source, s4.src, s4.source_size, s4.cap,
         CASE WHEN over_cap THEN CAST(cap AS DOUBLE) ELSE weight * CAST(level.left_words AS DOUBLE) / CAST(level.left_weight AS DOUBLE) END AS target
  FROM s4 LEFT JOIN level ON true),
t AS (SELECT sum(size)::BIGINT AS total, greatest(1, least(4096, sum(size)::BIGINT // 65536)) AS words FROM d),
quotient AS (
  SELECT src, row_number() OVER (ORDER BY target / (2 * a + 1) DESC, src) AS nth
  FROM goal, t, range(0, CAST(ceil(target / words) AS BIGINT) + 40) AS r(a) WHERE target > 0),
seat AS (SELECT src, (row_number() OVER (ORDER BY src) - 1) % 8 AS shard FROM quotient, t WHERE nth <= total // words),
turn AS (SELECT src, shard, row_number() OVER (PARTITION BY src ORDER BY shard) - 1 AS nth FROM seat),
block AS (
  SELECT src, block, count(*) OVER (PARTITION BY src) AS n_blocks, row_number() OVER (PARTITION BY src ORDER BY md5('mix-1|' || src || '|' || block)) - 1 AS spot
  FROM goal, t, range(0, CAST(ceil(source_size / words) AS BIGINT)) AS r(block)),
chosen AS (SELECT block.src, block, shard FROM block JOIN turn ON turn.src = block.src AND turn.nth % n_blocks = spot AND turn.nth < 3 * n_blocks),
placed AS (
  SELECT d.doc_id, d.place, d.size, goal.src, goal.source_size, goal.target,
         coalesce(sum(d.size) OVER (PARTITION BY goal.src ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER (PARTITION BY goal.src ORDER BY d.place, d.size) AS nth
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
part AS (
  SELECT p.src, p.nth, c.shard, sum(least(before + size, (block + 1) * words) - greatest(before, block * words))::BIGINT AS part_words
  FROM placed p CROSS JOIN t JOIN chosen c ON c.src = p.src AND p.size > 0 AND c.block BETWEEN p.before // words AND (p.before + p.size - 1) // words
  GROUP BY ALL),
took AS (
  SELECT src, nth, doc_id, place, size, source_size, target, coalesce(sum(part_words), 0)::BIGINT AS taken,
         concat_ws(',', SHARD_SUMS) AS shard_words
  FROM placed LEFT JOIN part USING (src, nth) GROUP BY ALL),
share AS (SELECT *, CASE WHEN size > 0 THEN taken * 1048576 // size ELSE 0 END AS share FROM took),
ran AS (SELECT *, sum(share) OVER (PARTITION BY src ORDER BY place, share ROWS UNBOUNDED PRECEDING) + 524288 AS upto FROM share)
SELECT doc_id, place, size, source_size, target, taken, CAST(upto // 1048576 - (upto - share) // 1048576 AS INTEGER) AS copies, shard_words
FROM ran
""".replace("SHARD_SUMS", ", ".join(f"coalesce(sum(part_words) FILTER (shard = {k}), 0)::BIGINT" for k in range(8)))

OP2 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS most FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.n, k.line, coalesce(k.doc_id <> g.most, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_PHRASES = "|".join(re.escape(x) for x in BOILERPLATE)
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SYMBOLS = "len(regexp_replace({0}, '[^#*$%&|<>]', '', 'g'))"
OP9 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
l0 AS (SELECT rid, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT *, {_WORDS.format('line')} AS w FROM l0),
l2 AS (SELECT *, len(w) AS k, len(list_aggregate(w, 'string_agg', '')) AS chars, len(regexp_replace(line, '[^|•·›→]', '', 'g')) AS bars, {_SYMBOLS.format('line')} AS sym, row_number() OVER (PARTITION BY rid, line ORDER BY n) AS nth FROM l1 WHERE len(w) > 0),
wins AS (SELECT rid, n, w[i + 1 : i + 64] AS v FROM l1, range(0, len(w), 64) AS z(i) WHERE len(w) > 0),
bad AS (SELECT rid, n, sum(len(v)) AS bad_words FROM wins WHERE (len(v) >= 8 AND len(list_distinct(v)) * 3 <= len(v)) OR regexp_matches(lower(list_aggregate(v, 'string_agg', ' ')), '{_PHRASES.replace(chr(39), chr(39) * 2)}') GROUP BY rid, n),
l AS (SELECT *, nth > 1 OR (bars >= 2 AND k <= bars * 4) OR sym * 4 >= k OR (k >= 5 AND line = upper(line) AND line <> lower(line))
        OR (k >= 12 AND NOT regexp_matches(line, '[.!?…。！？]')) OR coalesce(bad_words, 0) * 2 > k AS fails FROM l2 LEFT JOIN bad USING (rid, n)),
s AS (SELECT rid, sum(chars) AS word_chars, count(*) FILTER (nth > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost, count(*) FILTER (fails) AS n_lost_lines FROM l GROUP BY rid),
w AS (SELECT rid, {_WORDS.format('text')} AS w FROM d),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, range(1, len(w) - 1) AS z(i)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times FROM g) WHERE times > 1),
p AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM h, range(3) AS z(j) GROUP BY rid),
f AS (
  SELECT d.doc_id, len(w.w) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, {_SYMBOLS.format('d.text')} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lost, 0)::BIGINT AS lost, coalesce(n_lost_lines, 0) AS n_lost_lines
  FROM d JOIN w USING (rid) LEFT JOIN s USING (rid) LEFT JOIN p USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept, n_lost_lines
FROM f
"""
