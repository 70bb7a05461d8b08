"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations


ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + ASCII_LOWER.format("coalesce({}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + 13], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT DISTINCT r, s, n, item FROM places JOIN windows USING (n, phrase)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM met) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
  cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP9 = """
WITH RECURSIVE s AS (SELECT DISTINCT coalesce(source, '') AS source FROM documents),
u AS (SELECT source, CASE WHEN source = 'src0' AND count(*) OVER () > 1 THEN 4 ELSE 1 END AS units,
  row_number() OVER (ORDER BY source) AS i FROM s),
a AS (SELECT list(units ORDER BY i) AS units, cast(sum(units) AS bigint) AS period FROM u),
edf AS (
  SELECT 0 AS t, list_transform(units, lambda v: 0::bigint) AS done, NULL::bigint AS p, NULL::bigint AS k, units, period FROM a
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, j: CASE WHEN j = p2 THEN d + 1 ELSE d END), p2, done[p2], units, period
  FROM (SELECT *, list_min(list_transform(
      list_filter(range(1, len(units) + 1), lambda j: done[j] < units[j] AND done[j] * period // units[j] <= t),
      lambda j: {'due': ((done[j] + 1) * period + units[j] - 1) // units[j], 'i': j})).i AS p2
    FROM edf WHERE t < period)),
slots AS (SELECT t - 1 AS slot, p AS i, k, period FROM edf WHERE t > 0),
docs AS (
  SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '')
    ORDER BY md5(coalesce(cast(doc_id AS varchar), '')), doc_id) - 1 AS ordinal FROM documents),
placed AS (
  SELECT doc_id, docs.source, ordinal // 16 AS mix_block, ((ordinal // 16) // units) * period + slot AS mix_slot, ordinal
  FROM docs JOIN u ON docs.src = u.source JOIN slots ON slots.i = u.i AND slots.k = (ordinal // 16) % units)
SELECT doc_id, source, cast(mix_block AS bigint) AS mix_block, cast(mix_slot AS bigint) AS mix_slot,
  cast(row_number() OVER (ORDER BY mix_slot, ordinal) - 1 AS bigint) AS mix_position
FROM placed
"""

OP2 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS body,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c:
    substr('0000000100100011010001010110011110001001101010111100110111101111',
      4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS b FROM p)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * cast(substr(b, 5 * i + 1, 1) AS int) + 8 * cast(substr(b, 5 * i + 2, 1) AS int)
    + 4 * cast(substr(b, 5 * i + 3, 1) AS int) + 2 * cast(substr(b, 5 * i + 4, 1) AS int)
    + cast(substr(b, 5 * i + 5, 1) AS int), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM bits
"""


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT i, s, count(*) OVER (PARTITION BY i, phrase) AS met
  FROM (SELECT i, s, array_to_string(w[s : s + 2], ' ') AS phrase FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS s FROM d))),
again AS (SELECT i, count(DISTINCT p) AS n FROM (SELECT i, unnest(range(s, s + 3)) AS p FROM windows WHERE met > 1) GROUP BY i),
lines AS (
  SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT i, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i),
counts AS (
  SELECT doc_id, source, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    cast(coalesce(n_lines, 0) AS bigint) AS n_lines, cast(coalesce(n_dup_lines, 0) AS bigint) AS n_dup_lines,
    cast(coalesce(again.n, 0) AS bigint) AS n_repeat_words
  FROM d LEFT JOIN again USING (i) LEFT JOIN lines USING (i)),
failures AS (
  SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS rep,
    100 * n_symbols > 10 * n_words AS sym, 100 * n_dup_lines > 30 * n_lines AS dup FROM counts),
hosts AS (
  SELECT source, unnest(['few', 'rep', 'sym', 'dup']) AS rule, count(*)::double AS n,
    unnest([sum(few::int), sum(rep::int), sum(sym::int), sum(dup::int)])::double AS f
  FROM failures WHERE source IS NOT NULL GROUP BY source),
sums AS (
  SELECT rule, sum(n) AS every, sum(f) / sum(n) AS mean, sum(f * f / n) AS squares, sum(n * n) AS sizes, count(*) - 1 AS spare
  FROM hosts GROUP BY rule),
alikes AS (
  SELECT rule, mean, CASE WHEN mean * (1 - mean) * (every - sizes / every - spare) > 0
    THEN (squares - every * mean * mean - mean * (1 - mean) * spare) / (mean * (1 - mean) * (every - sizes / every - spare))
    ELSE 0 END AS alike FROM sums),
priors AS (SELECT rule, mean, CASE WHEN alike <= 1 / 1000001.0 THEN 1e6 ELSE greatest(1.0, 1 / alike - 1) END AS strength FROM alikes),
rejected AS (
  SELECT DISTINCT source FROM hosts JOIN priors USING (rule) WHERE round((f + mean * strength) / (n + strength), 9) >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed,
  NOT (few OR rep) AND rejected.source IS NULL AS kept, rejected.source IS NOT NULL AS host_rejected
FROM failures LEFT JOIN rejected ON failures.source = rejected.source
"""

OP12 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, range(1, 6) AS sizes(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT lang, phrase, m, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r, n, 1000::hugeint * a * n // (h.f::hugeint * t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = rest
  JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ones AS (
  SELECT lang, array_to_string(w[s : s + j - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, j, unnest(range(1, m - j + 2)) AS s FROM c, range(2, 5) AS sizes(j) WHERE j < m) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ones USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, cast(n AS bigint) AS n, cast(score AS bigint) AS score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op5_decontamination": OP5, "op9_pfair_mixing": OP9, "op11_host_rules": OP11, "op12_collocations": OP12}
