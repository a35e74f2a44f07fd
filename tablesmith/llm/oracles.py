"""DuckDB SQL of the queries that SQL can express (tables are views named like the files)."""

from __future__ import annotations

from tablesmith.llm.mixing import BITS, BLOCK_WORDS, MAX_REPEAT, WEIGHTS
from tablesmith.llm.secrets import BASE, RULES

WORD = r"[^\x20\x09-\x0D]+"

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, row_number() OVER w AS place,
    length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g'))
    + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 14 AS written
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
u AS (
  SELECT *, sum(written) OVER (PARTITION BY conv_id ORDER BY place) AS upto,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
n AS (SELECT row_number() OVER () AS k, * FROM d),
win AS (
  SELECT k, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM n)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY k),
s AS (
  SELECT n.k, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper, len(regexp_extract_all(t, '\p{{L}}'))::BIGINT AS n_letters
  FROM n LEFT JOIN cov ON n.k = cov.k),
r AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > n_letters OR n_lines < 2 * n_dup_lines
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM r
"""


def _secret_spans(n: int) -> str:
    rule = RULES[n]
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT k, {n} AS kind_no, '{rule.kind}' AS kind,
    (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start,
    length(m[i])::BIGINT AS size
  FROM (SELECT k, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT k, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
      string_split_regex(t, '{pattern}') AS p FROM d) WHERE len(m) > 0)
  WHERE length(g[i]) >= {rule.min_length}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_secret_spans(n) for n in range(len(RULES)))}),
a AS (
  SELECT k, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
    count(*) FILTER (kind_no = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, kind_no) FILTER (kind_no < {len(BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, kind_no) AS spans
  FROM s GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.k = a.k
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
post AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) GROUP BY k, t),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
freq AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM post, total GROUP BY t, n_docs),
q AS (SELECT i, item_id, t, count(*) AS times FROM (
  SELECT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY i, item_id, t),
size AS (SELECT k, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
s AS (
  SELECT i, item_id, doc_id, k, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN post USING (t) JOIN freq USING (t) JOIN size USING (k) GROUP BY i, item_id, doc_id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

_W = "CASE " + " ".join(f"WHEN (place - 1) % {len(WEIGHTS)} = {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"

MIX = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')))[:15])::BIGINT AS o
  FROM documents),
src AS (
  SELECT *, {_W} AS w FROM (
    SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source)),
total AS (SELECT sum(s) AS t, sum(w)::HUGEINT AS w FROM src),
fill AS (  -- money and weight left once the j tightest caps are taken
  SELECT t - coalesce(sum(c) OVER o, 0) AS money, total.w - coalesce(sum(src.w) OVER o, 0) AS weight, c * 1.0 / src.w AS tight, c, src.w
  FROM (SELECT *, {MAX_REPEAT} * s AS c FROM src) src, total
  WINDOW o AS (ORDER BY c * 1.0 / src.w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT money, weight FROM fill WHERE c * weight > w * money ORDER BY tight LIMIT 1),
goal AS (
  SELECT source, place, s, CASE WHEN {MAX_REPEAT} * s * weight <= w * money THEN ({MAX_REPEAT} * s)::DOUBLE
    ELSE (w * money)::DOUBLE / weight::DOUBLE END AS target FROM src, level),
want AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM goal),
need AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE (words // s) * ((s + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})
    + ((words % s) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} END::HUGEINT AS slots FROM want),
plan AS (
  SELECT *, greatest(1, (s + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}) AS blocks, sum(slots) OVER () AS length,
    sum(slots) OVER (ORDER BY place) AS upto FROM need),
bound AS (
  SELECT *, ((upto - slots) * {1 << BITS}::HUGEINT) // length AS lo, (upto * {1 << BITS}::HUGEINT) // length AS hi FROM plan WHERE length > 0),
point AS (
  SELECT i, list_sum(list_transform(range({BITS}), lambda b: ((i >> b) & 1) << ({BITS - 1} - b)))::HUGEINT AS x
  FROM range((SELECT coalesce(max(length), 0)::BIGINT FROM plan)) r(i)),
ranked AS (
  SELECT place, row_number() OVER (PARTITION BY place ORDER BY i) - 1 AS r FROM point JOIN bound ON x >= lo AND x < hi),
slot AS (  -- what the schedule gives, without the rest, and what it leaves short
  SELECT place, r FROM ranked JOIN bound USING (place) WHERE r < slots
  UNION ALL SELECT place, unnest(range(got::BIGINT, slots::BIGINT)) AS r FROM bound
    JOIN (SELECT place, count(r) AS got FROM bound LEFT JOIN ranked USING (place) GROUP BY place) USING (place)),
part AS (
  SELECT place, (r % blocks) * {BLOCK_WORDS} AS lo,
    least((r % blocks + 1) * {BLOCK_WORDS}, CASE WHEN r // blocks = words // s THEN words % s ELSE s END) AS hi
  FROM slot JOIN plan USING (place) WHERE s > 0),
doc AS (
  SELECT d.*, place, s, target, sum(size) OVER (PARTITION BY place ORDER BY o, doc_id, size, k) - size AS pos
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
taken AS (
  SELECT k, sum(least(hi, pos + size) - greatest(lo, pos)) AS n
  FROM doc JOIN part ON doc.place = part.place AND hi > pos AND lo < pos + size GROUP BY k)
SELECT doc_id, size, s::BIGINT AS source_size, target, coalesce(n, 0)::BIGINT AS taken FROM doc LEFT JOIN taken USING (k)
"""
