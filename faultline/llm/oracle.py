"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: Words of a text with A-Z lower-cased.
WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')"
)


def jaccard_sql(docs: str, n: int, num: int, den: int) -> str:
    """Rows (doc_id, n_shingles, component_id) of the n-word Jaccard self-join of ``docs``."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM {docs}),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
  WHERE greatest(a.n, b.n) * {num} <= least(a.n, b.n) * {den}
  GROUP BY a.rep, b.rep, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
  CAST(coalesce(least(c.rep, m), d.doc_id) AS BIGINT) AS component_id
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN comp ON comp.a = c.rep"""


SQL = {"op3_ngram_jaccard": jaccard_sql("documents", 3, 9, 10)}

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL["op7_source_mix"] = f"""
WITH sized AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source),
filled AS (SELECT *, sum(n) OVER () AS t, sum(w) OVER () AS ws,
  coalesce(sum(3 * n) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  coalesce(sum(w) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shut FROM sources),
level AS (SELECT arg_min(v, 3.0 * n / w) AS v FROM (SELECT *, CAST(t - used AS DOUBLE) / CAST(ws - shut AS DOUBLE) AS v FROM filled)
  WHERE v * w <= 3 * n),
plan AS (SELECT source, n AS source_size, least(v * w, CAST(3 * n AS DOUBLE)) AS target FROM sources, level),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan),
run AS (SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, target - whole * source_size AS rest,
  sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
copies AS (SELECT *, whole + CASE WHEN middle < rest THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM copies"""

_UNIT = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings)"""

SQL["op1_pivot_near_dedup"] = f"""
WITH RECURSIVE {_UNIT},
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND array_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, m) AS BIGINT) AS component_id,
  vec_id = least(vec_id, m) AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""

SQL["op6_ann_collision"] = f"""
WITH {_UNIT},
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, array_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5"""

SQL["op2_url_cascade"] = """
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS i
  FROM p JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND i = 1"""

_BIT = "list_reduce(list_prepend({0}, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: CAST(ord(ch) AS BIGINT))), "
    "lambda acc, ch: " + _BIT.format("xor(acc, ch)") + "), 4294967295)"
)


def _step(state: str, edit: str, cost: str, line: str | None = None) -> str:
    """The survivor of ``state`` after one more edit, with the line that it adds to the repaired text."""
    text = f"{state}.r" if line is None else f"CASE WHEN {state}.r IS NULL THEN {line} ELSE {state}.r || chr(10) || {line} END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {text}}}"


def _least(*paths: str) -> str:
    return "list_min([" + ", ".join(paths) + "])"


_KEPT = "CASE WHEN gone OR role[1:1] <> '{0}' THEN 1000000 ELSE 3 * cut END"
_REROLED = "CASE WHEN gone THEN 1000000 ELSE 3 + 3 * cut END"
_LINE, _USER, _ASSISTANT = "(role || ':' || text)", "('user:' || text)", "('assistant:' || text)"
_NO = "{'c': 10000000, 'a': '', 'r': CAST(NULL AS VARCHAR)}"


def _inserts(a: str, b: str, c: str, d: str) -> str:
    """The columns s, y, u, w (nothing yet, after s, u, a) with inserted turns."""
    u = _least(c, *(_step(x, "I", "3", "'user:'") for x in (a, b, d)))
    return f"{a} AS s, {b} AS y, {u} AS u, {d} AS w"


SQL["op12_conversation_repair"] = f"""
WITH RECURSIVE crc AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE k <> 0),
seen AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
marked AS (SELECT conv_id, turn, role, text, CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN core[-1:] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS prev FROM seen),
turns AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM marked),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND prev[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY conv_id),
first AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'r': CAST(NULL AS VARCHAR)}} AS s, {_NO} AS y, {_NO} AS u, {_NO} AS w FROM counts),
walk AS (
  SELECT conv_id, i, s, y, u, {_least("w", _step("u", "I", "3", "'assistant:'"))} AS w FROM (SELECT conv_id, i, {_inserts("s", "y", "u", "w")} FROM first)
  UNION ALL
  SELECT conv_id, i, s, y, u, {_least("w", _step("u", "I", "3", "'assistant:'"))} AS w FROM (SELECT conv_id, i, {_inserts("s", "y", "u", "w")} FROM (
    SELECT t.conv_id, t.i, {_step("s", "D", "4")} AS s,
      {_least(_step("y", "D", "4"), _step("s", "K", _KEPT.format("s"), _LINE))} AS y,
      {_least(_step("u", "D", "4"), *(_step(x, "K", _KEPT.format("u"), _LINE) for x in "syw"), *(_step(x, "R", _REROLED, _USER) for x in "syw"))} AS u,
      {_least(_step("w", "D", "4"), _step("u", "K", _KEPT.format("a"), _LINE), _step("u", "R", _REROLED, _ASSISTANT))} AS w
    FROM walk JOIN turns t ON t.conv_id IS NOT DISTINCT FROM walk.conv_id AND t.i = walk.i + 1))),
best AS (SELECT c.*, {_least("s", "w")} AS b FROM walk JOIN counts c ON c.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = c.n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

SQL["op11_bitsliced_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
q AS (SELECT row_number() OVER () AS r, item_id, {_TERMS} AS t FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
norms AS (SELECT r, doc_id, 100 - 75 + ((75 * len(t) * n) // l) AS m FROM d, total WHERE len(t) > 0),
asked AS (SELECT r AS q, item_id, term, count(*) AS times FROM (SELECT r, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
scores AS (SELECT q, item_id, tf.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN norms ON norms.r = tf.r GROUP BY q, item_id, tf.r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
