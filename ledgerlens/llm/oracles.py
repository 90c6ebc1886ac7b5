"""SQL (DuckDB) for the queries of this subpackage that SQL can express, over the same whole tables."""

from __future__ import annotations

#: The operators' limits and patterns, written out here so that the SQL checks them.
CURRICULUM_SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SYMBOLS = "[#*$%&|<>]"
MAX_LOSS, BOILERPLATE_MAX_WORDS = 0.4, 20
BOILERPLATE = (
    "all rights reserved|copyright|released under|licensed under|terms of (use|service)|privacy policy|cookie|"
    "enable javascript|lorem ipsum|subscribe|newsletter|sign (in|up)|log ?in|click here|read more|share this|powered by"
)
W = r"[^\x20\x09-\x0D]+"


def _case(values) -> str:
    return "CASE rk % 3 " + " ".join(f"WHEN {i} THEN CAST({v} AS DOUBLE)" for i, v in enumerate(values)) + " END"


_COPIES = ", ".join(f"greatest(0, least(size, quota - ({c} * source_size + lo)))" for c in range(3))

OP1 = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         CAST(coalesce(len(regexp_extract_all(text, '{W}')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) - 1 AS rk FROM d GROUP BY src),
w AS (SELECT *, CAST(rk % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, src) AS turn,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
             coalesce(sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_weight,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS total_weight
      FROM w),
l AS (SELECT *, CAST(total - full_size AS DOUBLE) / (total_weight - full_weight) AS level FROM o),
t AS (SELECT src, rk, source_size, weight, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, turn) FROM l WHERE level * weight <= cap)) AS target
      FROM l),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS quota, weight * {_case([x[0] for x in CURRICULUM_SHAPES])} AS r0,
             weight * {_case([x[1] for x in CURRICULUM_SHAPES])} AS r1, weight * {_case([x[2] for x in CURRICULUM_SHAPES])} AS r2 FROM t),
p AS (SELECT d.doc_id, d.size, q.*, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.order_key, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM d JOIN q ON q.src = d.src),
c AS (SELECT *, [{_COPIES}] AS copies FROM p),
u AS (SELECT *, (lo + copies[1] * CAST(0.5 AS DOUBLE)) / quota * weight AS goal, (r1 + r0) * 0.5 * 0.5 AS a1 FROM c),
v AS (SELECT *, goal >= a1 AS late, goal - CASE WHEN goal >= a1 THEN a1 ELSE 0 END AS rest, CASE WHEN goal >= a1 THEN r1 ELSE r0 END AS w0,
             CASE WHEN goal >= a1 THEN (r2 - r1) / 0.5 ELSE (r1 - r0) / 0.5 END AS slope FROM u)
SELECT doc_id, size, source_size, target, CAST(list_sum(copies) AS BIGINT) AS taken, len(list_filter(copies, lambda x: x > 0)) AS n_copies,
       CASE WHEN copies[1] > 0 THEN CASE WHEN late THEN 0.5 ELSE 0.0 END + least(CASE WHEN rest <= 0 THEN 0.0
         ELSE rest * 2.0 / (w0 + sqrt(greatest(w0 * w0 + slope * rest * 2.0, 0.0))) END, 0.5) END AS first_position
FROM v"""

OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines, regexp_extract_all(coalesce(text, ''), '{W}') AS words
  FROM documents),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) x WHERE k > 1),
rep AS (SELECT doc_id, COUNT(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) x GROUP BY doc_id),
b AS (
  SELECT d.doc_id, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{W}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{W}')))) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
l AS (SELECT doc_id, place, line, len(regexp_extract_all(line, '{W}')) AS n, n_repeat_words * 4 > n_words AS often
      FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place, n_repeat_words, n_words FROM b)),
k AS (SELECT doc_id, line, n FROM l WHERE NOT (
        (n >= 3 AND len(regexp_extract_all(line, '[#*$%&<>=_~^\\{{}}]')) * 2 >= n AND regexp_matches(line, '[#*$%&<>=_~^\\{{}}]'))
        OR (n >= 3 AND regexp_matches(line, '[!?]{{2}}') AND len(regexp_extract_all(line, '[!?]{{2,}}')) * 3 >= n)
        OR (n >= 4 AND regexp_matches(line, '[|>»›·•]') AND len(regexp_extract_all(line, '[|>»›·•]')) * 4 >= n)
        OR (n >= 40 AND NOT regexp_matches(line, '[.,;:!?…。！？]'))
        OR (n > 0 AND n <= {BOILERPLATE_MAX_WORDS} AND regexp_matches(line, '(?i)\b({BOILERPLATE})\b'))
        OR (often AND n >= 20 AND len(list_distinct(string_split_regex(line, '[\x20\x09-\x0D]+'))) * 4 < n))),
m AS (SELECT k.doc_id, k.line, max(k.n) AS n, COUNT(*) AS times FROM k GROUP BY k.doc_id, k.line),
cw AS (SELECT doc_id, sum(n) AS w FROM m GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(w, 0) <= n_words * CAST({MAX_LOSS} AS DOUBLE) AS kept,
       CAST(coalesce(w, 0) AS BIGINT) AS clean_words
FROM b LEFT JOIN cw USING (doc_id)"""

OP3 = """
WITH u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM u q JOIN u c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS x FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(x[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 1, CASE WHEN len(x) > 0 THEN 2 ELSE 1 END))) AS i FROM w) y),
n AS (SELECT w.doc_id, COUNT(g.s) AS n_shingles FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM g GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM sets),
rg AS (SELECT g.doc_id, g.s FROM g JOIN cls USING (doc_id) WHERE cls.class_id = g.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM rg a JOIN rg b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * k >= 85 * (na.n_shingles + nb.n_shingles - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS x, a AS y FROM both_ways UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT n.doc_id, n.n_shingles, coalesce(comp.c, cls.class_id, n.doc_id) AS component_id,
       n.doc_id = coalesce(comp.c, cls.class_id, n.doc_id) AS kept, coalesce(cls.class_id, n.doc_id) AS class_id
FROM n LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.x = cls.class_id"""

_SKETCH = """list_sort(list_distinct(list_filter(list_transform(
    range(1, CASE WHEN len({w}) = 0 THEN 1 ELSE greatest(len({w}) - 2, 1) + 1 END),
    lambda i: left(md5(array_to_string({w}[i : i + 2], ' ')), 12)), lambda x: x < '200000000000')))"""
_ALIKE = """CASE WHEN {same} THEN 1.0::DOUBLE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE
    ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"""
_INSIDE = "CASE WHEN {same} THEN 1.0::DOUBLE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a})::DOUBLE END"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}')"


OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS at, COUNT(*) OVER () AS total FROM documents),
p AS (SELECT a.doc_id, a.t, b.t AS nt, length(a.t) AS n FROM d a JOIN d b ON b.at = CASE WHEN a.at = a.total THEN 1 ELSE a.at + 1 END),
e AS (SELECT *, left(t, n - n // 2) || left(nt, n // 2) AS et FROM p),
w AS (SELECT *, {_words('t')} AS w, {_words('nt')} AS nw, {_words('et')} AS ew FROM e),
s AS (SELECT *, {_SKETCH.format(w='w')} AS s, {_SKETCH.format(w='nw')} AS ns, {_SKETCH.format(w='ew')} AS es FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, left(md5(t), 16) || ':' || array_to_string(s, ',') AS fingerprint,
       left(md5(et), 16) || ':' || array_to_string(es, ',') AS edited_fingerprint, {_ALIKE.format(a='s', b='es', same='t = et')} AS near_edited,
       {_ALIKE.format(a='s', b='ns', same='t = nt')} AS near_next, {_INSIDE.format(a='s', b='es', same='t = et')} AS contained_edited,
       {_INSIDE.format(a='s', b='ns', same='t = nt')} AS contained_next
FROM s"""

OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i : i + k - 1] AS s FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) x(k))),
f AS (SELECT lang, k, s, array_to_string(s, ' ') AS phrase, COUNT(*) AS c FROM g GROUP BY lang, k, s HAVING COUNT(*) >= 10),
u AS (SELECT lang, phrase, s, k, c AS a, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
x AS (SELECT u.lang, u.phrase, u.k, u.a, u.cut, l.c AS l, r.c AS r,
             CAST((1000000::HUGEINT * u.a * u.a) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.s = u.s[1 : u.cut] JOIN f r ON r.lang = u.lang AND r.s = u.s[u.cut + 1 : u.k]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(c) AS longer FROM (SELECT lang, c, array_to_string(s[1:2], ' ') AS phrase FROM f WHERE k = 3
      UNION ALL SELECT lang, c, array_to_string(s[2:3], ' ') FROM f WHERE k = 3) y GROUP BY lang, phrase),
r AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, t.n, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b JOIN t USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000"""

ORACLES = {"op1_mix_sources": OP1, "op2_quality_rules": OP2, "op3_nearest_neighbours": OP3, "op7_near_duplicates": OP7, "op11_fingerprints": OP11, "op12_collocations": OP12}
