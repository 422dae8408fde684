"""DuckDB SQL for the queries that SQL can express."""

from .licenses import Template, as_regex

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN roots r USING (doc_id)
"""

OP7 = """
WITH RECURSIVE rows AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
good AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM rows
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
FROM roots r LEFT JOIN counts c USING (vec_id)
"""

OP9 = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
"""


def op10(seed: int, fraction: float, epochs: int, weights: dict[str, dict[str, float]]) -> str:
    def weight(level: str) -> str:
        given = weights.get(level) or {}
        return "CASE " + " ".join(f"WHEN {level} = '{v}' THEN CAST({w} AS DOUBLE)" for v, w in given.items()) + " ELSE CAST(1 AS DOUBLE) END" if given else "CAST(1 AS DOUBLE)"

    parts, parent = [], []
    for level in ("domain", "language", "origin"):
        keys = [*parent, level]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        above = f"b_{parent[-1]}" if parent else "b_all"
        join = f"JOIN {above} p USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above} p"
        parts.append(f"""
n_{level} AS (SELECT {', '.join(keys)}, sum(cap) AS cap, sum(tokens) AS tokens, {weight(level)} AS weight FROM leaves GROUP BY {', '.join(keys)}),
w_{level} AS (SELECT n.*, p.budget AS given, sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caps,
  sum(weight) OVER ({by}) - sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest
  FROM n_{level} n {join} WINDOW o AS ({by} ORDER BY cap / weight, {level})),
f_{level} AS (SELECT *, caps + cap / weight * rest <= given AS is_full FROM w_{level}),
b_{level} AS (SELECT {', '.join(keys)}, tokens, least(CAST(cap AS DOUBLE), CASE WHEN is_full THEN CAST(cap AS DOUBLE)
  ELSE (given - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({by}), 0)) * weight / sum(weight) FILTER (WHERE NOT is_full) OVER ({by}) END) AS budget FROM f_{level})""")
        parent = keys
    return f"""
WITH docs AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '[5-9]$') THEN 'high' ELSE 'low' END AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap FROM docs GROUP BY ALL),
b_all AS (SELECT CAST(least(floor({fraction} * sum(tokens)), sum(cap)) AS DOUBLE) AS budget FROM leaves),{','.join(parts)},
times AS (SELECT d.*, e.epoch, md5(concat_ws(':', '{seed}', CAST(e.epoch AS VARCHAR), CAST(d.doc_id AS VARCHAR))) AS key, CAST(floor(b.budget + 1e-6) AS BIGINT) AS budget
  FROM docs d JOIN b_origin b USING (domain, language, origin) CROSS JOIN (SELECT CAST(unnest(range(1, {epochs + 1})) AS INTEGER) AS epoch) e),
sums AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY epoch, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM times)
SELECT doc_id, domain, language, origin, epoch, tokens, budget, upto FROM sums WHERE upto <= budget
"""


def op11(templates: list[Template]) -> str:
    """Base places from lists of words; all labels and the score from the templates as regular expressions over normalised words."""
    phrases = ", ".join(f"('{t.label}', {t.parts})" for t in templates if t.kind == "base")
    patterns = ", ".join(f"('{t.label}', {t.weight}, '{as_regex(t)}')" for t in templates)
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases(label, p) AS (VALUES {phrases}),
patterns(label, weight, pattern) AS (VALUES {patterns}),
lines AS (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS line FROM words WHERE len(w) > 0),
starts AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words),
base AS (SELECT s.r, s.i - 1 AS i, p.label FROM starts s JOIN phrases p ON s.w[s.i] = p.p[1] AND s.w[s.i : s.i + len(p.p) - 1] = p.p),
found AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
marks AS (SELECT l.r, string_agg(DISTINCT p.label, ',' ORDER BY p.label) AS labels, max(p.weight) AS score FROM lines l JOIN patterns p ON regexp_matches(l.line, p.pattern) GROUP BY l.r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(f.n, 0) AS BIGINT) AS n_base, CAST(f.lo AS BIGINT) AS first_word, CAST(f.hi AS BIGINT) AS last_word,
  coalesce(f.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, CAST(coalesce(m.score, 0) AS DOUBLE) AS score
FROM words w LEFT JOIN found f USING (r) LEFT JOIN marks m USING (r)
"""


#: CRC-32 by bytes, from its polynomial; one edit apart are words that are equal without a letter at the same place, or of which one is the other without a letter.
OP13 = f"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]{{5,}}')) AS run FROM documents),
several AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS n FROM runs GROUP BY ALL),
crcs AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(named))), lambda k: CAST(('0x' || hex(encode(named))[2 * k + 1 : 2 * k + 2]) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM several, steps),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM crcs),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
ranked AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other COLLATE "C") AS k FROM near),
forms AS MATERIALIZED (SELECT w.word, r.other AS form, r.n AS form_n FROM words w JOIN ranked r ON w.word = r.word AND r.k = 1 AND r.n >= 2 * w.n),
ways AS (SELECT word, form AS root FROM forms UNION SELECT y.word, f.form FROM ways y JOIN forms f ON y.root = f.word),
roots AS (SELECT word, root FROM ways WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, CAST(coalesce(c.n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM words w LEFT JOIN counts c USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""
