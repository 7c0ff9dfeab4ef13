"""DuckDB statements, written from the definitions and not from the Spark jobs."""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM pos),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
        + 8 * (word_chars < 3 * n_words)::INT + 16 * (word_chars > 12 * n_words)::INT + 32 * (2 * n_dup_lines > n_lines)::INT
        + 64 * (100 * n_upper > 40 * word_chars)::INT + 128 * (2 * n_exclaims > n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT *, fail_bits & 3 != 0 AS base_failed, fail_bits = 0 AS kept, '2' AS policy FROM r
"""

DECONTAMINATION = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
       FROM benchmark, letters),
pat AS (SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM it WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM documents, letters),
place AS (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM pat) WHERE len(ws) >= size),
gram AS (SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g FROM place),
hit AS (SELECT rid, gram.size AS size, i, item FROM gram JOIN pat ON gram.size = pat.size AND gram.g = pat.g),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 1], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM d WHERE len(ws) > 0)),
size AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
meet AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT a, b FROM meet JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(r, o) AS (SELECT rid, rid FROM d UNION SELECT r, b FROM reach JOIN sym ON sym.a = o),
comp AS (SELECT r AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = o GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN comp USING (rid) LEFT JOIN size USING (rid)
"""

#: Paths with dot segments and references other than ``&amp;`` are not resolved here; the given pages have none in such links.
URL_FILTERS = r"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, url, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS rid, page_id, url, html,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
u AS (SELECT *, CASE WHEN host || path = '' THEN '' ELSE host || path || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS node,
        regexp_replace(html, '(?is)<!--.*?(-->|\z)|<(script|style)\b.*?(</(script|style)\s*>|\z)', '', 'g') AS shown FROM p),
target AS (SELECT node AS a, host, path, replace(unnest(
        list_transform(list_filter(regexp_extract_all(shown, '(?is)<link\s[^>]*>'), lambda x: regexp_matches(x, '(?i)\srel\s*=\s*["'']?([^"''>]*\s)?canonical\b')),
            lambda x: regexp_extract(x, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1))
        || list_transform(list_filter(regexp_extract_all(shown, '(?is)<meta\s[^>]*>'), lambda x: regexp_matches(x, '(?i)\shttp-equiv\s*=\s*["'']?refresh\b')),
            lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1))), '&amp;', '&') AS t FROM u),
goal AS (SELECT a, CASE WHEN t LIKE '%://%' THEN regexp_extract(t, '://(.*)', 1) WHEN t LIKE '//%' THEN substr(t, 3)
        WHEN t LIKE '/%' THEN host || t WHEN t LIKE '?%' THEN host || path || t
        ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS b
         FROM target WHERE t != '' AND a != '' AND t NOT LIKE '#%' AND (t LIKE '%://%' OR NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:'))),
edge AS (SELECT a, translate(regexp_extract(b, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(b, '^[^/?#]*([^#]*)', 1) AS b FROM goal),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
node AS (SELECT DISTINCT node, host, path FROM u UNION SELECT DISTINCT b, regexp_extract(b, '^[^/?]*'), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM edge),
fit AS (SELECT node, rh || rp AS rule, verdict FROM node, rules WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(rh || rp) DESC, verdict, rh || rp DESC) = 1),
reach(n, o) AS (SELECT a, a FROM sym UNION SELECT n, b FROM reach JOIN sym ON sym.a = o),
bad AS (SELECT DISTINCT n AS node FROM reach JOIN fit ON fit.node = o AND fit.verdict = 'block')
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON fit.node = u.node LEFT JOIN bad ON bad.node = u.node
"""

CRC = """
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an expression, where ``crc_table`` is joined."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


SPELLING = f"""
WITH RECURSIVE {CRC.strip()},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents),
met AS (SELECT doc_id, r, count(*) AS c FROM run WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (SELECT r, c, {crc32("(doc_id || ':' || r)")} AS h FROM met, crc_table),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
cut AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
lost AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM cut),
pair AS (SELECT x.word, y.word AS near FROM lost x JOIN lost y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word != y.word
         UNION SELECT x.word, y.word FROM lost x JOIN v y ON y.word = x.a || x.b
         UNION SELECT y.word, x.word FROM lost x JOIN v y ON y.word = x.a || x.b),
best AS (SELECT p.word, count(*) AS n_near, max(v.n) AS top FROM pair p JOIN v ON v.word = near GROUP BY 1),
form AS (SELECT p.word, min(near) AS form, any_value(top) AS form_n FROM pair p JOIN best USING (word) JOIN v y ON y.word = near JOIN v x ON x.word = p.word
         WHERE y.n = top AND top >= 5 * x.n GROUP BY 1),
chain(word, stop) AS (SELECT word, word FROM v UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.stop)
SELECT v.word, form.form, stop AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM v LEFT JOIN best USING (word) LEFT JOIN form USING (word)
JOIN (SELECT word, stop FROM chain WHERE stop NOT IN (SELECT word FROM form)) ends USING (word)
"""

TOP_K = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.rid, q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
           FROM e q JOIN e p ON q.rid != p.rid AND len(q.v) = len(p.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""


def _hashed(text: str) -> str:
    """Leaf of a document with its text replaced."""
    columns = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


MERKLE = f"""
WITH RECURSIVE {CRC.strip()},
d AS (SELECT doc_id, coalesce('=' || source, '') AS src, {_hashed("text")} AS leaf,
        CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_hashed("replace(text, chr(10), '')")} ELSE {_hashed("text")} END AS torn FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n FROM d),
low(src, l, pos, n, h) AS (SELECT src, 0, pos, n, leaf FROM p
        UNION ALL SELECT src, l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY src, l, n, pos // 3),
climb(doc_id, src, leaf, l, pos, f, seen) AS (SELECT doc_id, src, leaf, 0, pos, torn, '' FROM p
        UNION ALL SELECT c.doc_id, c.src, c.leaf, c.l + 1, c.pos // 3, sha256(string_agg(CASE WHEN x.pos = c.pos THEN f ELSE h END, '' ORDER BY x.pos)),
               seen || coalesce(string_agg(h, '' ORDER BY x.pos) FILTER (x.pos != c.pos), '')
        FROM climb c JOIN low x ON x.src = c.src AND x.l = c.l AND x.pos // 3 = c.pos // 3 WHERE x.n > 1 GROUP BY c.doc_id, c.src, c.leaf, c.l, c.pos, f, seen),
sub AS (SELECT src, h, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(l, pos, n, h) AS (SELECT 0, pos, n, h FROM sub
        UNION ALL SELECT l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY l, n, pos // 3),
last(doc_id, src, leaf, subroot, l, pos, f, seen) AS (
        SELECT c.doc_id, c.src, c.leaf, s.h, 0, s.pos, c.f, c.seen FROM climb c JOIN sub s USING (src) WHERE c.l = (SELECT max(l) FROM low x WHERE x.src = c.src)
        UNION ALL SELECT c.doc_id, c.src, c.leaf, c.subroot, c.l + 1, c.pos // 3, sha256(string_agg(CASE WHEN x.pos = c.pos THEN f ELSE h END, '' ORDER BY x.pos)),
               seen || coalesce(string_agg(h, '' ORDER BY x.pos) FILTER (x.pos != c.pos), '')
        FROM last c JOIN high x ON x.l = c.l AND x.pos // 3 = c.pos // 3 WHERE x.n > 1 GROUP BY c.doc_id, c.src, c.leaf, c.subroot, c.l, c.pos, f, seen)
SELECT doc_id, CASE WHEN src != '' THEN substr(src, 2) END AS source, leaf, subroot, root, sha256(seen) AS proof_sha256, f AS folded_root, f = root AS verified
FROM last, (SELECT h AS root FROM high WHERE n = 1) WHERE l = (SELECT max(l) FROM high)
"""
