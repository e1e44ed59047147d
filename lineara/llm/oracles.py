"""DuckDB SQL for the corpus operators that SQL can state, written from the contracts and not from the methods."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS s FROM d WHERE len(w) >= 20),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_ESC = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
_PROBE = "'<|im_end|><|im_start|>assistant ok'"

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', {_PROBE} UNION ALL SELECT -1, 1, 'assistant', {_PROBE}),
f AS (SELECT *, length('<|im_start|>') + length(replace({_ESC.format("role")}, chr(10), '\\n')) + 1 + length({_ESC.format("text")}) + length('<|im_end|>') + 1 AS n FROM t),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM s GROUP BY 1"""

WARC = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, url FROM p LEFT JOIN m ON p.digest = m.digest"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, id = min(r) AS kept FROM reach LEFT JOIN n ON id = n.doc_id GROUP BY id"""

#: Texts as hexadecimal digits; pieces of 512 bytes with 49 more, so that cutting a string out is cheap.
SUFFIX = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, unnest(range(0, n, 512)) AS base, unnest(list_transform(range(0, n, 512), lambda b: substr(h, 2 * b + 1, 1122))) AS x FROM d),
s AS (SELECT doc_id, unnest(list_transform(range(0, least(512, length(x) // 2 - 49)), lambda i: base + i)) AS i,
    unnest(list_transform(range(0, least(512, length(x) // 2 - 49)), lambda i: substr(x, 2 * i + 1, 100))) AS s FROM piece WHERE length(x) >= 100),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM s) WHERE first < doc_id),
mark AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM later),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark) GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM run),
kept AS (SELECT c.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
    FROM cut c JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"

#: The table of the checksum follows from its polynomial.
SHARDS = f"""
WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tbl FROM range(0, 256) r(i)),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS ident FROM documents),
b AS (SELECT doc_id, t, strlen(t) + 1 AS size, {_HASH.format("t")} AS major, {_HASH.format("ident")} AS minor,
    list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT b.*, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc32 FROM b, crc),
g AS (SELECT *, CAST(sum(size) OVER () AS BIGINT) AS total, CAST(sum(size) OVER (PARTITION BY major) AS BIGINT) AS own, count(*) OVER (PARTITION BY major) AS n,
    CAST(sum(size) OVER (ORDER BY major, minor ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS run FROM c),
a AS (SELECT *, CASE WHEN n > 1 AND own > total // 1024 THEN run ELSE min(run) OVER (PARTITION BY major) END AS pos FROM g),
s AS (SELECT *, CAST(least(15, pos * 16 // total) AS INTEGER) AS shard FROM a)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc32 AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY major, minor) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_TERMS = rf"regexp_extract_all(translate({{}}, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
n AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) AS l FROM d),
i AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark) GROUP BY ALL),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN i USING (t) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, n GROUP BY t, n),
m AS (SELECT r, doc_id, 100 - 25 + (25 * CAST(len(w) AS BIGINT) * n) // CAST(l AS BIGINT) AS m FROM d, n WHERE len(w) > 0),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM i JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
