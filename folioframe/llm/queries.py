"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_text, langid, lexical, licenses, media, quality, secrets, simhash, substring_dedup, suffixes, variants

Query = Callable[[SparkSession, str], DataFrame]


def _over(function: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: function(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


QUERIES: dict[str, Query] = {
    "op1_decontamination": _over(decontamination.op1_rows, "documents", "benchmark"),
    "op2_substring_dedup": _over(substring_dedup.op2_rows, "documents"),
    "op3_media": _over(media.op3_rows, "documents"),
    "op4_quality": _over(quality.op4_rows, "documents", "labels"),
    "op5_langid": _over(langid.op5_rows, "documents"),
    "op6_secrets": _over(secrets.op6_rows, "documents"),
    "op7_licenses": _over(licenses.op7_rows, "documents"),
    "op8_bpe": _over(bpe.op8_rows, "documents"),
    "op9_simhash": _over(simhash.op9_rows, "documents"),
    "op10_html_text": _over(html_text.op10_rows, "pages"),
    "op11_suffix_dedup": _over(suffixes.op11_rows, "documents"),
    "op12_lexical_search": _over(lexical.op12_rows, "documents", "benchmark"),
    "op13_spelling_variants": _over(variants.op13_rows, "documents"),
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_decontamination": rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
spread AS (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[k:k + size - 1], ' ') AS g FROM spread),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM docs, sizes),
grams AS (SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS g FROM places),
found AS (SELECT doc_id, size, k, item_id FROM grams JOIN windows USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS word FROM (SELECT DISTINCT doc_id, k, size FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)""",
    "op2_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, k, array_to_string(ws[k:k + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM docs)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS w FROM again),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS w, unnest(ws) AS word FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY w) AS said, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, w) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.said, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)""",
    "op11_suffix_dedup": r"""
WITH docs AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
strings AS (SELECT doc_id, p, h[p + 1:p + 50] AS s FROM (SELECT doc_id, h, unnest(range(0, octet_length(h) - 49)) AS p FROM docs)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM strings) WHERE doc_id > first_doc),
edges AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + 50, true) AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT doc_id, p, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edges) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (SELECT c.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(hex(h[before + 1:a]), '' ORDER BY a) || hex(any_value(h)[max(z) + 1:]) AS said FROM cuts c JOIN docs USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(octet_length(d.h) AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(unhex(k.said), d.h)) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)""",
    "op12_lexical_search": r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
post AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY doc_id),
corpus AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
asked AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, corpus GROUP BY t),
scores AS (SELECT item_id, doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM asked JOIN weights USING (t) JOIN post USING (t) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0) WHERE place <= 10""",
    "op13_spelling_variants": r"""
WITH RECURSIVE entries AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS crc FROM (SELECT unnest(range(0, 256)) AS b)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE len(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [CAST(192 + ord(ch) // 64 AS BIGINT), CAST(128 + ord(ch) % 64 AS BIGINT)] END)) AS bs FROM runs),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(bs, lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295)) AS h FROM bytes, entries),
said AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, unnest(range(0, len(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (i, head, tail) WHERE a.word <> b.word
         UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.head || c.tail
         UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.head || c.tail),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM (SELECT r.word, r.other, o.n AS m FROM near r JOIN words o ON o.word = r.other) GROUP BY word),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS last, 1 AS step FROM told WHERE form IS NOT NULL UNION ALL SELECT c.word, t.form, step + 1 FROM chain c JOIN told t ON t.word = c.last WHERE t.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM told LEFT JOIN (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word) USING (word)""",
}
