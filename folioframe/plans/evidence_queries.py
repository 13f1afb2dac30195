"""Evidence rules: windows over conversations, status rules, and small inline cases with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import blocks as B
from folioframe.operators import evidence as E
from folioframe.plans.registry import Registry, pick

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_CONTEXT = (
    "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')",
    r"regexp_replace(regexp_replace({}, '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '<[^>]+>', ' ', 'g')",
    r"replace(replace(replace(replace(replace(replace({}, '\cdot', ' times '), '\times', ' times '), '\div', ' div '), '\pm', ' plusminus '), '\leq', ' le '), '\geq', ' ge ')",
    r"regexp_replace({}, '\\frac\s*\{{([^{{}}]+)\}}\s*\{{([^{{}}]+)\}}', ' frac \1 over \2 ', 'g')",
    r"regexp_replace(regexp_replace({}, '\\sqrt\s*\{{([^{{}}]+)\}}', ' sqrt \1 ', 'g'), '\\text\s*\{{([^{{}}]+)\}}', ' \1 ', 'g')",
    r"regexp_replace(regexp_replace({}, '\\[a-zA-Z]+', ' ', 'g'), '[$*_`{{}}()\[\],.;:!?©®™|]+', ' ', 'g')",
    r"trim(lower(regexp_replace({}, '[^a-zA-Z0-9+\-*/=<>.%]+', ' ', 'g')))",
)


def _context_sql(column: str) -> str:
    for step in _CONTEXT:
        column = step.format(column)
    return column


_KEY = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"


@R.over("context_text", "documents", sql=f"SELECT doc_id, md5({_context_sql('text')}) AS digest FROM documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(X.context_text(F.col("text"))).alias("digest"))


_SLASH = "' || chr(92) || '"


@R.derived("context_maths", "lineitem", {"t": f"""SELECT l_orderkey * 8 + l_linenumber AS i, concat({pick("l_partkey", "concat(chr(92), 'frac{{1}}{{2}} ')", "'![a](b) '", "''", "concat(chr(92), 'times ')")}, {pick("l_suppkey", "'x &lt; '", "'<b>Word</b> '", "concat(chr(92), 'sqrt {{3}}! ')")}, {pick("CAST(l_quantity AS INT)", "'$5.0$'", "concat(chr(92), 'alpha')", "concat(chr(92), 'text{{so}}')", "''")}) AS v FROM {{lineitem}}"""}, sql="""
, p AS (SELECT l_orderkey * 8 + l_linenumber AS i, ['frac 1 over 2', '', '', 'times'][1 + l_partkey % 4] AS a, ['x <', 'word', 'sqrt 3'][1 + l_suppkey % 3] AS b, ['5 0', '', 'so', ''][1 + CAST(l_quantity AS INT) % 4] AS c FROM lineitem)
SELECT i, array_to_string(list_filter([a, b, c], lambda x: x <> ''), ' ') AS k FROM p""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", X.context_text(F.col("v")).alias("k"))


@R.over("near_flag", "conversations", sql="""
SELECT conv_id, turn, coalesce(bool_or(contains(lower(text), 'the')) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 18 PRECEDING AND 2 FOLLOWING), false) AS near FROM conversations""")
def _(turns: DataFrame) -> DataFrame:
    return E.near_flag(turns, ["conv_id"], "turn", F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn", "near")


@R.over("caption_choice", "conversations", sql="""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '^ | $', '', 'g') END AS own, regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS said FROM conversations),
n AS (SELECT *, lag(said, 2) OVER w AS a, lag(said, 1) OVER w AS b, lead(said, 1) OVER w AS c, lead(said, 2) OVER w AS d FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(substr(CASE WHEN own <> '' THEN own ELSE coalesce(list_filter([a, b, c, d], lambda x: x <> '' AND length(x) <= 120)[1], '') END, 1, 240)) AS digest FROM n""")
def _(turns: DataFrame) -> DataFrame:
    from folioframe.operators.blocks import neighbours

    rows = neighbours(turns.withColumn("said", F.coalesce("text", F.lit(""))), ["conv_id"], "turn", "said", 2, 2)
    own = F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("said"))
    return rows.select("conv_id", "turn", F.md5(E.caption(own, F.col("before"), F.col("after"))).alias("digest"))


@R.over("short_locator", "conversations", sql=f"""
WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), w AS (SELECT conv_id, turn AS first, unnest([{{'n': 1, 't': t}}, {{'n': 2, 't': t || ' ' || lead(t, 1) OVER p}}, {{'n': 3, 't': t || ' ' || lead(t, 1) OVER p || ' ' || lead(t, 2) OVER p}}]) AS x FROM r WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, first, x.n AS n_rows, replace({_context_sql("x.t")}, ' ', '') AS k FROM w WHERE x.t IS NOT NULL AND trim(x.t) <> ''), u AS (SELECT conv_id, k, count(*) AS n, min(first) AS first, min(n_rows) AS n_rows FROM k GROUP BY ALL),
c AS (SELECT conv_id, turn AS id, replace({_context_sql("text")}, ' ', '') AS k FROM conversations)
SELECT c.conv_id, c.id, u.first, u.n_rows FROM c JOIN u ON c.conv_id = u.conv_id AND c.k = u.k WHERE length(c.k) BETWEEN 8 AND 23 AND u.n = 1""")
def _(turns: DataFrame) -> DataFrame:
    rows = turns.withColumn("page", F.lit(0))
    return E.short_matches(rows.withColumnRenamed("turn", "id"), rows, "conv_id", "page", "turn", id_="id", text="text", raw="text").select("conv_id", "id", "first", "n_rows")


@R.over("monotone_progress", "events", sql="""
WITH e AS (SELECT user_id, event_id, event_type, event_id % 101 AS p FROM events), r AS (SELECT *, sum(CASE WHEN event_type IN ('queued', 'completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT event_id, max(p) OVER (PARTITION BY user_id, run ORDER BY event_id)::INT AS progress FROM r""")
def _(events: DataFrame) -> DataFrame:
    return E.monotone_progress(events.withColumn("p", F.col("event_id") % 101), "user_id", "event_id", "event_type", "p").select("event_id", "progress")


@R.over("packet_order", "labels", sql="""
SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY toxic, coalesce(nullif(doc_id % 7, 0), 1000000000), doc_id) AS place FROM labels""")
def _(labels: DataFrame) -> DataFrame:
    page = F.nullif(F.col("doc_id") % 7, F.lit(0))
    return B.ranked_by_ranges(labels, ["quality"], [F.col("toxic"), page], "doc_id").select("doc_id", F.col("place").cast("long"))


_UNITS = "(VALUES ('d', 0, 'a', 'one'), ('d', 1, 'a/b', 'two'), ('d', 2, '', 'three'), ('d', 3, 'x', ''), ('e', 0, 'q', 'q')) AS t(doc, i, path, title)"
_CLEAN = "(VALUES ('d', 10, 'a', 'uno'), ('d', 11, 'a', 'dos'), ('d', 12, 'zz', 'two'), ('d', 13, 'y', 'three'), ('d', 14, 'z', 'three'), ('d', 15, '', '')) AS t(doc, i, path, title)"


@R.derived("unit_matches", "conversations", {
    "r": """SELECT conv_id AS doc, turn AS i, CASE CAST((conv_id + turn) % 4 AS INT) WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 2 THEN '' WHEN 3 THEN 'x' END AS path, CASE CAST((turn * 3 + conv_id) % 5 AS INT) WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' WHEN 3 THEN '' WHEN 4 THEN substr(text, 1, 4) END AS title FROM {conversations}""",
    "c": """SELECT conv_id AS doc, turn + 10 AS i, CASE CAST((conv_id * 3 + turn) % 5 AS INT) WHEN 0 THEN 'a' WHEN 1 THEN 'zz' WHEN 2 THEN '' WHEN 3 THEN 'x' WHEN 4 THEN 'y' END AS path, CASE CAST((turn + conv_id) % 5 AS INT) WHEN 0 THEN 'uno' WHEN 1 THEN 'two' WHEN 2 THEN 'three' WHEN 3 THEN '' WHEN 4 THEN substr(text, 1, 4) END AS title FROM {conversations} WHERE conv_id % 5 <> 0""",
}, sql="""
, p AS (SELECT doc, path, max(i) AS p FROM c WHERE path <> '' GROUP BY ALL), t AS (SELECT doc, title, min(i) AS t FROM c WHERE title <> '' GROUP BY ALL HAVING count(*) = 1)
SELECT r.doc, r.i, coalesce(p, t) AS clean_index, CASE WHEN coalesce(p, t) IS NOT NULL THEN 'matched' WHEN r.doc NOT IN (SELECT doc FROM c) THEN 'pending' ELSE 'missing' END AS clean_status FROM r LEFT JOIN p ON r.doc = p.doc AND r.path = p.path LEFT JOIN t ON r.doc = t.doc AND r.title = t.title""")
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    return E.unit_matches(r, c, "doc", "i", "path", "title").select("doc", "i", "clean_index", "clean_status")


@R.derived("table_matches", "conversations", {
    "c": f"""SELECT conv_id AS doc, turn AS i, concat('abcdefghijklmnopqrst', {pick("turn", "'uvwxyz'", "'uv'", "''")}, {pick("conv_id", "''", "'0123'")}) AS k FROM {{conversations}} UNION ALL SELECT conv_id, turn + 100, {pick("turn", "'short'", "''", "'nowhere'")} FROM {{conversations}}""",
    "r": f"""SELECT conv_id AS doc, turn AS n, substr('abcdefghijklmnopqrstuvwxyz0123', 1, 18 + CAST(turn * 3 % 12 AS INT)) AS rk FROM {{conversations}} UNION ALL SELECT conv_id, turn + 50, {pick("turn + conv_id", "'short'", "''", "'abcdefghij'")} FROM {{conversations}}""",
}, sql="""
, m AS (SELECT c.doc, c.i, r.n, CASE WHEN rk = k THEN 1.0::DOUBLE WHEN length(k) >= 20 AND rk <> '' AND contains(k, rk) THEN length(rk)::DOUBLE / length(k) END AS s FROM c JOIN r ON c.doc = r.doc WHERE k <> '')
SELECT doc, i, n AS match_index, round(s, 4) AS score, CASE WHEN round(s, 4) = 1 THEN 'exact' ELSE 'contained' END AS rule, n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY doc, i ORDER BY round(s, 4) DESC, n) AS rn, count(*) OVER (PARTITION BY doc, i) AS n_candidates FROM m WHERE s >= 0.85) WHERE rn = 1""")  # fmt: skip
def _(c: DataFrame, r: DataFrame) -> DataFrame:
    return E.table_matches(c, r, "doc", "i", "k", "n", "rk")


@R.derived("image_paths", "conversations", {
    "t": f"""SELECT conv_id AS doc, turn AS i, {pick("turn + conv_id", "'A red fox'", "''", "'blue'", "'zzz'", "substr(text, 1, 12)")} AS said, (turn * 3 + conv_id) % 5 AS n FROM {{conversations}}""",
    "m": f"""SELECT conv_id AS doc, turn AS pos, {pick("turn * 2 + conv_id", "'fox'", "'a red fox runs'", "'red fox'", "''", "substr(text, 1, 30)", "'Blue!'")} AS said, concat('p', CAST(turn AS VARCHAR(9))) AS path FROM {{conversations}} WHERE conv_id % 6 <> 0""",
}, sql=f"""
, x AS (SELECT t.doc, i, n, {_KEY.format("t.said")} AS a FROM t), y AS (SELECT doc, pos, {_KEY.format("said")} AS b, path FROM m),
b AS (SELECT x.doc, i, path, row_number() OVER (PARTITION BY x.doc, i ORDER BY least(length(a), length(b)) DESC, pos) AS rn FROM x JOIN y ON x.doc = y.doc WHERE a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)))
SELECT x.doc, x.i, coalesce(b.path, y.path) AS image_path FROM x LEFT JOIN b ON x.doc = b.doc AND x.i = b.i AND b.rn = 1 LEFT JOIN y ON x.doc = y.doc AND x.n = y.pos""")  # fmt: skip
def _(t: DataFrame, m: DataFrame) -> DataFrame:
    shown = m.withColumnRenamed("said", "shown")
    return E.image_paths(t, shown, "doc", "i", "said", "n", "pos", "shown", "path").select("doc", "i", "image_path")


@R.derived("window_buckets", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, s, CASE WHEN l_suppkey % 3 = 0 THEN s ELSE s - 0.05 END AS r, CASE WHEN l_suppkey % 3 = 1 THEN s ELSE 0.5 END AS o, CASE CAST((l_partkey) % 4 AS INT) WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN s - 0.1 WHEN 2 THEN s - 0.04 WHEN 3 THEN s - 0.01 END AS s2 FROM (SELECT *, CASE CAST((CAST(l_quantity AS INT)) % 7 AS INT) WHEN 0 THEN 0.99 WHEN 1 THEN 0.93 WHEN 2 THEN 0.86 WHEN 3 THEN CAST(NULL AS DOUBLE) WHEN 4 THEN 0.5 WHEN 5 THEN 1.0 WHEN 6 THEN 0.98 END AS s FROM {lineitem}) AS x""",
}, sql="""
, d AS (SELECT i, s::DOUBLE AS s, r::DOUBLE AS r, o::DOUBLE AS o, s::DOUBLE - coalesce(s2, 0)::DOUBLE AS m FROM t)
SELECT i, CASE WHEN s IS NULL THEN 'no_context_candidate' WHEN r >= 0.98 AND m >= 0.03 THEN 'context_window_candidate_high_confidence' WHEN o >= 0.98 AND r >= 0.8 AND m >= 0.03 THEN 'context_window_candidate_high_confidence' WHEN s >= 0.92 AND m >= 0.05 THEN 'context_window_candidate_review' WHEN s >= 0.82 THEN 'context_window_candidate_weak' ELSE 'no_context_candidate' END AS bucket FROM d""")
def _(t: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return t.select("i", E.window_bucket(d("s"), d("r"), d("o"), d("s2")).alias("bucket"))


@R.derived("stop_reasons", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 5 AS INT) WHEN 0 THEN 'no_context_candidate' WHEN 1 THEN 'context_window_candidate_review' WHEN 2 THEN 'context_window_candidate_weak' WHEN 3 THEN 'context_window_candidate_weak' WHEN 4 THEN 'odd' END AS b, concat('a ', CAST(l_linenumber AS VARCHAR(9))) AS c, concat('a ', CASE CAST((l_suppkey) % 3 AS INT) WHEN 0 THEN CAST(l_linenumber AS VARCHAR(9)) WHEN 1 THEN '9' WHEN 2 THEN 'none' END) AS s, CASE CAST((CAST(l_quantity AS INT)) % 3 AS INT) WHEN 0 THEN 0.99 WHEN 1 THEN 0.96 WHEN 2 THEN 0.9 END AS r, CASE CAST((CAST(l_quantity AS INT) + l_linenumber) % 3 AS INT) WHEN 0 THEN 0.5 WHEN 1 THEN 0.99 WHEN 2 THEN 0.0 END AS o, CASE CAST((l_orderkey) % 3 AS INT) WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 WHEN 2 THEN 0.95 END AS sc, l_suppkey % 2 = 0 AS f FROM {lineitem}""",
}, sql=r"""
, d AS (SELECT *, len(regexp_extract_all(c, '[0-9]+')) > 0 AND len(regexp_extract_all(s, '[0-9]+')) > 0 AND regexp_extract_all(c, '[0-9]+(\.[0-9]+)?') <> regexp_extract_all(s, '[0-9]+(\.[0-9]+)?') AS df FROM t)
SELECT i, CASE b WHEN 'no_context_candidate' THEN CASE WHEN sc >= 0.75 AND df THEN 'no_candidate_near_mismatch_different_numbers' ELSE 'no_candidate_requires_manual_or_source_reconstruction' END WHEN 'context_window_candidate_review' THEN 'review_candidate_token_overlap_only'
WHEN 'context_window_candidate_weak' THEN CASE WHEN r >= 0.98 AND o > 0 AND o < 0.98 THEN 'weak_formula_spacing_or_tokenization_review' WHEN df THEN 'weak_false_positive_different_numbers' WHEN r >= 0.95 THEN 'weak_near_text_ocr_or_minor_text_review' WHEN f THEN 'weak_short_formula_not_safe' ELSE 'weak_false_positive_or_context_gap' END ELSE 'unclassified' END AS reason FROM d""")
def _(t: DataFrame) -> DataFrame:
    c = F.col
    return t.select("i", E.stop_reason(c("b"), c("c"), c("s"), c("r"), c("o"), c("sc"), c("f")).alias("reason"))


@R.derived("fold_math", "conversations", {"t": f"""SELECT conv_id % 40 AS doc, conv_id * 100 + turn AS n, {pick("turn * 7 + conv_id + length(text)", "'$$'", "substr(text, 1, 9)", "' $$'", "''", "substr(text, 2, 7)")} AS line FROM {{conversations}}"""}, sql="""
, s AS (SELECT *, sum(CASE WHEN trim(line) = '$$' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) % 2 AS held FROM t), b AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY doc ORDER BY n), 0) AS was FROM s),
g AS (SELECT *, sum(CASE WHEN was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS g FROM b) SELECT doc, min(n) AS n, string_agg(line, chr(10) ORDER BY n) AS line FROM g GROUP BY doc, g""")
def _(t: DataFrame) -> DataFrame:
    return E.fold_lines(t, "doc", "n", "line", opens=F.trim("line") == "$$", closes=F.lit(False), toggles=True)


@R.derived("fold_tables", "conversations", {"t": f"""SELECT conv_id % 40 AS doc, conv_id * 100 + turn AS n, {pick("turn * 7 + conv_id + length(text)", "'<table>'", "substr(text, 1, 9)", "'y</table>'", "'<TABLE border=1>x</table> '", "'  <table >'", "'<tablet>'")} AS line FROM {{conversations}}"""}, sql=r"""
, o AS (SELECT *, regexp_matches(line, '(?i)^\s*<table[\s>]') AS opens, regexp_matches(line, '(?i)</table>\s*$') AS closes FROM t),
s AS (SELECT *, coalesce(last_value(CASE WHEN closes THEN 0 WHEN opens THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n), 0) AS held FROM o), b AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY doc ORDER BY n), 0) AS was FROM s),
g AS (SELECT *, sum(CASE WHEN was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS g FROM b) SELECT doc, min(n) AS n, string_agg(line, chr(10) ORDER BY n) AS line FROM g GROUP BY doc, g""")
def _(t: DataFrame) -> DataFrame:
    return E.fold_lines(t, "doc", "n", "line", opens=F.rlike("line", F.lit(r"(?i)^\s*<table[\s>]")), closes=F.rlike("line", F.lit(r"(?i)</table>\s*$")))


@R.derived("nearby_page", "conversations", {"t": f"""SELECT conv_id % 40 AS doc, conv_id * 100 + turn AS n, {pick("turn * 7 + conv_id + length(text)", "concat('# ', substr(text, 1, 5))", "substr(text, 1, 9)", "'<!-- page_idx: 4 -->'", "'### x'", "concat('<!-- PAGE_INDEX:', CAST(turn AS VARCHAR(9)), '-->')", "'#none'", "substr(text, 3, 4)")} AS line FROM {{conversations}}"""}, sql=r"""
, p AS (SELECT *, nullif(TRY_CAST(regexp_extract(line, '(?i)<!--\s*page_(idx|index)\s*:\s*([0-9]+)\s*-->', 2) AS INT), 0) AS page, regexp_matches(line, '^#{1,6}\s+\S') AS head FROM t),
q AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n) AS before, row_number() OVER (PARTITION BY doc ORDER BY n) AS k FROM p),
f AS (SELECT a.doc, a.n, min(b.k) FILTER (WHERE b.page IS NOT NULL) AS place, min(b.k) FILTER (WHERE b.head) AS stop, arg_min(b.page, b.k) FILTER (WHERE b.page IS NOT NULL) AS soon FROM q a JOIN q b ON a.doc = b.doc AND b.k BETWEEN a.k + 1 AND a.k + 6 WHERE a.head GROUP BY a.doc, a.n)
SELECT q.doc, q.n, q.line, coalesce(before, CASE WHEN stop IS NULL OR place < stop THEN soon END) AS page FROM q LEFT JOIN f ON q.doc = f.doc AND q.n = f.n WHERE head""")
def _(t: DataFrame) -> DataFrame:
    return E.nearby_page(t, "doc", "n", "line")


@R.derived("chinese_numbers", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, concat(CASE CAST((l_partkey) % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN '十' WHEN 2 THEN '二十' WHEN 3 THEN '两' WHEN 4 THEN '九十' WHEN 5 THEN 'x' END, CASE CAST((l_suppkey) % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN '三' WHEN 2 THEN '十' WHEN 3 THEN '〇' WHEN 4 THEN '七' END) AS v FROM {lineitem}""",
}, sql=r"""
SELECT i, m.n FROM t LEFT JOIN (VALUES ('十', 10), ('二十', 20), ('两', 2), ('九十', 90), ('三', 3), ('〇', 0), ('七', 7), ('十三', 13), ('二十三', 23), ('九十三', 93), ('十〇', 10), ('二十〇', 20), ('九十〇', 90), ('十七', 17), ('二十七', 27), ('九十七', 97), ('两十', 20), ('十十', 20), ('二十十', 30), ('九十十', 100)) AS m(v, n) USING (v)""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.chinese_number(F.col("v")).alias("n"))


@R.derived("marker_statuses", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, concat(l_returnflag, CASE CAST((l_partkey) % 7 AS INT) WHEN 0 THEN '.mineru_done_frozen.json' WHEN 1 THEN '.done.json' WHEN 2 THEN '.popo_error.json' WHEN 3 THEN '.json' WHEN 4 THEN '.collected.json' WHEN 5 THEN '.mineru_done.json' WHEN 6 THEN 'done.json' END) AS k FROM {lineitem}""",
}, sql=r"""
SELECT i, CASE WHEN ends_with(k, '.mineru_done_frozen.json') THEN 'mineru_done_frozen' WHEN ends_with(k, '.mineru_done.json') THEN 'mineru_done' WHEN ends_with(k, '.done.json') THEN 'done' WHEN ends_with(k, '.popo_error.json') THEN 'popo_error' WHEN ends_with(k, '.collected.json') THEN 'collected' ELSE 'other' END AS status FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.marker_status(F.col("k")).alias("status"))


@R.derived("stage_files", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 5 AS INT) WHEN 0 THEN 'mineru' WHEN 1 THEN 'minerupopo' WHEN 2 THEN 'clean' WHEN 3 THEN 'raw' WHEN 4 THEN 'odd' END AS stage, concat(CASE CAST((l_suppkey) % 3 AS INT) WHEN 0 THEN 'manifest.json,' WHEN 1 THEN '' WHEN 2 THEN 'manifest.json,' END, CASE CAST((CAST(l_quantity AS INT)) % 6 AS INT) WHEN 0 THEN 'content_list.json' WHEN 1 THEN 'content_list_v2.json' WHEN 2 THEN 'document_tree.json' WHEN 3 THEN 'popo_raw.json' WHEN 4 THEN 'clean.md' WHEN 5 THEN 'other' END) AS files, CASE CAST((l_orderkey) % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN CAST(NULL AS INT) END AS n FROM {lineitem}""",
}, sql="""
, s AS (SELECT *, string_split(files, ',') AS f FROM t)
SELECT i, list_contains(f, 'manifest.json') AND CASE stage WHEN 'mineru' THEN list_has_any(f, ['content_list.json', 'content_list_v2.json']) WHEN 'minerupopo' THEN list_has_any(f, ['document_tree.json', 'popo_raw.json']) WHEN 'raw' THEN list_contains(f, 'clean.md') WHEN 'clean' THEN list_contains(f, 'clean.md') ELSE false END AS complete, list_has_any(f, ['content_list.json', 'content_list_v2.json']) OR coalesce(n, 0) > 0 AS usable FROM s""")
def _(t: DataFrame) -> DataFrame:
    files = F.split("files", ",")
    return t.select("i", E.stage_complete(F.col("stage"), files).alias("complete"), E.asset_usable(files, F.col("n")).alias("usable"))


@R.derived("review_stages", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 4 AS INT) WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN 'RAW' WHEN 2 THEN '' WHEN 3 THEN 'parse' END AS a, CASE CAST((l_suppkey) % 3 AS INT) WHEN 0 THEN 'x/clean-v1' WHEN 1 THEN 'b' WHEN 2 THEN CAST(NULL AS VARCHAR(9)) END AS b, CASE CAST((CAST(l_quantity AS INT)) % 3 AS INT) WHEN 0 THEN 'b' WHEN 1 THEN 'rawclean' WHEN 2 THEN 'Raw' END AS c, CASE CAST((l_orderkey) % 2 AS INT) WHEN 0 THEN 'raw/y' WHEN 1 THEN 'o' END AS d FROM {lineitem}""",
}, sql=r"""
SELECT i, CASE WHEN a = 'RAW' THEN 'raw' WHEN b = 'x/clean-v1' THEN 'clean' WHEN c = 'rawclean' THEN 'clean' WHEN c = 'Raw' THEN 'raw' WHEN d = 'raw/y' THEN 'raw' ELSE 'parse' END AS stage FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.review_stage(*(F.col(c) for c in "abcd")).alias("stage"))


@R.derived("doc_statuses", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 2 AS INT) WHEN 0 THEN 'mineru' WHEN 1 THEN 'popo' END AS stage, CASE CAST((l_suppkey) % 11 AS INT) WHEN 0 THEN 'Done' WHEN 1 THEN 'popo_done_frozen' WHEN 2 THEN 'mineru_done' WHEN 3 THEN 'failed' WHEN 4 THEN CAST(NULL AS VARCHAR(9)) WHEN 5 THEN 'timeout' WHEN 6 THEN 'mineru_succeeded' WHEN 7 THEN 'Success' WHEN 8 THEN 'partial' WHEN 9 THEN 'popo_completed' WHEN 10 THEN 'running' END AS status FROM {lineitem}""",
}, sql="""
SELECT i, coalesce(lower(status) IN ('succeeded', 'success', 'completed', 'done', stage || '_succeeded', stage || '_completed', stage || '_done', stage || '_done_frozen'), false) AS ok, coalesce(lower(status) IN ('succeeded', 'success', 'partial', 'failed', 'error', 'canceled', 'cancelled', 'timeout'), false) AS ended FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.doc_succeeded(F.col("stage"), F.col("status")).alias("ok"), E.batch_ended(F.col("status")).alias("ended"))


@R.derived("decision_statuses", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 7 AS INT) WHEN 0 THEN 'accept' WHEN 1 THEN 'rerun_clean' WHEN 2 THEN 'reject' WHEN 3 THEN 'no_change' WHEN 4 THEN 'rerun_raw' WHEN 5 THEN 'upstream_limited' WHEN 6 THEN 'rerun_standard' END AS d FROM {lineitem}""",
}, sql="SELECT i, CASE WHEN d = 'accept' THEN 'project_accepted' WHEN d IN ('rerun_raw', 'rerun_clean', 'rerun_standard', 'upstream_limited') THEN 'fix_proposed' WHEN d = 'reject' THEN 'project_rejected' ELSE 'rejected' END AS status FROM t")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.decision_status(F.col("d")).alias("status"))


@R.derived("root_cause_rules", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 7 AS INT) WHEN 0 THEN 'formula_broken' WHEN 1 THEN 'wrong_order' WHEN 2 THEN 'ocr_text_error' WHEN 3 THEN 'needs_ai_check' WHEN 4 THEN 'odd' WHEN 5 THEN 'needs_ai_check' WHEN 6 THEN 'table_broken' END AS kind, CASE CAST((l_suppkey) % 9 AS INT) WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS VARCHAR(9)) WHEN 2 THEN 'The LaTeX and a blank' WHEN 3 THEN '目录' WHEN 4 THEN '顺序' WHEN 5 THEN '目录页' WHEN 6 THEN 'a blank' WHEN 7 THEN 'Main idea' WHEN 8 THEN '排版' END AS note, l_orderkey % 2 = 0 AS raw FROM {lineitem}""",
}, sql=r"""
SELECT i, split_part(c, '|', 1) AS stage, split_part(c, '|', 2) AS label, split_part(c, '|', 3) AS target, CAST(split_part(c, '|', 4) AS DOUBLE) AS confidence FROM (SELECT i, CASE
 WHEN kind = 'formula_broken' THEN 'standard_rendering|math_rendering|standard|0.72' WHEN kind = 'table_broken' THEN 'standard_layout|html_layout|standard|0.56'
 WHEN kind = 'wrong_order' THEN CASE WHEN raw THEN 'raw_outline|anchor_application|raw|0.58' ELSE 'unknown_needs_review|qa_gate_gap|raw|0.58' END
 WHEN kind = 'ocr_text_error' THEN CASE WHEN raw THEN 'clean_underrepair|upstream_noise_absorption|clean|0.52' ELSE 'mineru_ocr_layout|upstream_noise_absorption|clean|0.52' END
 WHEN kind = 'needs_ai_check' THEN CASE note WHEN 'The LaTeX and a blank' THEN 'standard_rendering|math_rendering|standard|0.66' WHEN 'a blank' THEN 'standard_rendering|answer_blank_rendering|standard|0.62' WHEN '目录页' THEN 'clean_overclean|upstream_noise_absorption|clean|0.54'
  WHEN 'Main idea' THEN 'standard_grouping|block_assignment|standard|0.62' WHEN '排版' THEN 'standard_layout|html_layout|standard|0.60' WHEN '目录' THEN 'clean_overclean|upstream_noise_absorption|clean|0.48'
  WHEN '顺序' THEN CASE WHEN raw THEN 'raw_outline|anchor_application|raw|0.56' ELSE 'unknown_needs_review|qa_gate_gap|review|0.35' END ELSE 'unknown_needs_review|qa_gate_gap|review|0.35' END
 ELSE 'unknown_needs_review|qa_gate_gap|review|0.35' END AS c FROM t)""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.root_cause(F.col("kind"), F.col("note"), F.col("raw")).alias("c")).select("i", "c.*")


@R.derived("issue_dispositions", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'missing_raw_image_semantics' WHEN 1 THEN 'other' WHEN 2 THEN 'missing_raw_image_semantics' END AS k, CASE CAST((l_suppkey) % 5 AS INT) WHEN 0 THEN 'helper_icon' WHEN 1 THEN 'exercise_key_figure' WHEN 2 THEN 'explanation_key_figure' WHEN 3 THEN CAST(NULL AS VARCHAR(9)) WHEN 4 THEN 'decorative' END AS c, CASE CAST((CAST(l_quantity AS INT)) % 3 AS INT) WHEN 0 THEN 'compress_keep_near' WHEN 1 THEN '' WHEN 2 THEN CAST(NULL AS VARCHAR(9)) END AS a, l_orderkey % 2 = 0 AS v, l_linenumber % 2 = 0 AS o FROM {lineitem}""",
}, sql=r"""
SELECT i, CASE WHEN k <> 'missing_raw_image_semantics' OR c IS NULL THEN 'needs_review' WHEN c = 'helper_icon' AND a = 'compress_keep_near' AND NOT v THEN 'helper_icon_compact_rendering' WHEN c IN ('exercise_key_figure', 'explanation_key_figure') AND v THEN CASE WHEN o THEN 'covered_by_visual_outcome' ELSE 'real_context_gap' END WHEN c = 'explanation_key_figure' THEN 'explanation_artifact' ELSE 'needs_review' END AS disposition FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.disposition(*(F.col(c) for c in "kcavo")).alias("disposition"))


@R.derived("promotion_failures", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 4 AS INT) WHEN 0 THEN 'pass' WHEN 1 THEN 'review' WHEN 2 THEN CAST(NULL AS VARCHAR(9)) WHEN 3 THEN 'pass' END AS a, CASE CAST((l_suppkey) % 5 AS INT) WHEN 0 THEN 95 WHEN 1 THEN 89 WHEN 2 THEN CAST(NULL AS INT) WHEN 3 THEN 90 WHEN 4 THEN 99 END AS s, CASE CAST((CAST(l_quantity AS INT)) % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS o, CASE CAST((l_orderkey) % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 END AS u, CASE CAST((l_linenumber) % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN CAST(NULL AS INT) WHEN 2 THEN 1 END AS m FROM {lineitem}""",
}, sql="""
SELECT i, array_to_string(list_filter([CASE WHEN a IS DISTINCT FROM 'pass' THEN 'acceptance_not_pass' END, CASE WHEN coalesce(s, 0) < 90 THEN 'quality_below_90' END, CASE WHEN coalesce(o, 0) <> 0 THEN 'open_blocking_review_outcomes' END, CASE WHEN coalesce(u, 0) <> 0 THEN 'unresolved_blocking_issue_candidates' END, CASE WHEN coalesce(m, 0) <> 0 THEN 'missing_images' END], lambda x: x IS NOT NULL), ',') AS failures FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", F.array_join(E.promotion_failures(*(F.col(c) for c in "asoum")), ",").alias("failures"))


@R.derived("best_markdown", "lineitem", {
    "t": """SELECT concat('x', CAST(l_orderkey AS VARCHAR(9))) AS archive, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'a/b/' WHEN 2 THEN 'd/' END, CASE CAST((l_suppkey) % 4 AS INT) WHEN 0 THEN concat('x', CAST(l_orderkey AS VARCHAR(9))) WHEN 1 THEN 'y' WHEN 2 THEN 'a' WHEN 3 THEN concat('q', CAST(l_partkey AS VARCHAR(9))) END, CASE CAST((CAST(l_quantity AS INT)) % 4 AS INT) WHEN 0 THEN '.md' WHEN 1 THEN '_pages.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' END) AS name FROM {lineitem}""",
}, sql=r"""
SELECT archive, name AS markdown FROM (SELECT DISTINCT archive, name, row_number() OVER (PARTITION BY archive ORDER BY ends_with(name, '_pages.md'), NOT ends_with(name, '_pages.md') AND regexp_extract(name, '([^/]*)\.md$', 1) <> archive, CASE WHEN ends_with(name, '_pages.md') THEN 0 ELSE length(name) - length(replace(name, '/', '')) END, CASE WHEN ends_with(name, '_pages.md') THEN 0 ELSE length(name) END, name) AS place FROM (SELECT DISTINCT archive, name FROM t WHERE ends_with(name, '.md'))) WHERE place = 1""")
def _(t: DataFrame) -> DataFrame:
    return E.best_markdown(t, "archive", "name", F.col("archive"))


@R.derived("image_roles", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, concat(CASE CAST((l_partkey) % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'A map ' WHEN 2 THEN 'A dog ' WHEN 3 THEN 'Circle the word ' END, CASE CAST((l_suppkey) % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'here' WHEN 2 THEN '' END) AS said, CASE CAST((CAST(l_quantity AS INT)) % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'the QUESTION' WHEN 2 THEN 'a timeline' WHEN 3 THEN 'nothing' WHEN 4 THEN '' END AS near, l_suppkey * 2.0 AS w FROM {lineitem}""",
}, sql=r"""
SELECT i, CASE WHEN regexp_matches(lower(said || ' ' || near), 'before you read|skim|circle|complete|answer|question') THEN 'exercise_related' WHEN regexp_matches(lower(said || ' ' || near), 'chart|graph|table|diagram|map|timeline') THEN 'content_visual' WHEN said <> '' THEN 'captioned_image' WHEN least(w, 300.0) < 80 THEN 'small_decoration_or_icon' ELSE 'uncaptioned_image' END AS role FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", E.image_role(F.col("said"), F.col("near"), F.array(F.lit(0.0), F.lit(0.0), F.col("w").cast("double"), F.lit(300.0))).alias("role"))


@R.over("keyword_windows", "documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.transform(E.keyword_windows(F.coalesce("text", F.lit("")), ("isbn", "copyright", "license")), F.md5).alias("digests"))


@R.over("fuzzy_windows", "conversations")
def _(turns: DataFrame) -> DataFrame:
    """User turns against the lines of all turns of their conversation as a scan would give them: unchanged, with letters mistaken, or hardly
    to be read, by turn. No SQL; the tests hold it against brute force."""
    line, kind = F.col("line"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    scanned = F.when(kind == 0, line).when(kind == 1, F.replace(line, F.lit("en"), F.lit("cn"))).when(kind == 2, F.replace(F.replace(line, F.lit("i"), F.lit("")), F.lit("the"), F.lit("tbe"))).otherwise(F.translate(line, "aeiourst", "eiouatsr"))
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", scanned)
    clean = turns.filter("role = 'user'").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return E.fuzzy_windows(clean, lines, ["conv_id"], "turn", "at", id_="id", text="text", raw="line")
