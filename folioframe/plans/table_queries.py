"""Tables and nested layouts made from line items and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import closures, coverage, gates, grids
from folioframe.plans.registry import Registry, pick
from folioframe.sources import layout, publish
from folioframe.sources.sinks import shared_folder, stored

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: Each order is a document with one table of three cells a line; its rows stand on page 0, some of them lost and some between
#: them that are no cell, and in part on page 1.
_CELL_ROWS = """SELECT l_orderkey AS doc, l_linenumber AS line, l_shipdate AS shipped, l_partkey AS part, 0 AS k, concat('P', CAST(l_partkey % 50 AS VARCHAR(9))) AS t FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, 1, concat('Qty ', CAST(CAST(l_quantity AS INT) % 5 AS VARCHAR(9))) FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, 2, concat(l_returnflag, l_linestatus) FROM lineitem"""
_ROWS = """SELECT doc, 0 AS page, line * 10 + k * 2 AS o, t, k * 100 AS x, line * 20 AS y FROM c WHERE (doc + line * 3 + k) % 23 <> 0
 UNION ALL SELECT doc, 0, line * 10 + 1, 'between', 0, 0 FROM c WHERE k = 0 AND doc % 5 = 0
 UNION ALL SELECT doc, 1, line * 10 + k * 2, t, k * 50, line * 9 FROM c WHERE line <= 2 + doc % 3"""


@R.over("cell_coverage", "lineitem", sql=f"""
WITH l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) = 1), c AS ({_CELL_ROWS.replace("FROM lineitem", "FROM l")}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY o) AS rk FROM ({_ROWS})),
s AS (SELECT doc, count(*) AS n, sum(length(t)) AS chars FROM c GROUP BY doc HAVING count(*) >= 6), m AS (SELECT doc, t, count(*) AS most FROM c GROUP BY doc, t),
h AS (SELECT r.*, most FROM r JOIN m USING (doc, t) JOIN s USING (doc)),
w AS (SELECT a.doc, a.page, a.rk AS begins, a.o AS head, b.rk, b.o, b.t, b.x, b.y, b.most, row_number() OVER (PARTITION BY a.doc, a.page, a.rk, b.t ORDER BY b.rk) AS nth FROM h a JOIN h b ON a.doc = b.doc AND a.page = b.page AND b.rk BETWEEN a.rk AND a.rk + 17),
f AS (SELECT doc, page, begins, head, rk, o, count(*) OVER v AS n, sum(length(t)) OVER v AS chars, min(x) OVER v AS x0, min(y) OVER v AS y0, max(x + 40) OVER v AS x1, max(y + 10) OVER v AS y1 FROM w WHERE nth <= most WINDOW v AS (PARTITION BY doc, page, begins ORDER BY rk)),
g AS (SELECT f.*, f.n::DOUBLE / s.n AS a, f.chars::DOUBLE / s.chars AS b FROM f JOIN s USING (doc)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round((a + b) / 2 - (rk - begins + 1) * 0.001 - greatest((x1 - x0) * (y1 - y0), 1) * 1e-8, 9) DESC, page, begins, rk) AS place FROM g WHERE a >= 0.9 AND b >= 0.9)
SELECT doc, page, head::BIGINT AS first, o::BIGINT AS last, n::INT AS n_matched, round(a, 6) AS cell_coverage, round(b, 6) AS char_coverage, round((a + b) / 2, 4) AS match_score, concat_ws(',', x0::INT, y0::INT, x1::INT, y1::INT) AS box FROM p WHERE place = 1""")
def _(items: DataFrame) -> DataFrame:
    """The rows that cover the table of each order."""
    # The cells of an order are made once and written as one row; rows and tables are made of it where it lies.
    named = ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    once = items.select("l_orderkey", "l_linenumber", *named).repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")).agg(F.min(F.struct(*named)).alias("l")).select("doc", "line", "l.*")
    said = F.array(F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")), F.concat(F.lit("Qty "), (F.col("l_quantity").cast("int") % 5).cast("string")), F.concat("l_returnflag", "l_linestatus"))
    dealt = stored(once.select("doc", "line", said.alias("said")).groupBy("doc").agg(F.collect_list(F.struct("line", "said")).alias("lines"))).repartition("doc")
    line, row = F.col("l.line"), lambda page, o, t, x, y: F.struct(F.lit(page).alias("page"), o.alias("o"), t.alias("t"), F.array(x, y, x + 40, y + 10).alias("box"))
    cell = [F.col("l.said")[k] for k in range(3)]
    on = [F.when((F.col("doc") + line * 3 + k) % 23 != 0, row(0, line * 10 + k * 2, t, F.lit(k * 100), line * 20)) for k, t in enumerate(cell)]
    on += [F.when(F.col("doc") % 5 == 0, row(0, line * 10 + 1, F.lit("between"), F.lit(0), F.lit(0)))]
    on += [F.when(line <= 2 + F.col("doc") % 3, row(1, line * 10 + k * 2, t, F.lit(k * 50), line * 9)) for k, t in enumerate(cell)]
    rows = dealt.select("doc", F.explode("lines").alias("l")).select("doc", F.explode(F.array(*on)).alias("r")).filter("r IS NOT NULL").select("doc", "r.*")
    tables = dealt.select("doc", F.flatten("lines.said").alias("cells"), F.lit(1).alias("n"))
    found = coverage.cell_windows(tables, rows, "doc", "n", "cells", "page", "o", "t", "box")
    return found.drop("n").withColumn("box", F.array_join(F.transform("box", lambda x: x.cast("int").cast("string")), ","))


#: The layout of each order as JSON: its lines as nodes of five kinds, below two pages, the second without a number; one in eleven is cut off.
_LEAF = """concat('{"type": "', l_returnflag, '", "bbox": [', CAST(l_linenumber AS VARCHAR(9)), ', ', CAST(l_suppkey % 50 AS VARCHAR(9)), ', 90.5, 70], "text": "item ', CAST(l_partkey AS VARCHAR(9)), '"}')"""
_NODE = f"""CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN {_LEAF} WHEN 1 THEN concat('{{"blocks": [', {_LEAF}, ']}}')
 WHEN 2 THEN concat('{{"category_type": "poly", "poly": [5, 1, 9, 1, 9, ', CAST(l_linenumber AS VARCHAR(9)), ', 5, 8], "lines": [{{"spans": [{{"content": "two"}}, {{"content": "', l_linestatus, '"}}]}}, {{"spans": []}}]}}')
 WHEN 3 THEN concat('{{"bbox": [true, 1, 2, 3], "text": "no box", "blocks": [', {_LEAF}, ']}}') ELSE concat('{{"layout_dets": [[', {_LEAF}, ', {{"text": "", "blocks": {{"blocks": [', {_LEAF}, ', 5]}}}}]]}}') END"""
_LISTS = "SELECT l_orderkey AS id, {0} AS a, {1} AS b FROM ({2}) GROUP BY l_orderkey"
_LAYOUT = """SELECT id, concat('{"pdf_info": [{"page_idx": 7, "para_blocks": [', a, ']}, {"para_blocks": [', b, CASE WHEN id % 11 = 0 THEN '' ELSE ']}]}' END) AS j"""


@R.over("layout_walk", "lineitem", sql=f"""
WITH RECURSIVE l AS ({_LISTS.format("coalesce(string_agg(node, ', ' ORDER BY node) FILTER (l_linenumber <= 3), '')", "coalesce(string_agg(node, ', ' ORDER BY node) FILTER (l_linenumber > 3), '')", f"SELECT l_orderkey, l_linenumber, {_NODE} AS node FROM lineitem")}),
d AS (SELECT id, CAST(j AS JSON) AS j FROM ({_LAYOUT} FROM l) WHERE json_valid(j)),
o AS (SELECT id, coalesce(CAST(json_extract(j, '$.pdf_info[' || k || '].page_idx') AS INT), CAST(k AS INT)) AS page_idx, '[' || k || ']' AS path, json_extract(j, '$.pdf_info[' || k || ']') AS v FROM (SELECT id, j, unnest(range(0, CAST(json_array_length(j, '$.pdf_info') AS BIGINT))) AS k FROM d)
 UNION ALL SELECT id, page_idx, c.path, c.v FROM (SELECT id, page_idx, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN list_transform(range(0, CAST(json_array_length(v) AS BIGINT)), lambda i: {{'path': path || '[' || i || ']', 'v': json_extract(v, '$[' || i || ']')}})
  WHEN (json_type(v, '$.bbox[0]') <> 'BOOLEAN' OR json_type(v, '$.poly') = 'ARRAY') AND (json_extract_string(v, '$.text') <> '' OR json_type(v, '$.lines') = 'ARRAY') THEN []
  ELSE list_filter(list_transform(['para_blocks', 'layout_dets', 'blocks'], lambda k: {{'path': path || '.' || k, 'v': json_extract(v, '$.' || k)}}), lambda x: x.v IS NOT NULL) END) AS c FROM o WHERE json_type(v) IN ('ARRAY', 'OBJECT')))
SELECT id AS order_id, page_idx, path, coalesce(json_extract_string(v, '$.type'), json_extract_string(v, '$.category_type')) AS type, coalesce(json_extract_string(v, '$.text'), 'two ' || json_extract_string(v, '$.lines[0].spans[1].content')) AS text,
 CASE WHEN json_type(v, '$.poly') = 'ARRAY' THEN '5.0,1.0,9.0,' || CAST(greatest(8, CAST(json_extract(v, '$.poly[5]') AS DOUBLE)) AS VARCHAR) ELSE concat_ws(',', CAST(json_extract(v, '$.bbox[0]') AS DOUBLE), CAST(json_extract(v, '$.bbox[1]') AS DOUBLE), '90.5', '70.0') END AS bbox
FROM o WHERE json_type(v) = 'OBJECT' AND (json_type(v, '$.bbox[0]') <> 'BOOLEAN' OR json_type(v, '$.poly') = 'ARRAY') AND (json_extract_string(v, '$.text') <> '' OR json_type(v, '$.lines') = 'ARRAY')""")
def _(items: DataFrame) -> DataFrame:
    """All nodes of the layouts with a box and a text."""
    spark = items.sparkSession
    # Columns of a line are moved to its order, and its JSON is made there.
    dealt = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    nodes = spark.sql(f"SELECT l_orderkey AS order_id, l_linenumber, {_NODE.replace('VARCHAR(9)', 'STRING').replace('{', '{{').replace('}', '}}')} AS node FROM {{l}}", l=dealt)
    lists = nodes.groupBy("order_id").agg(*(F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("node")))), ", ").alias(n) for n, c in (("a", F.col("l_linenumber") <= 3), ("b", F.col("l_linenumber") > 3))))
    json = F.concat(F.lit('{"pdf_info": [{"page_idx": 7, "para_blocks": ['), "a", F.lit(']}, {"para_blocks": ['), "b", F.when(F.col("order_id") % 11 == 0, "").otherwise("]}]}"))
    found = layout.layout_nodes(lists.select("order_id", json.alias("j")), "order_id", "j")
    return found.withColumn("bbox", F.array_join(F.transform("bbox", lambda x: x.cast("string")), ","))


#: Two cells for each line of an order, with spans by part and supplier; an order is a table, its lines are rows.
_SPANS = """SELECT l_orderkey AS tab, CAST(l_linenumber - 1 AS INT) AS row, CAST(k AS INT) AS place, concat('c', CAST(k AS VARCHAR(9)), '-', CAST(min(l_partkey) AS VARCHAR(9))) AS text,
 CAST(min(l_partkey * (k + 1)) % 4 AS INT) AS rowspan, CASE WHEN k = 1 AND min(l_suppkey) % 5 = 0 THEN NULL ELSE CAST(min(l_suppkey + k) % 3 AS INT) END AS colspan
 FROM (SELECT *, 0 AS k FROM {lineitem} UNION ALL SELECT *, 1 FROM {lineitem}) AS x GROUP BY l_orderkey, l_linenumber, k"""


@R.derived("table_grid", "lineitem", {"cells": _SPANS}, sql="""
, n AS (SELECT *, greatest(1, rowspan) AS h, greatest(1, coalesce(colspan, 1)) AS w, row_number() OVER (PARTITION BY tab ORDER BY "row", place) AS k, max("row") OVER (PARTITION BY tab) AS lastrow FROM cells),
f AS (SELECT DISTINCT tab, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS taken, CAST(NULL AS BIGINT) AS x FROM n
 UNION ALL SELECT tab, k, list_transform(range(0, greatest(len(taken), spot + w)), lambda j: CASE WHEN j >= spot AND j < spot + w THEN "row" + h - 1 ELSE coalesce(taken[j + 1], -1) END), spot
 FROM (SELECT n.tab, n.k, n."row", n.h, n.w, f.taken, list_filter(range(0, len(f.taken) + 1), lambda c: len(list_filter(range(c, c + n.w), lambda j: coalesce(f.taken[j + 1], -1) >= n."row")) = 0)[1] AS spot FROM f JOIN n ON n.tab = f.tab AND n.k = f.k + 1)),
p AS (SELECT n.*, f.x FROM n JOIN f ON n.tab = f.tab AND n.k = f.k)
SELECT tab, y::INT AS y, (x + j)::INT AS x, text, y = "row" AND j = 0 AS origin FROM (SELECT *, unnest(range(0, w)) AS j FROM (SELECT *, unnest(range("row", least("row" + h - 1, lastrow) + 1)) AS y FROM p))""".replace("WITH ", ""))
def _(cells: DataFrame) -> DataFrame:
    """Every square of the tables, spans laid out."""
    return grids.laid_out(cells, "tab")


ORACLE["table_grid"] = ORACLE["table_grid"].replace("WITH cells", "WITH RECURSIVE cells", 1)
#: A table of two rows for each order: a paradigm's header but for one in seven, and a body of runs, as many as the order has lines; one column in some is a run short.
_PARADIGM = """SELECT l_orderkey AS tab, l_linenumber AS line, min(l_partkey) AS part FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


@R.derived("table_reflow", "lineitem", {"p": _PARADIGM}, sql="""
, c AS (SELECT tab, count(*) AS n, list('I say ' || line ORDER BY line) AS a, list('I say not ' || line ORDER BY line) AS b, list('Do I say ' || line || '?' ORDER BY line) AS q, list(CASE WHEN part % 2 = 0 THEN 'Yes, I do.' ELSE 'No, I do not.' END ORDER BY line) AS s FROM p GROUP BY tab),
d AS (SELECT *, tab % 7 <> 0 AND n >= 3 AND tab % 5 <> 0 AS fits FROM c),
h AS (SELECT tab, 0 AS y, unnest(range(0, 4)) AS x, unnest(['Affirmative', CASE WHEN tab % 7 = 0 THEN 'Other' ELSE 'Negative' END, 'Questions', 'Short answers']) AS text FROM d),
r AS (SELECT tab, k AS y, unnest(range(0, 4)) AS x, unnest([a[k], b[k], q[k], s[k]]) AS text FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM d WHERE fits)),
o AS (SELECT tab, 1 AS y, unnest(range(0, 4)) AS x, unnest([array_to_string(a, chr(10)), array_to_string(CASE WHEN tab % 5 = 0 THEN b[2:] ELSE b END, chr(10)), array_to_string(q, ' '), array_to_string(s, ' ')]) AS text FROM d WHERE NOT fits)
SELECT tab, y::INT AS y, x::INT AS x, text FROM h UNION ALL SELECT tab, y::INT, x::INT, text FROM r UNION ALL SELECT tab, y::INT, x::INT, text FROM o""")
def _(p: DataFrame) -> DataFrame:
    """Grids of the tables, paradigms rebuilt from their runs."""
    said = lambda *parts: F.transform(F.array_sort(F.collect_list(F.struct("line", F.concat(*parts).alias("t")))), lambda x: x["t"])
    line = F.col("line").cast("string")
    runs = p.groupBy("tab").agg(said(F.lit("I say "), line).alias("a"), said(F.lit("I say not "), line).alias("b"), said(F.lit("Do I say "), line, F.lit("?")).alias("q"), said(F.when(F.col("part") % 2 == 0, "Yes, I do.").otherwise("No, I do not.")).alias("s"))
    short = F.when(F.col("tab") % 5 == 0, F.slice("b", 2, F.size("b"))).otherwise(F.col("b"))
    header = F.array(F.lit("Affirmative"), F.when(F.col("tab") % 7 == 0, "Other").otherwise("Negative"), F.lit("Questions"), F.lit("Short answers"))
    body = F.array(F.array_join("a", "\n"), F.array_join(short, "\n"), F.array_join("q", " "), F.array_join("s", " "))
    rows = runs.select("tab", F.posexplode(F.array(header, body)).alias("row", "cells")).select("tab", "row", F.posexplode("cells").alias("place", "text"))
    return grids.reflowed(rows.withColumn("rowspan", F.lit(1)).withColumn("colspan", F.lit(1)), "tab")


#: Review outcomes of each order: packets of four kinds with decisions, and corrections with or without evidence; parts of some orders are closed later.
_OUTCOMES = f"""SELECT l_orderkey AS doc, {pick("l_partkey", "'table'", "'formula'", "'image'", "'correction'", "'image'")} AS packet, {pick("l_suppkey", "'accepted'", "'needs_layout_review'", "'needs_source_bbox'", "CAST(NULL AS VARCHAR(9))")} AS decision,
 l_suppkey % 4 IN (1, 2) AS open, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity > 10 END AS blocking, l_suppkey % 9 <> 0 AS evidence, l_orderkey % 6 = 0 AND l_quantity > 20 AS later FROM {{lineitem}}"""
_SCORES = """SELECT o_orderkey AS doc, CAST(80 + o_custkey % 20 AS INT) AS score, 'review' AS quality_status, CASE WHEN o_custkey % 11 = 0 THEN 'review' ELSE 'pass' END AS table_status FROM {orders}"""


@R.derived("gate_refresh", "lineitem orders", {"x": _OUTCOMES, "s": _SCORES}, sql="""
, a AS (SELECT doc, packet, CASE WHEN later AND open THEN 'accepted' ELSE coalesce(decision, '') END AS decision, open AND NOT later AS open, coalesce(blocking, false) AS blocking, evidence FROM x),
g AS (SELECT doc, count(*) FILTER (packet <> 'correction') AS outcome_count, count(*) FILTER (packet <> 'correction' AND NOT open) AS closed_count, count(*) FILTER (packet <> 'correction' AND open AND blocking) AS open_blocking_count,
 count(*) FILTER (packet IN ('table', 'formula')) AS tables, count(*) FILTER (packet IN ('table', 'formula') AND open AND blocking) AS table_formula_open_blocking_count, count(*) FILTER (packet = 'correction') AS correction_count, count(*) FILTER (packet = 'correction' AND NOT evidence) AS corrections_without_evidence FROM a GROUP BY doc),
k AS (SELECT doc, string_agg(decision || '=' || n, ',' ORDER BY decision || '=' || n) AS decision_counts FROM (SELECT doc, decision, count(*) AS n FROM a WHERE packet <> 'correction' GROUP BY doc, decision) GROUP BY doc),
c AS (SELECT doc, bool_or(later AND open) AS refreshed FROM x GROUP BY doc),
j AS (SELECT s.doc, score, s.quality_status AS was, coalesce(outcome_count, 0) AS outcome_count, coalesce(closed_count, 0) AS closed_count, coalesce(open_blocking_count, 0) AS open_blocking_count, coalesce(table_formula_open_blocking_count, 0) AS table_formula_open_blocking_count, coalesce(correction_count, 0) AS correction_count, coalesce(corrections_without_evidence, 0) AS corrections_without_evidence,
 CASE WHEN open_blocking_count > 0 THEN 'review' ELSE 'pass' END AS review_outcomes, CASE WHEN tables > 0 THEN CASE WHEN table_formula_open_blocking_count > 0 THEN 'review' ELSE 'pass' END ELSE table_status END AS formula_table_integrity, CASE WHEN corrections_without_evidence > 0 THEN 'fail' ELSE 'pass' END AS correction_evidence,
 coalesce(decision_counts, '') AS decision_counts, coalesce(refreshed, false) AS refreshed FROM s LEFT JOIN g USING (doc) LEFT JOIN k USING (doc) LEFT JOIN c USING (doc)),
q AS (SELECT *, CASE WHEN correction_evidence = 'fail' THEN 'fail' WHEN review_outcomes = 'review' OR formula_table_integrity = 'review' THEN 'review' ELSE 'pass' END AS acceptance FROM j)
SELECT * EXCLUDE (score, was), CASE WHEN acceptance = 'pass' AND score >= 90 THEN 'pass' ELSE was END AS quality_status FROM q""")
def _(x: DataFrame, s: DataFrame) -> DataFrame:
    """Gates of all orders after closures, of which only the orders with a closure were aggregated again."""
    before = x.select("doc", "packet", "decision", "open", "blocking", "evidence")
    after = gates.closed(x, F.col("later")).select(*before.columns)
    changed = gates.changed_documents(gates.state_of(before, "doc"), after, "doc")
    return gates.refresh(gates.gates(before, s, "doc"), changed, after, s, "doc")


@R.derived("published_mirror", "orders", {"o": "SELECT concat('clean/', CAST(o_custkey AS VARCHAR(9)), '/', CAST(o_orderkey AS VARCHAR(9)), '.json') AS key, o_orderstatus AS status, o_totalprice AS price FROM {orders}"}, sql="""
SELECT key, status, price FROM o WHERE status <> 'P' AND NOT starts_with(key, 'clean/7/')""")
def _(o: DataFrame) -> DataFrame:
    """What is left after two publishes, the second with fewer keys, and the deletion of a prefix."""
    spark, root = o.sparkSession, shared_folder(o.sparkSession)
    publish.publish(o, root, ["status"])
    publish.publish(o.filter("status <> 'P'"), root, ["status"])
    publish.delete_prefix(spark, root, "key", "clean/7/", "clean", ["status"])
    return publish.published(spark, root).select("key", "status", "price")


#: Outcomes, audits, packets and blocks of each order: a line is an outcome, two lines share a block.
_BASE = "SELECT l_orderkey AS doc, l_linenumber AS line, min(l_partkey) AS p, min(l_suppkey) AS s, min(CAST(l_quantity AS INT)) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_BLOCK = pick("line", "'b-0'", "'b-1'", "'b-1'", "'b-2'", "'b-2'", "'b-3'", "'b-3'")
_NAME = "concat('o-', CAST(line AS VARCHAR(9)))"
_CLOSING = {
    "base": _BASE,
    "o": f"SELECT doc, {_NAME} AS outcome_id, {_BLOCK} AS block_id, {pick('p', "'formula_visual_review'", "'image_source_visual_confirmation'", "'formula_visual_review'", "'table_visual_review'")} AS packet_type, {pick('s', "'open'", "'closed'", "'open'")} AS status, {pick('q', "'needs_layout_review'", "'accepted_by_rule'", "'accepted_by_rule'", "CAST(NULL AS VARCHAR(9))")} AS decision, CASE WHEN q % 5 = 0 THEN NULL ELSE p % 7 <> 0 END AS blocking, {pick('s', "'crop.png'", "'crop.png'", "''")} AS crop, {pick('q', "'created'", "'reused'", "'missing'")} AS crop_status FROM {{base}}",
    "b": f"SELECT DISTINCT doc, {_BLOCK} AS block_id, {pick('doc', "'![a](b.png)'", "'x ![a](b.png)'", "' <img src=c.png> '", "'<img src=\"c.png\"> ![](d.png)'")} AS markdown, {pick('doc + 1', "''", "' '", "'said'", "CAST(NULL AS VARCHAR(9))", "''")} AS text FROM {{base}}",
    "a": f"SELECT doc, {_NAME} AS outcome_id, {pick('p + s', "'deterministic_closure_candidate_exact_match'", "'deterministic_formula_semantic_equivalent'", "'other'")} AS bucket, {pick('q', "'a.png'", "'b.png'", "'c.png'", "''")} AS crop, {pick('s', "'created'", "'reused'", "''")} AS crop_status, CASE WHEN q % 6 = 0 THEN 0 ELSE line END AS page_number, p % 8 <> 0 AS boxed, q % 3 <> 1 AS semantic_key_equal, {pick('p', "'raw_content_list.formula_semantic_key_match'", "'raw_context_window.high_confidence_for_manual_review'", "'odd'")} AS match_rule FROM {{base}} WHERE (doc + line) % 5 <> 0",
    "k": f"SELECT doc, {_NAME} AS outcome_id, {pick('q', "''", "'raw_context_window.high_confidence_for_manual_review'", "CAST(NULL AS VARCHAR(9))", "''")} AS match_rule, {pick('s', "'text'", "'equation'", "'table'", "'image'")} AS raw_type, {pick('p', "'created'", "'no'")} AS packet_crop_status FROM {{base}} WHERE line <> 5",
}
_VERDICTS = """,
i AS (SELECT f.doc, f.outcome_id, 'image_only_formula' AS rule, CASE WHEN trim(coalesce(b.text, '')) <> '' THEN 'block_text_not_empty' WHEN v.evidence IS NULL THEN 'closed_image_outcome_missing' ELSE 'image_only_formula_covered_by_image' END AS reason, v.evidence
 FROM o f JOIN b USING (doc, block_id) LEFT JOIN (SELECT doc, block_id, min(outcome_id) AS evidence FROM o WHERE packet_type = 'image_source_visual_confirmation' AND status = 'closed' AND decision = 'accepted_by_rule' AND crop_status IN ('created', 'reused') AND crop <> '' GROUP BY doc, block_id) v USING (doc, block_id)
 WHERE f.packet_type = 'formula_visual_review' AND f.status = 'open' AND f.blocking AND b.markdown IN ('![a](b.png)', '<img src="c.png"> ![](d.png)')),
e AS (SELECT a.doc, a.outcome_id, 'native_exact' AS rule, CASE WHEN coalesce(k.match_rule, '') <> '' THEN 'source_match_rule_not_native_raw_content' WHEN coalesce(raw_type, '') NOT IN ('text', 'equation', 'table') THEN 'source_raw_type_not_allowed' WHEN coalesce(nullif(crop_status, ''), packet_crop_status, '') NOT IN ('created', 'reused') THEN 'source_crop_not_ready'
 WHEN page_number = 0 OR NOT boxed THEN 'source_page_bbox_missing' WHEN crop = '' THEN 'source_crop_missing' ELSE 'native_raw_content_exact_match_with_crop' END AS reason, crop AS evidence FROM a LEFT JOIN k USING (doc, outcome_id) WHERE bucket = 'deterministic_closure_candidate_exact_match'),
m AS (SELECT doc, outcome_id, 'semantic_equivalent' AS rule, CASE WHEN semantic_key_equal AND match_rule <> 'odd' AND page_number <> 0 AND boxed AND crop <> '' AND crop_status <> '' THEN 'formula_semantic_key_equal' ELSE 'evidence_incomplete' END AS reason, crop AS evidence FROM a WHERE bucket = 'deterministic_formula_semantic_equivalent'),
w AS (SELECT *, reason IN ('image_only_formula_covered_by_image', 'native_raw_content_exact_match_with_crop', 'formula_semantic_key_equal') AS closes FROM (SELECT * FROM i UNION ALL SELECT * FROM e UNION ALL SELECT * FROM m))"""


def _judged(o: DataFrame, b: DataFrame, a: DataFrame, k: DataFrame) -> DataFrame:
    audits = a.withColumn("bbox", F.when(F.col("boxed"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).otherwise(F.array().cast("array<int>"))).drop("boxed")
    return closures.image_only_formulas(o, b, "doc").unionByName(closures.exact_matches(o, audits, k, "doc")).unionByName(closures.semantic_matches(o, audits, "doc"))


@R.derived("closure_verdicts", "lineitem", _CLOSING, sql=f"{_VERDICTS} SELECT doc, outcome_id, rule, reason, closes, CASE WHEN closes THEN evidence END AS evidence FROM w")
def _(base: DataFrame, o: DataFrame, b: DataFrame, a: DataFrame, k: DataFrame) -> DataFrame:
    """What each rule says of the outcomes it looks at."""
    return _judged(o, b, a, k)


@R.derived("closure_reports", "lineitem", _CLOSING, sql=f"""{_VERDICTS},
t AS (SELECT o.*, r.rule, CASE WHEN r.rule IS NULL THEN NULL WHEN status = 'closed' AND coalesce(decision IN ('accepted_by_rule', 'non_blocking'), false) THEN 'already_closed' ELSE 'newly_closed' END AS closing FROM o LEFT JOIN (SELECT doc, outcome_id, min(rule) AS rule FROM w WHERE closes GROUP BY doc, outcome_id) r USING (doc, outcome_id)),
n AS (SELECT doc, CASE WHEN closing = 'newly_closed' THEN 'closed' ELSE status END AS status, coalesce(CASE WHEN closing = 'newly_closed' THEN CASE rule WHEN 'image_only_formula' THEN 'non_blocking' ELSE 'accepted_by_rule' END ELSE decision END, '') AS decision, CASE WHEN closing = 'newly_closed' THEN false ELSE blocking END AS blocking, closing FROM t)
SELECT doc, count(*) AS n_outcomes, count(*) FILTER (status = 'closed') AS closed_count, count(*) FILTER (status = 'open' AND blocking) AS open_blocking_count, count(*) FILTER (closing = 'newly_closed') AS newly_closed, count(*) FILTER (closing = 'already_closed') AS already_closed, any_value(d.decisions) AS decisions, coalesce(any_value(s.skipped), '') AS skipped
FROM n JOIN (SELECT doc, string_agg(x, ',' ORDER BY x) AS decisions FROM (SELECT doc, decision || '=' || count(*) AS x FROM n GROUP BY doc, decision) GROUP BY doc) d USING (doc) LEFT JOIN (SELECT doc, string_agg(x, ',' ORDER BY x) AS skipped FROM (SELECT doc, rule || '/' || reason || '=' || count(*) AS x FROM w WHERE NOT closes GROUP BY doc, rule, reason) GROUP BY doc) s USING (doc) GROUP BY doc""")
def _(base: DataFrame, o: DataFrame, b: DataFrame, a: DataFrame, k: DataFrame) -> DataFrame:
    """Counts of each order's outcomes after the three rules have closed what they can."""
    verdicts = stored(_judged(o, b, a, k))
    return closures.closure_report(stored(closures.closed_by_rule(o, verdicts, "doc")), verdicts, "doc")
