"""Rules and joins over rows derived from the given tables: both engines derive them by the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import blocks as B
from folioframe.operators import lineage as L
from folioframe.operators import matching as M
from folioframe.operators import review as V
from folioframe.plans.registry import Registry, pick

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_HEADINGS = "(VALUES ('d1', 1, 1, 'Part One'), ('d1', 2, 2, 'Lesson A'), ('d1', 3, 3, '1.1 Words'), ('d1', 4, 2, 'Lesson B'), ('d1', 5, 1, 'Part Two'), ('d1', 6, 3, 'Skip C'), ('d1', 7, 3, 'Skip D'), ('d2', 1, 2, 'Alone'), ('d2', 2, 1, 'Top')) AS t(doc, n, level, title)"


@R.derived("heading_path", "conversations", {
    "h": """SELECT conv_id AS doc, turn AS n, CAST(1 + (conv_id * 3 + turn * 5 + length(text)) % 3 AS INT) AS level, substr(text, 1, 9) AS title FROM {conversations}""",
}, sql="""
SELECT doc, n, array_to_string(list_filter([p1, p2, p3], lambda x: x IS NOT NULL), '/') AS path FROM (
SELECT doc, n, level,
 (SELECT arg_max(title, n) FROM h a WHERE a.doc = h.doc AND a.n <= h.n AND a.level = 1) AS p1,
 (SELECT arg_max(title, n) FROM h a WHERE a.doc = h.doc AND a.n <= h.n AND a.level = 2 AND NOT EXISTS (SELECT 1 FROM h b WHERE b.doc = h.doc AND b.n > a.n AND b.n <= h.n AND b.level < 2)) AS p2,
 (SELECT arg_max(title, n) FROM h a WHERE a.doc = h.doc AND a.n <= h.n AND a.level = 3 AND NOT EXISTS (SELECT 1 FROM h b WHERE b.doc = h.doc AND b.n > a.n AND b.n <= h.n AND b.level < 3)) AS p3 FROM h)""")
def _(h: DataFrame) -> DataFrame:
    return B.heading_path(h, "doc", "n", "level", "title", 3).select("doc", "n", F.array_join("path", "/").alias("path"))


@R.derived("heading_path_positional", "conversations", {
    "h": """SELECT conv_id AS doc, turn AS n, CAST(1 + (conv_id * 3 + turn * 5 + length(text)) % 3 AS INT) AS level, substr(text, 1, 9) AS title FROM {conversations}""",
})  # a fold: the tests hold it against a stack
def _(h: DataFrame) -> DataFrame:
    return B.heading_path_positional(h, "doc", "n", "level", "title").select("doc", "n", F.array_join("path", "/").alias("path"))


@R.derived("heading_checks", "conversations", {
    "h": """SELECT conv_id % 7 AS doc, CAST(1 + turn % 3 AS INT) AS level, concat(CASE CAST((turn + conv_id) % 4 AS INT) WHEN 0 THEN '1.1 ' WHEN 1 THEN '' WHEN 2 THEN '2.10 ' WHEN 3 THEN '3. ' END, substr(text, 1, 3)) AS title FROM {conversations}""",
}, sql="SELECT doc, level, count(*) AS n, count(DISTINCT title) AS n_titles, count(*) FILTER (WHERE regexp_matches(title, '^[0-9]+\\.[0-9]+ ')) AS n_numbered FROM h GROUP BY doc, level")
def _(h: DataFrame) -> DataFrame:
    return h.groupBy("doc", "level").agg(F.count("*").alias("n"), F.countDistinct("title").alias("n_titles"), F.count_if(F.rlike("title", F.lit(r"^[0-9]+\.[0-9]+ "))).alias("n_numbered"))


@R.derived("page_unit_interval", "conversations", {
    "p": """SELECT conv_id AS doc, turn AS page FROM {conversations}""",
    "u": """SELECT conv_id AS doc, turn AS idx, concat('u', CAST(turn AS VARCHAR(9)), substr(text, 1, 5)) AS unit, turn + conv_id % 2 AS s, CASE CAST((conv_id + turn) % 3 AS INT) WHEN 0 THEN turn + 1 WHEN 1 THEN CAST(NULL AS BIGINT) WHEN 2 THEN turn END AS e FROM {conversations} WHERE (conv_id + turn * 2) % 3 <> 0""",
}, sql=r"""
SELECT p.doc, p.page, coalesce((SELECT arg_max(unit, (coalesce(p.page <= e, true), s, idx)) FROM u WHERE u.doc = p.doc AND s <= p.page), (SELECT arg_min(unit, (s, idx)) FROM u WHERE u.doc = p.doc)) AS owner FROM p""")
def _(p: DataFrame, u: DataFrame) -> DataFrame:
    return B.interval_owner(p, u, "doc", "page", "s", "e", "idx", "unit").select("doc", "page", "owner")


@R.derived("bbox_union", "lineitem", {
    "b": """SELECT l_orderkey AS k, CAST(l_linenumber * 10 AS DOUBLE) AS x0, CAST(l_suppkey AS DOUBLE) AS y0, l_linenumber * 10 + l_quantity AS x1, CAST(l_suppkey + 20 AS DOUBLE) AS y1 FROM {lineitem}""",
}, sql="SELECT k, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1, count(*) AS n_boxes FROM b GROUP BY k")
def _(b: DataFrame) -> DataFrame:
    return M.bbox_union(b.select("k", F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))).alias("box")), ["k"], "box")


@R.derived("bbox_normalise", "lineitem", {
    "b": """SELECT l_orderkey * 8 + l_linenumber AS i, CAST((l_partkey * 1 + l_suppkey * 2) % 97 AS INT) AS a, CAST((l_partkey * 3 + l_suppkey * 5) % 97 AS INT) AS b, CAST((l_partkey * 5 + l_suppkey * 3) % 97 AS INT) AS c, CAST((l_partkey * 7 + l_suppkey * 1) % 97 AS INT) AS d, CAST((l_partkey * 11 + l_suppkey * 7) % 97 AS INT) AS e, CAST((l_partkey * 13 + l_suppkey * 4) % 97 AS INT) AS f, CAST((l_partkey * 17 + l_suppkey * 9) % 97 AS INT) AS g, CAST((l_partkey * 19 + l_suppkey * 6) % 97 AS INT) AS h FROM {lineitem}""",
}, sql="SELECT i, least(a, c, e, g) AS x0, least(b, d, f, h) AS y0, greatest(a, c, e, g) AS x1, greatest(b, d, f, h) AS y1 FROM b")
def _(b: DataFrame) -> DataFrame:
    box = X.bbox(F.array(*"abcdefgh"))
    return b.select("i", *(F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


@R.derived("bbox_pixels", "lineitem", {
    "b": """SELECT l_orderkey * 8 + l_linenumber AS i, CAST(l_partkey % 1001 AS INT) AS a, CAST(l_suppkey * 10 AS INT) AS b, CAST(1000 - l_linenumber AS INT) AS c, CAST(l_quantity * 20 AS INT) AS d, CAST(300 + l_suppkey * 20 AS DOUBLE) AS w, CAST(500 + l_linenumber * 100 AS DOUBLE) AS h FROM {lineitem}""",
}, sql="""
SELECT i, round(greatest(0, least(w, a / 1000.0 * w - greatest(4, least(w, h) * 0.006))), 4)::DOUBLE AS x0, round(greatest(0, least(h, b / 1000.0 * h - greatest(4, least(w, h) * 0.006))), 4)::DOUBLE AS y0,
round(greatest(0, least(w, c / 1000.0 * w + greatest(4, least(w, h) * 0.006))), 4)::DOUBLE AS x1, round(greatest(0, least(h, d / 1000.0 * h + greatest(4, least(w, h) * 0.006))), 4)::DOUBLE AS y1 FROM b""")
def _(b: DataFrame) -> DataFrame:
    box = X.bbox_pixels(F.array(*(F.col(c).cast("double") for c in "abcd")), F.col("w").cast("double"), F.col("h").cast("double"))
    return b.select("i", *(F.round(F.get(box, F.lit(k)), 4).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


_LEFT = "(VALUES (1, 'alphabet'), (2, 'alphabet'), (3, 'betagamma'), (4, 'tiny'), (5, 'tiny'), (6, 'gammaray'), (7, 'gammaray')) AS t(l, k)"
_RIGHT = "(VALUES (10, 'alphabet'), (20, 'alphabet'), (30, 'betagamma'), (40, 'tiny'), (50, 'tiny'), (60, 'gammaray'), (70, 'gammaray'), (80, 'gammaray')) AS t(r, k)"


@R.derived("ordinal_join", "lineitem", {
    "a": """SELECT min(k) AS k, l FROM (SELECT l_orderkey * 8 + min(l_linenumber) AS l, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN 'tiny' WHEN 2 THEN 'gammaray' END, CAST(l_suppkey AS VARCHAR(9)), CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN '' WHEN 2 THEN 'r' END) AS k FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey HAVING l_orderkey % 9 <> 0) AS x GROUP BY l""",
    "b": """SELECT min(k) AS k, r FROM (SELECT l_orderkey * 8 + min(l_linenumber) AS r, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN 'tiny' WHEN 2 THEN 'gammaray' END, CAST(l_suppkey AS VARCHAR(9)), CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN '' WHEN 2 THEN 'r' END) AS k FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey HAVING l_orderkey % 9 <> CAST(l_suppkey % 4 AS INT)) AS x GROUP BY r""",
}, sql="""
, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l) AS rn, count(*) OVER (PARTITION BY k) AS n FROM a WHERE length(k) >= 6), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS rn, count(*) OVER (PARTITION BY k) AS n FROM b)
SELECT x.k, l, r FROM x JOIN y ON x.k = y.k AND x.rn = y.rn WHERE x.n = y.n AND x.n >= 2""")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return M.ordinal_join(a, b, "k", "l", "r")


@R.derived("duplicate_consumption", "lineitem", {
    "a": """SELECT min(k) AS k, l FROM (SELECT l_orderkey * 8 + min(l_linenumber) AS l, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN 'tiny' WHEN 2 THEN 'gammaray' END, CAST(l_suppkey AS VARCHAR(9)), CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN '' WHEN 2 THEN 'r' END) AS k FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey HAVING l_orderkey % 9 <> 0) AS x GROUP BY l""",
    "b": """SELECT min(k) AS k, r FROM (SELECT l_orderkey * 8 + min(l_linenumber) AS r, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN 'tiny' WHEN 2 THEN 'gammaray' END, CAST(l_suppkey AS VARCHAR(9)), CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'alphabet' WHEN 1 THEN '' WHEN 2 THEN 'r' END) AS k FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey HAVING l_orderkey % 9 <> CAST(l_suppkey % 4 AS INT)) AS x GROUP BY r""",
}, sql="""
, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l) AS rn FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS rn, count(*) OVER (PARTITION BY k) AS n FROM b)
SELECT x.k, l, r FROM x JOIN y ON x.k = y.k AND y.rn = least(x.rn, y.n)""")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return M.consume_in_order(a, b, "k", "l", "r")


@R.derived("unique_locator", "lineitem", {
    "a": """SELECT min(k) AS k, l FROM (SELECT l_orderkey * 8 + l_linenumber AS l, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'key' WHEN 1 THEN 'ke' WHEN 2 THEN 'longer key ' END, CAST(l_partkey AS VARCHAR(9))) AS k FROM {lineitem}) AS x GROUP BY l""",
    "b": """SELECT min(k) AS k, r FROM (SELECT l_orderkey * 8 + l_linenumber AS r, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'key' WHEN 1 THEN 'ke' WHEN 2 THEN 'longer key ' END, CAST(l_partkey AS VARCHAR(9))) AS k FROM {lineitem} WHERE l_orderkey % 5 = 0) AS x GROUP BY r""",
}, sql="""
, c AS (SELECT k, count(*) AS n, min(r) AS r FROM b GROUP BY k)
SELECT l, a.k, CASE WHEN length(a.k) < 8 THEN 'key_too_short' WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS match_status, CASE WHEN length(a.k) >= 8 AND n = 1 THEN r END AS match_id FROM a LEFT JOIN c USING (k)""")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return M.unique_key_join(a, b, "k", "r", 8)


@R.derived("band_join", "orders", {
    "a": """SELECT o_orderkey AS n, CASE CAST((o_custkey) % 2 AS INT) WHEN 0 THEN 'text' WHEN 1 THEN 'table' END AS kind, CAST(o_custkey % 50 AS DOUBLE) AS x FROM {orders}""",
    "b": """SELECT o_orderkey AS n, CASE CAST((o_custkey + o_orderkey) % 3 AS INT) WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'text' END AS kind, CAST(o_custkey % 50 + (o_orderkey % 5) * 0.5 - 0.75 AS DOUBLE) AS x FROM {orders} WHERE o_orderkey % 7 <> 0""",
}, sql="SELECT a.n, coalesce(a.kind = b.kind AND abs(a.x - b.x) <= 1.0, false) AS matched FROM a LEFT JOIN b ON a.n = b.n")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("n", F.col("kind").alias("kind2"), F.col("x").alias("x2"))
    return a.join(other, "n", "left").select("n", F.coalesce((F.col("kind") == F.col("kind2")) & (F.abs(F.col("x") - F.col("x2")) <= 1.0), F.lit(False)).alias("matched"))


_BAGS = """SELECT l_orderkey * 8 + l_linenumber + l_partkey * 1000000 + l_suppkey * 1000 AS i, concat('a b b ', l_returnflag, ' ', CAST(l_linenumber % 3 AS VARCHAR(9))) AS want, concat('a ', l_linestatus, ' b c ', CAST(l_suppkey % 3 AS VARCHAR(9)), CASE WHEN l_partkey % 2 = 0 THEN ' b 1' ELSE '' END) AS have FROM {lineitem}"""


@R.derived("multiset_coverage", "lineitem", {"t": f"SELECT i, min(want) AS want, min(have) AS have FROM ({_BAGS}) AS x GROUP BY i"}, sql="""
, w AS (SELECT i, unnest(string_split(want, ' ')) AS k FROM t), h AS (SELECT i, unnest(string_split(have, ' ')) AS k FROM t),
wc AS (SELECT i, k, count(*) AS n FROM w GROUP BY ALL), hc AS (SELECT i, k, count(*) AS n FROM h GROUP BY ALL),
b AS (SELECT wc.i, sum(least(wc.n, coalesce(hc.n, 0))) AS n FROM wc LEFT JOIN hc ON wc.i = hc.i AND wc.k = hc.k GROUP BY wc.i)
SELECT t.i, round(b.n * 1.0 / len(string_split(want, ' ')), 6)::DOUBLE AS coverage, round((len(string_split(have, ' ')) - b.n) * 1.0 / len(string_split(have, ' ')), 6)::DOUBLE AS extra FROM t JOIN b USING (i)""")
def _(t: DataFrame) -> DataFrame:
    cover, extra = M.bag_coverage(M.bag(F.split("want", " ")), M.bag(F.split("have", " ")))
    return t.select("i", F.round(cover, 6).alias("coverage"), F.round(extra, 6).alias("extra"))


@R.derived("closure_transition", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'open' END AS status, CASE CAST((l_suppkey) % 5 AS INT) WHEN 0 THEN 'exact' WHEN 1 THEN 'compact' WHEN 2 THEN 'missing_bbox' WHEN 3 THEN 'missing_crop' WHEN 4 THEN 'mismatch' END AS bucket, concat(l_returnflag, CASE CAST((CAST(l_quantity AS INT)) % 2 AS INT) WHEN 0 THEN ' same text' WHEN 1 THEN ' close for manual review' END) AS rule FROM {lineitem}""",
}, sql="""
SELECT i, CASE WHEN status <> 'open' THEN 'unchanged' WHEN bucket = 'missing_bbox' THEN 'needs_source_bbox' WHEN bucket = 'missing_crop' THEN 'needs_source_crop' WHEN bucket IN ('exact', 'compact') AND NOT ends_with(rule, 'for manual review') THEN 'accepted' ELSE 'needs_layout_review' END AS next FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", V.closure(F.col("status"), F.col("bucket"), F.col("rule")).alias("next"))


@R.derived("packets_outcomes", "lineitem orders", {
    "p": """SELECT CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'table' WHEN 1 THEN 'formula' WHEN 2 THEN 'image' END AS kind, concat('b-', CAST(l_orderkey AS VARCHAR(9))) AS block FROM {lineitem}""",
    "o": """SELECT concat('visual:', CASE CAST((o_custkey) % 3 AS INT) WHEN 0 THEN 'table' WHEN 1 THEN 'formula' WHEN 2 THEN 'image' END, ':b-', CAST(o_orderkey AS VARCHAR(9))) AS outcome_id, CASE CAST((o_orderkey) % 2 AS INT) WHEN 0 THEN 'accepted' WHEN 1 THEN 'open' END AS status FROM {orders}""",
}, sql="SELECT kind, block, coalesce(status, 'missing') AS status FROM p LEFT JOIN o ON outcome_id = 'visual:' || kind || ':' || block")
def _(p: DataFrame, o: DataFrame) -> DataFrame:
    return p.withColumn("outcome_id", V.outcome_id(F.col("kind"), F.col("block"))).join(o, "outcome_id", "left").select("kind", "block", F.coalesce("status", F.lit("missing")).alias("status"))


@R.derived("image_outcomes", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, l_partkey % 9 <> 0 AS k, l_suppkey % 8 <> 0 AS im, l_orderkey % 7 <> 0 AS cr, l_linenumber % 6 <> 5 AS bb, CASE CAST((CAST(l_quantity AS INT)) % 5 AS INT) WHEN 0 THEN 400 WHEN 1 THEN 100 WHEN 2 THEN CAST(NULL AS INT) WHEN 3 THEN 300 WHEN 4 THEN 130 END AS w, CASE CAST((l_suppkey) % 6 AS INT) WHEN 0 THEN 300 WHEN 1 THEN 400 WHEN 2 THEN 100 WHEN 3 THEN 115 WHEN 4 THEN 200 WHEN 5 THEN 700 END AS h, l_discount AS d FROM {lineitem}""",
}, sql=r"""
SELECT i, CASE WHEN NOT k THEN 'not_required' WHEN NOT im THEN 'image_missing' WHEN NOT cr THEN 'crop_missing' WHEN NOT bb THEN 'bbox_missing' WHEN w IS NULL OR h IS NULL THEN 'size_unreadable' WHEN d > 0.10 THEN 'aspect_differs' WHEN w * h < 25000 THEN 'area_small' WHEN least(w, h) < 120 THEN 'side_small' ELSE 'accepted' END AS decision FROM t""")
def _(t: DataFrame) -> DataFrame:
    c = F.col
    return t.select("i", V.image_outcome(c("k"), c("im"), c("cr"), c("bb"), c("w"), c("h"), c("d")).alias("decision"))


@R.derived("quality_score", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, l_partkey % 5 = 0 AS ch, CAST(l_suppkey % 3 AS INT) AS co, l_orderkey % 2 = 0 AS ev, CAST(l_partkey % 45 AS INT) * CAST(l_suppkey % 2 AS INT) AS op, l_linenumber <> 4 AS ol, l_discount * 2 AS ur, CAST(l_quantity AS INT) % 4 AS nt, CAST(l_orderkey % 40 AS INT) AS un, CAST(l_partkey % 60 AS INT) AS nr, l_suppkey % 6 <> 0 AS me, l_orderkey % 11 <> 0 AS pr FROM {lineitem}""",
}, sql="""
, s AS (SELECT i, op, greatest(0, 25 - (CASE WHEN ch THEN 8 ELSE 0 END) - (CASE WHEN co > 0 AND ev THEN 6 ELSE 0 END) - (CASE WHEN co > 0 AND NOT ev THEN 5 ELSE 0 END) - (CASE WHEN op > 0 THEN 2 ELSE 0 END))
+ 20 - (CASE WHEN ol THEN 0 ELSE 6 END) - least(5, round_even(ur * 20, 0)::INT) - (CASE WHEN nt = 0 THEN 4 ELSE 0 END) + 20 - (CASE WHEN un > 0 THEN least(8, greatest(2, un // 4)) ELSE 0 END) - least(4, nr // 10)
+ 15 - (CASE WHEN me THEN 0 ELSE 7 END) - (CASE WHEN op > 0 THEN least(4, greatest(1, op // 10)) ELSE 0 END) + 15 - (CASE WHEN pr THEN 0 ELSE 8 END) + 5 AS score FROM t)
SELECT i, score::INT AS score, CASE WHEN score < 75 THEN 'fail' WHEN score >= 90 AND op = 0 THEN 'pass' ELSE 'review' END AS status FROM s""")
def _(t: DataFrame) -> DataFrame:
    c = F.col
    score = V.quality_score(changed=c("ch"), corrections=c("co"), evidence=c("ev"), open_=c("op"), outline_ok=c("ol"), unknown_ratio=c("ur").cast("double"), n_types=c("nt"), unresolved=c("un"), needs_review=c("nr"), media_ok=c("me"), print_ok=c("pr"))
    return t.select("i", "op", score.alias("score")).select("i", "score", V.score_status(c("score"), F.lit(False), c("op") == 0).alias("status"))


@R.derived("gates_acceptance", "lineitem", {
    "g": """SELECT concat('m', CAST(l_orderkey AS VARCHAR(9))) AS material, CASE CAST((l_partkey % 13) % 13 AS INT) WHEN 0 THEN 'pass' WHEN 1 THEN 'pass' WHEN 2 THEN 'pass' WHEN 3 THEN 'pass' WHEN 4 THEN 'pass' WHEN 5 THEN 'pass' WHEN 6 THEN 'pass' WHEN 7 THEN 'pass' WHEN 8 THEN 'review' WHEN 9 THEN 'pass' WHEN 10 THEN 'pass' WHEN 11 THEN 'fail' WHEN 12 THEN 'pass' END AS status FROM {lineitem}""",
}, sql="""
SELECT material, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'review') AS n_review, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'review') THEN 'review' ELSE 'pass' END AS acceptance,
CASE WHEN bool_or(status = 'fail') THEN 'blocked' WHEN bool_or(status = 'review') THEN 'draft' ELSE 'certified' END AS layer FROM g GROUP BY material""")
def _(g: DataFrame) -> DataFrame:
    return V.acceptance(g, "material", "status").withColumn("layer", V.product_layer(F.col("acceptance"), F.lit(True)))


@R.derived("corpus_consistency", "orders customer part supplier", {
    "c": """SELECT CAST(o_orderkey AS VARCHAR(9)) AS material_id, CASE CAST((o_orderkey) % 5 AS INT) WHEN 0 THEN 'accepted' WHEN 1 THEN 'candidate' WHEN 2 THEN 'odd' WHEN 3 THEN 'candidate' WHEN 4 THEN 'accepted' END AS status FROM {orders}""",
    "r": """SELECT CAST(c_custkey * 3 AS VARCHAR(9)) AS material_id FROM {customer}""",
    "d": """SELECT CAST(p_partkey AS VARCHAR(9)) AS material_id FROM {part}""",
    "g": """SELECT CAST(s_suppkey * 7 AS VARCHAR(9)) AS material_id FROM {supplier}""",
    "p": """SELECT DISTINCT CASE CAST((s_suppkey) % 2 AS INT) WHEN 0 THEN 'accepted' WHEN 1 THEN 'candidate' END AS status, true AS expects_run, true AS expects_candidate, s_suppkey % 2 = 0 AS expects_golden FROM {supplier}""",
}, sql="""
SELECT c.material_id, array_to_string(list_filter([CASE WHEN p.status IS NULL THEN 'unknown_status' END, CASE WHEN expects_run AND r.material_id IS NULL THEN 'missing_run' END, CASE WHEN expects_candidate AND d.material_id IS NULL THEN 'missing_candidate' END,
 CASE WHEN expects_golden AND g.material_id IS NULL THEN 'missing_golden' END, CASE WHEN NOT expects_golden AND g.material_id IS NOT NULL THEN 'unexpected_golden' END], lambda x: x IS NOT NULL), ',') AS issues
FROM c LEFT JOIN r USING (material_id) LEFT JOIN d USING (material_id) LEFT JOIN g USING (material_id) LEFT JOIN p ON p.status = c.status""")  # fmt: skip
def _(c: DataFrame, r: DataFrame, d: DataFrame, g: DataFrame, p: DataFrame) -> DataFrame:
    return V.corpus_issues(c, r, d, g, p).select("material_id", F.array_join("issues", ",").alias("issues"))


@R.derived("plan_status", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CAST(l_partkey % 3 AS INT) AS active, l_suppkey % 2 = 0 AS allowed, CAST(l_orderkey % 4 AS INT) AS selected, l_linenumber % 2 = 0 AS filtered FROM {lineitem}""",
}, sql="""
SELECT i, CASE WHEN active > 0 AND NOT allowed THEN 'BLOCKED_ACTIVE_MARKERS' WHEN selected > 0 THEN 'READY' WHEN filtered THEN 'TARGET_NOT_ELIGIBLE' ELSE 'IDLE' END AS status FROM t""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", L.plan_status(F.col("active"), F.col("allowed"), F.col("selected"), F.col("filtered")).alias("status"))


@R.derived("root_causes", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CASE CAST((l_partkey) % 4 AS INT) WHEN 0 THEN 'formula' WHEN 1 THEN 'blank' WHEN 2 THEN 'order' WHEN 3 THEN 'strange' END AS kind FROM {lineitem}""",
}, sql="SELECT i, CASE kind WHEN 'formula' THEN 0.72 WHEN 'blank' THEN 0.70 WHEN 'order' THEN 0.58 ELSE 0.35 END::DOUBLE AS confidence FROM t")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", V.root_cause_confidence(F.col("kind")).alias("confidence"))


@R.derived("membership_flags", "part lineitem", {
    "t": """SELECT p_partkey AS block FROM {part}""",
    "a": """SELECT l_partkey AS block FROM {lineitem} WHERE l_quantity > 45""",
    "b": """SELECT l_partkey AS block FROM {lineitem} WHERE l_quantity < 3""",
}, sql="SELECT block, block IN (SELECT block FROM a) AS in_delta, block IN (SELECT block FROM b) AS paired FROM t")
def _(t: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    return V.attach_flags(t, {"in_delta": a, "paired": b}, "block")


@R.derived("number_coercion", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'x' END, CAST(l_suppkey AS VARCHAR(9)), CASE CAST((l_suppkey) % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN '.0' WHEN 2 THEN '.5' WHEN 3 THEN '.00' END) AS v FROM {lineitem} UNION ALL SELECT l_orderkey, CASE CAST((l_partkey) % 5 AS INT) WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN '7' WHEN 3 THEN '' WHEN 4 THEN CAST(NULL AS VARCHAR(9)) END FROM {lineitem}""",
}, sql="SELECT i, CASE WHEN lower(v) IN ('true', 'false') THEN NULL WHEN TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE)) THEN TRY_CAST(v AS DOUBLE)::BIGINT END AS n FROM t")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", X.coerce_number(F.col("v")).alias("n"))


@R.derived("json_repair", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN '```json ' WHEN 1 THEN '' WHEN 2 THEN 'nothing ' END, CASE CAST((l_suppkey) % 4 AS INT) WHEN 0 THEN concat('{{"a": ', CAST(l_quantity AS VARCHAR(9)), '}}') WHEN 1 THEN '{{"a": {{"b": 1}}}}' WHEN 2 THEN 'none' WHEN 3 THEN '}} {{' END, CASE CAST((CAST(l_quantity AS INT)) % 2 AS INT) WHEN 0 THEN ' ``` done' WHEN 1 THEN '' END) AS v FROM {lineitem}""",
}, sql="SELECT i, coalesce(nullif(regexp_extract(v, '(?s)(\\{.*\\})', 1), ''), '{}') AS object FROM t")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", X.json_object(F.col("v")).alias("object"))


@R.derived("digit_spacing", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, concat(CASE CAST((l_partkey) % 3 AS INT) WHEN 0 THEN 'x ' WHEN 1 THEN 'a' WHEN 2 THEN '' END, CAST(l_linenumber AS VARCHAR(9)), CASE CAST((l_suppkey) % 4 AS INT) WHEN 0 THEN ' 2 ' WHEN 1 THEN ' ' WHEN 2 THEN ' b ' WHEN 3 THEN '-' END, CAST(l_suppkey AS VARCHAR(9)), CASE CAST((CAST(l_quantity AS INT)) % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN ' y' WHEN 2 THEN 'z' END) AS v FROM {lineitem}""",
}, sql="SELECT i, regexp_matches(v, '(^|[^A-Za-z0-9])[0-9]+( +[0-9]+)+([^A-Za-z0-9]|$)') AS risk FROM t")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", X.digit_spacing_risk(F.col("v")).alias("risk"))


@R.derived("aspect_delta", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, CAST(1 + l_partkey % 400 AS INT) AS a, CAST(1 + l_suppkey AS INT) AS b, CAST(l_quantity AS INT) AS c, CAST(l_linenumber * 50 AS INT) AS d FROM {lineitem}""",
}, sql="SELECT i, round(abs(ln((a * 1.0 / b) / (c * 1.0 / d))), 6)::DOUBLE AS delta FROM t")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", F.round(X.aspect_delta(*(F.col(c) for c in "abcd")), 6).alias("delta"))


@R.derived("math_key", "lineitem", {"t": f"""SELECT l_orderkey * 8 + l_linenumber AS i, concat({pick("l_partkey", "concat(chr(92), 'frac{{a}}{{b}}')", "'c ___ d'", "'$x$ &lt; '", "concat(chr(92), 'sqrt[3]{{y}}')")}, {pick("l_suppkey", "concat(' ', chr(92), 'times ')", "concat(chr(92), 'left(')", "' = '")}, {pick("CAST(l_quantity AS INT)", "'B'", "concat(chr(92), 'text{{So}}')", "concat(chr(92), 'leq 5')")}) AS v FROM {{lineitem}}"""}, sql="""
SELECT l_orderkey * 8 + l_linenumber AS i, ['fracaoverb', 'cd', 'x<', 'sqrt3y'][1 + l_partkey % 4] || ['times', '', '='][1 + l_suppkey % 3] || ['b', 'so', 'le5'][1 + CAST(l_quantity AS INT) % 3] AS k FROM lineitem""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", X.math_key(F.col("v")).alias("k"))
