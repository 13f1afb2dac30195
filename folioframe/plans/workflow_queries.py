"""Filters, runs, jobs, write-backs and classifiers of the review workflow over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import workflow as W
from folioframe.plans.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.over("file_filter", "part", sql="SELECT p_partkey FROM part WHERE contains(p_name, 'widget') AND p_type = upper('economy')")
def _(part: DataFrame) -> DataFrame:
    return part.filter(W.contains_if(F.col("p_name"), "widget") & (F.col("p_type") == "economy".upper())).select("p_partkey")


@R.over("metadata_filter", "documents", "labels", sql="""
SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id AS k, CASE WHEN toxic = 1 THEN 'missing' ELSE 'ready' END AS status FROM labels) l ON k = doc_id
WHERE (k IS NULL OR status = 'missing') AND contains(source, '1') AND n_chars >= 100 AND n_chars <= 5000""")
def _(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").alias("k"), F.when(F.col("toxic") == 1, "missing").otherwise("ready").alias("status"))
    rows = W.metadata_status(docs.join(known, F.col("k") == F.col("doc_id"), "left"), "k", "status", "missing")
    return rows.filter(W.contains_if(F.col("source"), "1") & W.between_if(F.col("n_chars"), 100, 5000)).select("doc_id")


@R.over("review_views", "orders", sql="""
SELECT v AS "view", count(*) AS n FROM (SELECT unnest(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000 THEN ['page'] ELSE [] END || CASE WHEN o_orderstatus IN ('F', 'P') THEN ['outline'] ELSE [] END || CASE WHEN o_orderstatus = 'O' THEN ['standard'] ELSE [] END) AS v FROM orders) GROUP BY v""")
def _(orders: DataFrame) -> DataFrame:
    """Every row in all the views that show it, in one pass."""
    views = X.blockers((~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 1000), "page"), (F.col("o_orderstatus").isin("F", "P"), "outline"), (F.col("o_orderstatus") == "O", "standard"))
    return orders.select(F.explode(views).alias("view")).groupBy("view").agg(F.count("*").alias("n"))


@R.over("active_run", "events", sql="""
SELECT user_id, event_id FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(events: DataFrame) -> DataFrame:
    newest = events.filter(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return newest.select("user_id", "m.event_id")


@R.over("target_filter", "orders", sql="SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) IN ('3', '17', '40') AND o_orderstatus IN ('O', 'F')")
def _(orders: DataFrame) -> DataFrame:
    return W.targets(orders, {"o_custkey": ["3", " 17 ", "", "3", "40"], "o_orderstatus": ["O", "F"], "o_orderpriority": []}).select("o_orderkey")


@R.over("root_manifests", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 AS is_root FROM lineitem")
def _(items: DataFrame) -> DataFrame:
    deep = F.when(F.col("l_linenumber") % 3 == 0, "a/b/").when(F.col("l_linenumber") % 3 == 1, "a/").otherwise("a/b/c/")
    return items.select("l_orderkey", "l_linenumber", W.depth_manifest(F.concat(F.lit("out/book/m1/"), deep, F.lit("manifest.json")), "/out/book").alias("is_root"))


@R.over("output_origin", "events", sql="""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'legacy_selfloop' WHEN event_id % 7 = 0 THEN 'codex_skill' WHEN event_type = 'error' THEN 'codex_refined' ELSE 'codex_elegantbook' END AS origin FROM events""")
def _(events: DataFrame) -> DataFrame:
    key = F.when(F.col("event_id") % 11 == 0, "LaTeX/x").when(F.col("event_id") % 7 == 0, "codex-elegantbook/x").otherwise("other/x")
    return events.select("event_id", W.origin(F.when(F.col("event_type") == "error", '{"Editorial_Decisions": 1}').otherwise(F.col("props")), key).alias("origin"))


@R.over("display_names", "part", sql="""
SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name WHEN p_size % 2 = 1 THEN p_brand ELSE 'key' || p_partkey || '.pdf' END AS name FROM part""")
def _(part: DataFrame) -> DataFrame:
    generated = F.concat(F.lit("pdf-"), F.sha2("p_name", 256))
    filename, title = F.when(F.col("p_size") % 3 > 0, F.col("p_name")).otherwise(generated), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).otherwise(generated)
    return part.select("p_partkey", W.display_name(title, filename, F.concat(F.lit("in/key"), F.col("p_partkey"), F.lit(".pdf"))).alias("name"))


@R.over("redacted_urls", "events", sql="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"url": "<redacted-presigned-url>", "n": ' || event_id || '}' WHEN event_id % 3 = 1 THEN '<redacted-presigned-url>' ELSE props END AS said FROM events""")
def _(events: DataFrame) -> DataFrame:
    signed = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"url": "http://x/y?X-Amz-Signature=ab", "n": '), "event_id", F.lit("}"))).when(F.col("event_id") % 3 == 1, "http://x?X-Amz-Date=1").otherwise(F.col("props"))
    return events.select("event_id", W.redact_urls(signed).alias("said"))


@R.over("same_series_others", "part", sql="SELECT a.p_partkey, count(b.p_partkey) AS n_others FROM part a JOIN (SELECT p_brand, p_type, p_partkey FROM part) b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey")
def _(part: DataFrame) -> DataFrame:
    """How many others share a part's brand and type: counted once a group, itself taken off, so no group is paired with itself."""
    sizes = part.groupBy("p_brand", "p_type").agg((F.count("*") - 1).alias("n_others")).filter("n_others > 0")
    return part.join(sizes, ["p_brand", "p_type"]).select("p_partkey", "n_others")


@R.over("last_unpublished_run", "events", sql="""
WITH p AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last_at FROM events GROUP BY user_id)
SELECT user_id, event_id FROM events JOIN p USING (user_id) WHERE event_type <> 'purchase' AND (last_at IS NULL OR ts > last_at) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(events: DataFrame) -> DataFrame:
    return W.last_unpublished(events, "user_id", "ts", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


@R.over("marker_payloads", "events", "customer", sql="""
WITH m AS (SELECT user_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey, coalesce(s.props, t.props) AS payload, CASE WHEN s.props IS NOT NULL THEN 'source' WHEN t.props IS NOT NULL THEN 'material' ELSE 'none' END AS found_by
FROM customer LEFT JOIN (SELECT * FROM m WHERE event_type = 'purchase') s ON s.user_id = c_custkey LEFT JOIN (SELECT * FROM m WHERE event_type = 'signup') t ON t.user_id = c_custkey""")
def _(events: DataFrame, customer: DataFrame) -> DataFrame:
    """The newest payload by source, else that by material: one aggregate for both sides, then one join."""
    newest = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("ts", "event_id", "props")))["props"]
    latest = events.groupBy(F.col("user_id").alias("c_custkey")).agg(newest("purchase").alias("s"), newest("signup").alias("t"))
    return customer.select("c_custkey").join(latest, "c_custkey", "left").select("c_custkey", F.coalesce("s", "t").alias("payload"), X.ladder((F.col("s").isNotNull(), "source"), (F.col("t").isNotNull(), "material"), default="none").alias("found_by"))


@R.over("assignment_check", "lineitem", sql="""
SELECT r.l_orderkey, r.l_linenumber, CASE WHEN a.l_orderkey IS NULL THEN 'none' WHEN a.l_returnflag = r.l_returnflag AND abs(a.l_quantity - r.l_quantity) <= 10 THEN 'matched' ELSE 'mismatched' END AS verdict, CASE WHEN a.l_returnflag = r.l_returnflag AND abs(a.l_quantity - r.l_quantity) <= 10 THEN a.l_suppkey END AS assigned_l_suppkey
FROM lineitem r LEFT JOIN lineitem a ON a.l_orderkey = r.l_orderkey AND a.l_linenumber = r.l_linenumber + 1""")
def _(items: DataFrame) -> DataFrame:
    check = (F.col("a.l_returnflag") == F.col("r.l_returnflag")) & W.same_box([F.col("a.l_quantity")], [F.col("r.l_quantity")], 10)
    return W.cross_checked(items, items, "l_orderkey", "l_linenumber", "l_linenumber", check, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "verdict", "assigned_l_suppkey")


@R.over("fallback_ledger", "conversations", sql="""
WITH e AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id), u AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS expected, CASE WHEN conv_id % 2 = 0 THEN e.turn ELSE u.turn END AS turn FROM conversations LEFT JOIN e USING (conv_id) LEFT JOIN u USING (conv_id)""")
def _(turns: DataFrame) -> DataFrame:
    """For each chunk the first row of the type its status expects."""
    expected = F.when(F.col("conv_id") % 2 == 0, "assistant").otherwise("user")
    return turns.groupBy("conv_id").agg(F.min(F.when(F.col("role") == expected, F.col("turn"))).alias("turn")).select("conv_id", expected.alias("expected"), "turn")


@R.over("unit_targets", "nation", "region", "supplier", sql="""
SELECT s_suppkey, coalesce(n.n_name, r.r_name) AS target, CASE WHEN n.n_name IS NOT NULL THEN 'path' WHEN r.r_name IS NOT NULL THEN 'title' ELSE 'none' END AS matched_by
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n_nationkey = s_nationkey LEFT JOIN region r ON r_regionkey = s_nationkey % 7""")
def _(nation: DataFrame, region: DataFrame, supplier: DataFrame) -> DataFrame:
    """A unit's target by path, else by title and level."""
    by_path = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    joined = supplier.withColumn("r_regionkey", F.col("s_nationkey") % 7).join(by_path, "s_nationkey", "left").join(region.select("r_regionkey", "r_name"), "r_regionkey", "left")
    return joined.select("s_suppkey", F.coalesce("n_name", "r_name").alias("target"), X.ladder((F.col("n_name").isNotNull(), "path"), (F.col("r_name").isNotNull(), "title"), default="none").alias("matched_by"))


@R.over("outcome_batches", "lineitem", sql="""
WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus FROM lineitem), f AS (SELECT l_suppkey, string_agg(v || ':' || n, ',' ORDER BY v) AS s FROM (SELECT l_suppkey, l_returnflag AS v, count(*) AS n FROM c GROUP BY ALL) GROUP BY l_suppkey),
g AS (SELECT l_suppkey, string_agg(v || ':' || n, ',' ORDER BY v) AS s FROM (SELECT l_suppkey, l_linestatus AS v, count(*) AS n FROM c GROUP BY ALL) GROUP BY l_suppkey)
SELECT l_suppkey, count(*) AS n_items, any_value(f.s) AS l_returnflag_counts, any_value(g.s) AS l_linestatus_counts FROM c JOIN f USING (l_suppkey) JOIN g USING (l_suppkey) GROUP BY l_suppkey""")
def _(items: DataFrame) -> DataFrame:
    return W.batches(items, ["l_suppkey"], ["l_returnflag", "l_linestatus"])


@R.over("report_type_counts", "lineitem", sql="""
SELECT l_orderkey, count(DISTINCT l_partkey) AS pages, count(*) AS blocks, count(*) FILTER (WHERE l_returnflag IN ('N', 'A')) AS text_and_list, count(*) FILTER (WHERE l_returnflag = 'R') AS tables FROM lineitem GROUP BY l_orderkey""")
def _(items: DataFrame) -> DataFrame:
    return items.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("pages"), F.count("*").alias("blocks"), F.count_if(F.col("l_returnflag").isin("N", "A")).alias("text_and_list"), F.count_if(F.col("l_returnflag") == "R").alias("tables"))


@R.over("session_counts", "events", sql="""
SELECT user_id, count(*) AS annotations, count(*) FILTER (WHERE event_type = 'click') AS draft, count(*) FILTER (WHERE event_type = 'view') AS submitted, count(*) FILTER (WHERE event_type = 'error') AS root_caused, count(*) FILTER (WHERE event_type = 'purchase') AS project_accepted FROM events GROUP BY user_id""")
def _(events: DataFrame) -> DataFrame:
    named = {"draft": "click", "submitted": "view", "root_caused": "error", "project_accepted": "purchase"}
    return events.groupBy("user_id").agg(F.count("*").alias("annotations"), *(F.count_if(F.col("event_type") == v).alias(k) for k, v in named.items()))


@R.over("acceptance_checks", "orders", sql="""
SELECT o_custkey, CASE WHEN bool_or(o_totalprice < 1000) THEN 'FAIL' ELSE 'PASS' END AS price, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'WARN' ELSE 'PASS' END AS open, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'N/A' ELSE 'PASS' END AS done, NOT bool_or(o_totalprice < 1000) AS passed FROM orders GROUP BY o_custkey""")
def _(orders: DataFrame) -> DataFrame:
    """Rows of checks per asset; passed is that none fails, whatever warns or does not apply."""
    some = lambda c: F.count_if(c) > 0
    checks = orders.groupBy("o_custkey").agg(F.when(some(F.col("o_totalprice") < 1000), "FAIL").otherwise("PASS").alias("price"), F.when(some(F.col("o_orderstatus") == "P"), "WARN").otherwise("PASS").alias("open"), F.when(some(F.col("o_orderstatus") == "F"), "PASS").otherwise("N/A").alias("done"))
    return checks.withColumn("passed", ~F.array_contains(F.array("price", "open", "done"), "FAIL"))


@R.over("latest_run", "orders", sql="SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


@R.over("sorted_samples", "part", sql="SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 10")
def _(part: DataFrame) -> DataFrame:
    """A report's sample: the first ten distinct values."""
    return part.select("p_brand").distinct().orderBy("p_brand").limit(10)


@R.over("reading_order", "lineitem", sql="SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_tax, l_linenumber) AS place FROM lineitem")
def _(items: DataFrame) -> DataFrame:
    """Blocks of a page by y, x, then their place in the file."""
    from pyspark.sql import Window

    return items.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_discount", "l_tax", "l_linenumber")).alias("place"))


@R.over("trimmed_context", "documents", sql="""
SELECT doc_id, len(CASE WHEN length(text) > 500 THEN w[1:6] ELSE w END) AS n_examples, length(text) > 500 AS trimmed FROM (SELECT doc_id, text, string_split(text, chr(10)) AS w FROM documents)""")
def _(docs: DataFrame) -> DataFrame:
    """Lists of a context are cut to their first six only where the whole is too long."""
    lines, long = F.split("text", "\n"), F.length("text") > 500
    return docs.select("doc_id", F.size(F.when(long, F.slice(lines, 1, 6)).otherwise(lines)).cast("long").alias("n_examples"), long.alias("trimmed"))


_DOCS_TEXT = "regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@R.over("source_texts", "pages", sql=f"""
SELECT page_id, md5(CASE WHEN a = b OR b = '' THEN a WHEN a = '' THEN b ELSE a || ' ' || b END) AS digest FROM (SELECT page_id, {_DOCS_TEXT.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS a, {_DOCS_TEXT.format("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS b FROM pages)""")
def _(pages: DataFrame) -> DataFrame:
    parts = F.array(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.regexp_extract("html", "<title>(.*?)</title>", 1), F.regexp_extract("html", "<h1>(.*?)</h1>", 1))
    return pages.select("page_id", F.md5(W.source_text(parts)).alias("digest"))


@R.over("absolute_images", "documents", sql=r"""
SELECT doc_id, md5(regexp_replace('![a](/img/' || doc_id || '.png) ' || text || ' ![b](https://x/y.png)', '!\[([^\]]*)\]\(/img/([^)]+)\)', '![\1](https://store/bucket/base/img/\2)', 'g')) AS digest FROM documents""")
def _(docs: DataFrame) -> DataFrame:
    markdown = F.concat(F.lit("![a](/img/"), "doc_id", F.lit(".png) "), "text", F.lit(" ![b](https://x/y.png)"))
    return docs.select("doc_id", F.md5(W.absolute_images(markdown, "base", "https://store/bucket")).alias("digest"))


@R.over("run_stamps", "orders", sql="SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y') >= '2000' THEN strftime(o_orderdate, '%Y%m%d%H%M%S') ELSE '' END AS stamp FROM orders")
def _(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", W.run_stamp(F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("-v"))).alias("stamp"))


@R.over("backends", "events", sql="""
SELECT event_id, CASE event_type WHEN 'click' THEN 'vlm-engine' WHEN 'view' THEN 'hybrid-http-client' WHEN 'error' THEN 'hybrid-engine' ELSE event_type END AS backend, event_type IN ('click', 'view') AS supported FROM events""")
def _(events: DataFrame) -> DataFrame:
    named = F.when(F.col("event_type") == "click", "VLM_TRANSFORMERS").when(F.col("event_type") == "view", "HYBRID_HTTP_CLIENT").when(F.col("event_type") != "error", F.col("event_type"))
    return events.select("event_id", W.backend(named).alias("backend"), W.backend_supported(named).alias("supported"))


@R.over("byte_ranges", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN greatest(0, 30 - CAST(l_quantity AS BIGINT)) ELSE CAST(l_quantity AS BIGINT) END AS start,
 CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber IN (2, 3) THEN 29 ELSE least(29, CAST(l_quantity AS BIGINT) + 5) END AS "end", CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN true ELSE l_quantity < 30 END AS ok FROM lineitem""")
def _(items: DataFrame) -> DataFrame:
    n = F.col("l_quantity").cast("long")
    header = F.when(F.col("l_linenumber") == 1, "bytes=1-2,5-6").when(F.col("l_linenumber") == 2, F.concat(F.lit("bytes=-"), n)).when(F.col("l_linenumber") == 3, F.concat(F.lit("Bytes="), n, F.lit("-"))).otherwise(F.concat(F.lit("bytes= "), n, F.lit("-"), n + 5))
    return items.select("l_orderkey", "l_linenumber", W.byte_range(header, F.lit(30).cast("long")).alias("r")).select("l_orderkey", "l_linenumber", "r.start", "r.end", F.when(F.col("r.start") < 30, F.col("r.ok")).otherwise(F.col("r.ok")).alias("ok"))


@R.over("text_shapes", "documents", sql=r"""
SELECT doc_id, array_to_string(CASE WHEN len(s) > 0 THEN s ELSE ['formula_or_text'] END, ',') AS shapes FROM (SELECT doc_id, list_filter([CASE WHEN contains(text, '![') THEN 'markdown_image' END, CASE WHEN contains(lower(text), '<table') THEN 'html_table' END,
 CASE WHEN regexp_matches(trim(text), '^[A-H][\s\-.()]') THEN 'option_line' END, CASE WHEN regexp_matches(trim(text), '^[①-⑳]') THEN 'circled_item' END, CASE WHEN contains(text, 'STEP') OR contains(text, 'Step') THEN 'procedure_text' END,
 CASE WHEN length(text) < 20 THEN 'short_formula' END, CASE WHEN length(text) > 180 THEN 'long_text_with_formula' END], lambda x: x IS NOT NULL) AS s FROM documents)""")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join(W.text_shapes(F.col("text")), ",").alias("shapes"))


@R.over("recommended_actions", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'table_source_locator_or_manual_crop_review' WHEN l_linestatus = 'F' THEN 'reclassify_formula_packet_or_route_to_image_relation_review' WHEN l_linenumber = 1 THEN 'manual_review_short_global_candidate' WHEN l_linenumber = 2 THEN 'raw_text_sequence_or_context_window_locator_required' ELSE 'manual_review_required' END AS action FROM lineitem""")
def _(items: DataFrame) -> DataFrame:
    bucket = F.when(F.col("l_linenumber") == 1, "ambiguous_short_global_match_needs_manual").when(F.col("l_linenumber") == 2, "no_math_normalized_raw_match").otherwise("other")
    shapes = F.when(F.col("l_linestatus") == "F", F.array(F.lit("markdown_image"))).otherwise(F.array(F.lit("short_formula")))
    return items.select("l_orderkey", "l_linenumber", W.recommended_action(bucket, shapes, F.when(F.col("l_returnflag") == "R", "table_visual_review").otherwise("formula")).alias("action"))


@R.over("formula_mismatches", "lineitem", sql="""
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'needs_page_bbox' WHEN l_returnflag = 'R' THEN 'needs_source_crop' WHEN l_partkey % 2 = 0 THEN 'deterministic_formula_semantic_equivalent' WHEN l_discount >= 0.05 THEN 'near_equivalent_needs_manual_review' ELSE 'semantic_mismatch_needs_manual_review' END AS bucket FROM lineitem) GROUP BY bucket""")
def _(items: DataFrame) -> DataFrame:
    clean, source = X.formula_semantic_key(F.lit(r"\frac{1}{2} \times $x$")), X.formula_semantic_key(F.when(F.col("l_partkey") % 2 == 0, r"\frac {1}{2}\cdot x").otherwise("y"))
    ratio = F.when(F.col("l_discount") >= 0.05, 0.99).otherwise(0.5)
    return items.groupBy(W.mismatch_bucket(F.col("l_linenumber") != 1, F.col("l_returnflag") != "R", clean, source, ratio).alias("bucket")).agg(F.count("*").alias("n"))


@R.over("surface_risks", "documents", sql=r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '^.*$') AND doc_id % 5 = 0 THEN 'digit_spacing_review' WHEN doc_id % 5 = 1 THEN 'surface_diff_review' WHEN length(text) > 180 AND doc_id % 5 = 2 THEN 'long_mixed_review' WHEN regexp_matches(trim(text), '^\([A-D]\)') THEN 'short_option_surface_safe' WHEN doc_id % 5 > 2 THEN 'compact_surface_safe' ELSE 'punctuation_spacing_safe' END AS risk FROM documents WHERE doc_id % 5 > 0""")
def _(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 5
    return docs.filter(k > 0).select("doc_id", W.surface_risk(F.col("text"), k == 0, k > 2, k == 2).alias("risk"))


@R.over("stale_runs", "events", sql="""
SELECT event_id, event_type IN ('click', 'view') AND epoch(TIMESTAMP '2024-01-10 00:00:00') - floor(epoch(ts)) >= 300 AND user_id % 4 <> 0 AS is_stale FROM events""")
def _(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").otherwise("done")
    return events.select("event_id", W.stale(status, F.col("ts"), F.lit("2024-01-10 00:00:00").cast("timestamp"), F.col("user_id") % 4 == 0).alias("is_stale"))


@R.over("job_queue", "orders", "customer", sql="SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P'))")
def _(orders: DataFrame, customer: DataFrame) -> DataFrame:
    jobs = orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("failed").alias("status"))
    return W.enqueue(customer.select("c_custkey", "c_mktsegment"), jobs, ["c_custkey"], "status")


@R.over("job_transitions", "orders", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'cancelled' WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'F' THEN 'queued' ELSE CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'succeeded' END END AS status,
 CASE WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'F' THEN 3 ELSE 2 END AS attempts, (o_orderkey % 2 = 0 AND o_orderstatus = 'O') OR (o_orderkey % 2 = 1 AND o_orderstatus = 'F') AS ok FROM orders""")
def _(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    return orders.select("o_orderkey", W.job_transition(F.when(F.col("o_orderkey") % 2 == 0, "cancel").otherwise("retry"), status, F.lit(2)).alias("t")).select("o_orderkey", "t.*")


@R.over("invalidated_stages", "orders", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'latex_done' WHEN o_totalprice > 100000 THEN 'clean_stale' WHEN o_orderkey % 3 = 0 THEN 'popo_done' WHEN o_orderkey % 3 = 1 THEN 'mineru_done' ELSE 'input' END AS stage FROM orders""")
def _(orders: DataFrame) -> DataFrame:
    has = lambda c: F.when(c, F.lit("ref"))
    return orders.select("o_orderkey", W.after_invalidation(has(F.col("o_orderstatus") != "P"), has(F.col("o_totalprice") > 100000), has(F.col("o_orderkey") % 3 == 0), has(F.col("o_orderkey") % 3 == 1), F.lit("latex_done")).alias("stage"))


@R.over("box_write_back", "orders", "lineitem", sql="""
WITH e AS (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey WHEN n = 1 THEN s END AS place, CASE WHEN o_orderstatus <> 'F' THEN 'kept' WHEN n = 1 THEN 'filled' WHEN n > 1 THEN 'ambiguous' ELSE 'open' END AS change FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""")
def _(orders: DataFrame, items: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("place"))
    evidence = items.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("place"), F.when(F.col("l_returnflag") == "A", "unique_exact").when(F.col("l_returnflag") == "R", "unique_compact").otherwise("ambiguous").alias("bucket"))
    return W.write_back(rows, evidence, ["o_orderkey"], "bucket", ["unique_exact", "unique_compact"], ["place"], F.isnull("place"))


@R.over("legacy_updates", "customer", "nation", sql="SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN 'latex_done' ELSE c_mktsegment END AS stage, coalesce(n_regionkey = 2, false) AS changed FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Rows updated by their exact key; all others stay as they are."""
    new = nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("latex_done").alias("new"))
    return customer.join(new, "c_nationkey", "left").select("c_custkey", F.coalesce("new", "c_mktsegment").alias("stage"), F.col("new").isNotNull().alias("changed"))


@R.over("config_merge", "events", sql="SELECT event_id, json_extract_string(props, '$.k') AS k, 'v' || (event_id % 3) AS patched FROM events")
def _(events: DataFrame) -> DataFrame:
    """A patch over a configuration: flattened to paths, the patch's values win, others stay."""
    base = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("db.name"), F.lit("old")))
    patch = F.create_map(F.lit("db.name"), F.concat(F.lit("v"), F.col("event_id") % 3))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch)
    return events.select("event_id", merged["k"].alias("k"), merged["db.name"].alias("patched"))


@R.derived("split_runs", "lineitem", {
    "t": """SELECT l_orderkey * 8 + l_linenumber AS i, concat(CASE CAST((l_partkey) % 4 AS INT) WHEN 0 THEN 'Who is it? ' WHEN 1 THEN 'Only one? ' WHEN 2 THEN 'Yes, I am. ' WHEN 3 THEN '' END, CASE CAST((l_suppkey) % 3 AS INT) WHEN 0 THEN 'Why? ' WHEN 1 THEN 'No, I am not. ' WHEN 2 THEN '' END, CASE CAST((CAST(l_quantity AS INT)) % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'so on' WHEN 2 THEN 'How? ' END) AS v FROM {lineitem}""",
}, sql="""
, p AS (SELECT l_orderkey * 8 + l_linenumber AS i, ['Who is it?', 'Only one?', 'Yes, I am.', ''][1 + l_partkey % 4] AS a, ['Why?', 'No, I am not.', ''][1 + l_suppkey % 3] AS b, ['', 'so on', 'How?'][1 + CAST(l_quantity AS INT) % 3] AS c FROM lineitem),
l AS (SELECT *, array_to_string(list_filter([a, b, c], lambda x: x <> ''), ' ') AS v FROM p)
SELECT i, CASE WHEN ends_with(v, '?') AND len(string_split(v, '?')) > 2 THEN array_to_string(list_transform(string_split(v, '?')[:-2], lambda y: trim(y) || '?'), '|') ELSE '' END AS questions, CASE WHEN a = 'Yes, I am.' AND b = 'No, I am not.' THEN a || '|' || b || CASE WHEN c <> '' THEN ' ' || c ELSE '' END ELSE '' END AS answers FROM l""")
def _(t: DataFrame) -> DataFrame:
    return t.select("i", F.array_join(W.question_run(F.col("v")), "|").alias("questions"), F.array_join(W.answer_run(F.col("v")), "|").alias("answers"))
