"""Catalogue listings, facets, counts and winners over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import blocks as B
from folioframe.operators import catalog as C
from folioframe.plans.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.over("tenant_stats", "documents", sql="""
SELECT source, count(*) AS n_files, count(*) FILTER (WHERE n_chars > 1000) AS n_large, round(coalesce(sum(n_chars), 0) / 1048576.0, 2) AS size_mb
FROM documents GROUP BY source""")
def _(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count("*").alias("n_files"), F.count_if(F.col("n_chars") > 1000).alias("n_large"), F.round(F.coalesce(F.sum("n_chars"), F.lit(0)) / 1048576.0, 2).alias("size_mb"))


@R.over("stage_counts", "orders", sql="""
SELECT v.s AS o_orderstatus, v.p AS position, count(o_orderkey) AS n FROM (VALUES ('F', 0), ('O', 1), ('P', 2), ('X', 3)) v(s, p)
LEFT JOIN orders ON o_orderstatus = v.s GROUP BY ALL""")
def _(orders: DataFrame) -> DataFrame:
    return C.fixed_counts(orders, "o_orderstatus", ["F", "O", "P", "X"])


@R.over("availability_counts", "documents", "labels", sql="""
SELECT count(*) AS n_all, count(l.doc_id) AS n_labelled, count(*) FILTER (WHERE l.quality = 1) AS n_good, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_missing
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(docs: DataFrame, labels: DataFrame) -> DataFrame:
    joined = docs.select("doc_id").join(labels.withColumn("known", F.lit(True)), "doc_id", "left")
    return joined.agg(F.count("*").alias("n_all"), F.count("known").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("known").isNull()).alias("n_missing"))


@R.over("facet_values", "documents", sql="""
SELECT * FROM (SELECT DISTINCT 'lang' AS field, lang AS value FROM documents WHERE lang <> '' ORDER BY value LIMIT 100)
UNION ALL SELECT * FROM (SELECT DISTINCT 'source' AS field, source AS value FROM documents WHERE source <> '' ORDER BY value LIMIT 100)""")
def _(docs: DataFrame) -> DataFrame:
    return C.facets(docs, ["lang", "source"])


@R.over("catalog_value_stats", "documents", "labels", sql="""
WITH j AS (SELECT d.lang, d.source, coalesce(l.quality, 0) = 1 AS m, CAST(l.toxic AS DOUBLE) AS c FROM documents d LEFT JOIN labels l USING (doc_id)),
p AS (SELECT 'lang' AS field, lang AS value, m, c FROM j UNION ALL SELECT 'source', source, m, c FROM j),
s AS (SELECT field, value, count(*) AS n, count(*) FILTER (WHERE m) AS n_manual, round(avg(c), 3) AS mean_confidence FROM p WHERE value <> '' GROUP BY field, value)
SELECT *, CASE WHEN n_manual > 0 THEN 'manual_confirmed' ELSE 'suggested' END AS authority,
       row_number() OVER (PARTITION BY field ORDER BY n_manual DESC, n DESC, mean_confidence DESC NULLS LAST, value) AS rank
FROM s QUALIFY rank <= 24""")
def _(docs: DataFrame, labels: DataFrame) -> DataFrame:
    joined = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return C.value_stats(joined, ["lang", "source"], F.coalesce(F.col("quality"), F.lit(0)) == 1, F.col("toxic").cast("double"))


@R.over("catalog_listing", "documents", "labels", "events", sql="""
WITH e AS (SELECT user_id, max((ts, event_id, event_type)) AS m FROM events GROUP BY user_id)
SELECT d.doc_id, d.lang, d.source, d.n_chars, coalesce(l.quality, -1) AS quality, e.m[3] AS last_event
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN e ON e.user_id = d.doc_id % 100
WHERE d.source LIKE '%1%' AND d.lang IN ('en', 'fr') AND (l.quality IS NULL OR l.quality = 1)
ORDER BY coalesce(l.quality, -1) DESC, d.n_chars DESC, d.doc_id LIMIT 20""")
def _(docs: DataFrame, labels: DataFrame, events: DataFrame) -> DataFrame:
    newest = C.top_struct(events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", F.col("event_type").alias("last_event"))
    wanted = docs.select("doc_id", "lang", "source", "n_chars").filter(F.contains("source", F.lit("1")) & F.col("lang").isin("en", "fr"))
    rows = wanted.join(labels, "doc_id", "left").filter("quality is null or quality = 1").join(newest, F.col("user_id") == F.col("doc_id") % 100, "left")
    rows = rows.select("doc_id", "lang", "source", "n_chars", F.coalesce("quality", F.lit(-1)).alias("quality"), "last_event")
    return C.page(rows, [F.desc("quality"), F.desc("n_chars"), F.asc("doc_id")])


@R.over("multi_column_search", "customer", "nation", sql="""
SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(c_name), '1') OR contains(lower(n_name), '1') OR contains(lower(c_mktsegment), '1')""")
def _(customer: DataFrame, nation: DataFrame) -> DataFrame:
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return C.search(joined, "1", ["c_name", "n_name", "c_mktsegment"]).select("c_custkey", "c_name", "n_name")


@R.over("stage_presence_filter", "orders", "lineitem", sql="""
SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') GROUP BY o_orderstatus""")
def _(orders: DataFrame, items: DataFrame) -> DataFrame:
    key = F.col("o_orderkey") == F.col("l_orderkey")
    kept = orders.join(items.filter("l_returnflag = 'R'").select("l_orderkey"), key, "left_semi").join(items.filter("l_linestatus = 'O'").select("l_orderkey"), key, "left_anti")
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@R.over("duplicate_content_groups", "documents", sql="SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS canonical FROM documents GROUP BY sha HAVING count(*) > 1")
def _(docs: DataFrame) -> DataFrame:
    return C.duplicate_groups(docs, F.col("text"), "doc_id")


@R.over("canonical_duplicate_state", "documents", sql="""
SELECT doc_id, CASE WHEN n = 1 THEN 'unique' WHEN doc_id = first THEN 'canonical' ELSE 'duplicate_noncanonical' END AS state, n AS twins
FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)""")
def _(docs: DataFrame) -> DataFrame:
    return C.with_canonical(docs.select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "state", "twins")


@R.over("single_current_winner", "orders", sql="""
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey) = 1 AS is_current FROM orders""")
def _(orders: DataFrame) -> DataFrame:
    rows = orders.withColumn("done", F.col("o_orderstatus") == "F")
    return C.single_winner(rows, ["o_custkey"], "done", F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "o_custkey", "is_current")


@R.over("output_priority", "orders", sql="""
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) = 1""")
def _(orders: DataFrame) -> DataFrame:
    return C.latest(orders, ["o_custkey"], F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@R.over("upsert_fill_empty", "customer", sql="""
WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey, c_name, lower(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(nullif(o.c_name, ''), nullif(n.c_name, '')) AS c_name, coalesce(nullif(o.c_mktsegment, ''), n.c_mktsegment) AS c_mktsegment,
CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def _(customer: DataFrame) -> DataFrame:
    old = customer.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment")
    new = customer.filter("c_custkey % 7 <> 0").select("c_custkey", "c_name", F.lower("c_mktsegment").alias("c_mktsegment"))
    return C.upsert(old, new, "c_custkey", ["c_name", "c_mktsegment"], overwrite=False)


@R.over("upsert_overwrite", "customer", sql="""
WITH o AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE upper(c_name) END AS c_name FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(nullif(n.c_name, ''), nullif(o.c_name, '')) AS c_name,
CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def _(customer: DataFrame) -> DataFrame:
    old = customer.filter("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    new = customer.filter("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.upper("c_name")).alias("c_name"))
    return C.upsert(old, new, "c_custkey", ["c_name"], overwrite=True)


@R.over("entity_merge", "customer", sql="""
SELECT k.c_custkey AS id, d.c_custkey AS dropped, coalesce(nullif(CASE WHEN k.c_custkey % 4 = 0 THEN '' ELSE k.c_name END, ''), d.c_name) AS name, greatest(k.c_nationkey, d.c_nationkey) AS stage
FROM customer k JOIN customer d ON d.c_custkey = k.c_custkey + 1 WHERE k.c_custkey % 2 = 0""")
def _(customer: DataFrame) -> DataFrame:
    rows = customer.select(F.col("c_custkey").alias("id"), F.when((F.col("c_custkey") % 4 == 0), "").otherwise(F.col("c_name")).alias("name"), F.col("c_nationkey").alias("stage"))
    dropped = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("stage"))
    pairs = customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("kept"), (F.col("c_custkey") + 1).alias("dropped"))
    return C.merge_entities(rows, dropped, pairs, ["name"], "stage")


@R.over("run_delta", "events", sql="""
WITH b AS (SELECT user_id, event_type, count(*) AS old FROM events WHERE day(ts) <= 15 GROUP BY ALL), a AS (SELECT user_id, event_type, count(*) AS new FROM events WHERE day(ts) > 15 GROUP BY ALL)
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, old, new,
CASE WHEN new IS NULL THEN 'removed' WHEN old IS NULL THEN 'added' WHEN old = new THEN 'stable' ELSE 'changed' END AS change FROM b FULL JOIN a ON b.user_id = a.user_id AND b.event_type = a.event_type""")
def _(events: DataFrame) -> DataFrame:
    keys = ["user_id", "event_type"]
    half = lambda c: events.filter(c).groupBy(*keys).agg(F.count("*").alias("n"))
    return C.run_delta(half(F.dayofmonth("ts") <= 15), half(F.dayofmonth("ts") > 15), keys, "n")


@R.over("title_patterns", "part", sql="""
WITH k AS (SELECT p_brand, p_name, lower(regexp_extract(trim(p_name), '([^ ]+)$', 1)) AS suffix FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, suffix ORDER BY p_name) AS rn FROM k)
SELECT p_brand, suffix, count(*) AS n, string_agg(p_name, ' / ' ORDER BY p_name) FILTER (WHERE rn <= 3) AS examples FROM r GROUP BY ALL ORDER BY n DESC, p_brand, suffix LIMIT 10""")
def _(part: DataFrame) -> DataFrame:
    return C.title_patterns(part, "p_brand", "p_name")


@R.over("counter_maps", "orders", sql="""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""")
def _(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@R.over("nulls_last_places", "documents", "labels", sql="""
SELECT d.doc_id, l.toxic, row_number() OVER (ORDER BY l.toxic DESC NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The place of every row."""
    rows = docs.select("doc_id").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return B.ranked_by_ranges(rows.withColumn("__all", F.lit(0)), ["__all"], [-F.col("toxic")], "doc_id").select("doc_id", "toxic", "place")


@R.over("category_map", "events", sql="""
SELECT CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'interaction' WHEN 'purchase' THEN 'commerce' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY category""")
def _(events: DataFrame) -> DataFrame:
    lookup = F.create_map(*(F.lit(x) for x in ("click", "interaction", "view", "interaction", "purchase", "commerce")))
    return events.groupBy(F.coalesce(lookup[F.col("event_type")], F.lit("other")).alias("category")).agg(F.count("*").alias("n"))


@R.over("set_operations", "orders", "customer", sql="""
SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'only_customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'only_orders', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def _(orders: DataFrame, customer: DataFrame) -> DataFrame:
    c, o = customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))
    count = lambda rows, side: rows.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(c.intersect(o), "both").unionByName(count(c.subtract(o), "only_customer")).unionByName(count(o.subtract(c), "only_orders"))


@R.over("progress_percent", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, CAST(trunc(least(100, greatest(0, CASE WHEN l_discount * 12 BETWEEN 0 AND 1 THEN l_discount * 12 * 100 ELSE l_discount * 12 END))) AS INTEGER) AS percent FROM lineitem""")
def _(items: DataFrame) -> DataFrame:
    return items.select("l_orderkey", "l_linenumber", X.progress_percent(F.col("l_discount") * 12).alias("percent"))
