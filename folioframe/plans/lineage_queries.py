"""Lineage, markers, plans and event windows over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import blocks as B
from folioframe.operators import catalog as C
from folioframe.operators import lineage as L
from folioframe.plans.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: Event types read as status markers.
MARKER = {"purchase": "done", "error": "mineru_error", "click": "processing", "signup": "popo_done"}
_SQL_MARKER = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'mineru_error' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'popo_done' ELSE 'collected' END"
_TERMINAL = "('done', 'popo_done', 'mineru_error')"


def markers(events: DataFrame) -> DataFrame:
    lookup = F.create_map(*(F.lit(x) for pair in MARKER.items() for x in pair))
    return events.select("user_id", "event_id", "ts", F.coalesce(lookup[F.col("event_type")], F.lit("collected")).alias("status"))


_LATEST = f"""WITH m AS (SELECT user_id, event_id, ts, {_SQL_MARKER} AS status FROM events),
r AS (SELECT *, CASE WHEN status IN {_TERMINAL} THEN 2 WHEN status = 'processing' THEN 1 ELSE 0 END AS k FROM m),
w AS (SELECT * FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, ts DESC, event_id DESC) = 1)"""


@R.over("latest_status_per_key", "events", sql="SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(events: DataFrame) -> DataFrame:
    return C.top_struct(events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@R.over("terminal_beats_active", "events", sql=f"{_LATEST} SELECT user_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM w")
def _(events: DataFrame) -> DataFrame:
    return L.latest_status(markers(events), "user_id", "status", "ts", "event_id").select("user_id", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@R.over("marker_status_counts", "events", sql=f"""WITH m AS (SELECT {_SQL_MARKER} AS status FROM events)
SELECT status, CASE WHEN status IN {_TERMINAL} THEN 'terminal' WHEN status = 'processing' THEN 'active' ELSE 'other' END AS class, count(*) AS n FROM m GROUP BY ALL""")
def _(events: DataFrame) -> DataFrame:
    return markers(events).groupBy("status", L.marker_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


@R.over("marker_reconciliation", "events", sql=f"""{_LATEST}, c AS (SELECT user_id, count(*) AS n_markers, count(*) FILTER (WHERE status = 'mineru_error') AS n_errors FROM m GROUP BY user_id)
SELECT c.user_id, n_markers, n_errors, w.status, CASE WHEN w.status = 'mineru_error' THEN 0 ELSE n_errors END AS n_superseded FROM c LEFT JOIN w USING (user_id)""")
def _(events: DataFrame) -> DataFrame:
    return L.reconcile(markers(events), "user_id", "status", "ts", "event_id").drop("at")


_STATE = """CASE WHEN NOT canonical THEN 'duplicate_noncanonical' WHEN base = 'unprocessed' AND twins > 1 THEN 'duplicate_unprocessed' ELSE base END"""


@R.over("lineage_state", "customer", "orders", "events", sql=f"""{_LATEST},
p AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS popo, bool_or(o_orderstatus = 'O') AS mineru FROM orders GROUP BY o_custkey),
d AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_acctbal) AS twins, c_custkey = min(c_custkey) OVER (PARTITION BY c_acctbal) AS canonical FROM customer),
b AS (SELECT c.c_custkey, d.twins, d.canonical, CASE WHEN coalesce(popo, false) OR coalesce(w.status IN ('popo_done'), false) THEN 'gpu_done' WHEN coalesce(mineru, false) THEN 'mineru_only'
 WHEN coalesce(w.status = 'mineru_error', false) THEN 'error_marked' WHEN coalesce(w.status = 'processing', false) THEN 'processing_marker' ELSE 'unprocessed' END AS base
 FROM customer c JOIN d USING (c_custkey) LEFT JOIN p ON o_custkey = c.c_custkey LEFT JOIN w ON w.user_id = c.c_custkey)
SELECT c_custkey, {_STATE} AS state, CASE {_STATE} WHEN 'gpu_done' THEN 'done' WHEN 'processing_marker' THEN 'active' WHEN 'error_marked' THEN 'needs_review' WHEN 'mineru_only' THEN 'eligible' WHEN 'unprocessed' THEN 'eligible' ELSE 'skip' END AS scheduler FROM b""")
def _(customer: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    jobs = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("popo"), F.bool_or(F.col("o_orderstatus") == "O").alias("mineru"))
    status = L.latest_status(markers(events), "user_id", "status", "ts", "event_id").select(F.col("user_id").alias("c_custkey"), "status")
    twins = customer.groupBy("c_acctbal").agg(F.count("*").alias("twins"), F.min("c_custkey").alias("first"))
    rows = customer.join(twins, "c_acctbal").join(jobs, "c_custkey", "left").join(status, "c_custkey", "left").fillna(False, ["popo", "mineru"]).fillna("", ["status"])
    state = L.state(F.col("popo"), F.col("mineru"), F.col("status"), F.col("twins"), F.col("c_custkey") == F.col("first"))
    return rows.select("c_custkey", state.alias("state")).withColumn("scheduler", L.scheduler_state(F.col("state")))


@R.over("lineage_status_only", "customer", "events", sql=f"""{_LATEST} SELECT c_custkey, CASE WHEN w.status = 'popo_done' THEN 'gpu_done' WHEN w.status = 'mineru_error' THEN 'error_marked' WHEN w.status = 'processing' THEN 'processing_marker' ELSE 'unprocessed' END AS state
FROM customer LEFT JOIN w ON w.user_id = c_custkey""")
def _(customer: DataFrame, events: DataFrame) -> DataFrame:
    status = L.latest_status(markers(events), "user_id", "status", "ts", "event_id")
    rows = customer.select("c_custkey").join(status, F.col("user_id") == F.col("c_custkey"), "left").fillna("", ["status"])
    no, yes = F.lit(False), F.lit(True)
    return rows.select("c_custkey", L.state(no, no, F.col("status"), F.lit(1), yes).alias("state"))


@R.over("asset_gap", "customer", "orders", sql="""
WITH s AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS popo, bool_or(o_orderstatus = 'O') AS mineru, bool_or(o_orderstatus = 'P') AS marker FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN coalesce(popo AND NOT mineru, false) THEN 'popo_without_mineru' WHEN coalesce(mineru AND NOT popo, false) THEN 'mineru_without_popo' WHEN coalesce(marker AND NOT popo AND NOT mineru, false) THEN 'marker_only' WHEN k IS NULL THEN 'nothing' END AS bucket
FROM customer LEFT JOIN s ON k = c_custkey WHERE k IS NULL OR NOT (popo AND mineru)""")
def _(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers in one of four gaps: of two kinds of orders only one, markers only, or nothing. One aggregate, one join."""
    seen = orders.groupBy("o_custkey").agg(*(F.bool_or(F.col("o_orderstatus") == s).alias(name) for s, name in (("F", "popo"), ("O", "mineru"), ("P", "marker"))))
    return L.asset_gap(customer.select("c_custkey").join(seen.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left"), F.col("popo"), F.col("mineru"), F.col("marker")).select("c_custkey", "bucket")


@R.over("pair_gap_diagnostic", "lineitem", "orders", sql="""
SELECT l_orderkey AS k, l_suppkey % 10 AS s FROM lineitem EXCEPT SELECT o_orderkey, o_custkey % 10 FROM orders""")
def _(items: DataFrame, orders: DataFrame) -> DataFrame:
    have = items.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 10).alias("s"))
    return L.gap(have, orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 10).alias("s")), ["k", "s"])


@R.over("stage_job_discovery", "lineitem", sql="""
SELECT l_orderkey, count(*) AS n_objects, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, sum(l_quantity) AS bytes FROM lineitem GROUP BY l_orderkey""")
def _(items: DataFrame) -> DataFrame:
    return items.groupBy("l_orderkey").agg(F.count("*").alias("n_objects"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("kinds"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.sum("l_quantity").alias("bytes"))


@R.over("prefix_size_summary", "pages", sql="""
SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, count(*) AS n_objects, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY host""")
def _(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host")).agg(F.count("*").alias("n_objects"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


def _items(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.col("source").alias("name"), F.when(F.col("lang") == "en", "eligible").otherwise("done").alias("state"))


for _name, _by in (("smallest", "n_chars, doc_id"), ("largest", "n_chars DESC, doc_id"), ("name", "source, doc_id")):
    R.over(f"plan_{_name}", "documents", sql=f"SELECT doc_id AS id, n_chars AS size, source AS name, 'eligible' AS state FROM documents WHERE lang = 'en' ORDER BY {_by} LIMIT 5")(lambda docs, order=_name: L.plan(_items(docs), order, 9))


@R.over("scan_select_dedup", "events", "labels", sql="""
SELECT user_id, event_id FROM (SELECT user_id, event_id, ts FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) ORDER BY ts, event_id LIMIT 25""")
def _(events: DataFrame, labels: DataFrame) -> DataFrame:
    return L.select_fresh(events, labels.withColumnRenamed("doc_id", "user_id"), "user_id", "ts", "event_id", 25).select("user_id", "event_id")


@R.over("result_counts", "orders", sql="""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'PARTIAL' ELSE 'FAILED' END AS s, o_orderkey % 9 AS t, o_custkey % 3 AS g, 0 AS b FROM orders),
x AS (SELECT *, CASE WHEN s = 'DONE' AND g = 0 AND b = 0 THEN t ELSE least(g, t) END AS good FROM r)
SELECT o_orderkey, good AS success, CASE WHEN s = 'PARTIAL' AND g + b < t THEN t - g ELSE least(b, t - good) END AS failed FROM x""")
def _(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("FAILED")
    good, bad = L.result_counts(status, F.col("o_orderkey") % 9, F.col("o_custkey") % 3, F.lit(0).cast("long"))
    return orders.select("o_orderkey", good.alias("success"), bad.alias("failed"))


@R.over("event_hourly", "events", sql="""
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def _(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


@R.over("event_sessions", "events", sql="""
WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL '30 minutes', true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, session""")
def _(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", "n", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@R.over("event_runs", "events", sql="""
WITH g AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS fresh FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM s GROUP BY user_id, run""")
def _(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("place", F.row_number().over(w))
    step = F.coalesce(F.col("event_type") != F.lag("event_type").over(Window.partitionBy("user_id").orderBy("place")), F.lit(True))
    return B.islands(rows, ["user_id"], "place", step).groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@R.over("asof_source", "orders", "events", sql="""
SELECT o.o_orderkey, e.event_id AS last_event FROM (SELECT o_orderkey, o_custkey AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey % 720) AS ts FROM orders) o
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) e ON o.user_id = e.user_id AND o.ts >= e.ts""")
def _(orders: DataFrame, events: DataFrame) -> DataFrame:
    left = orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, o_orderkey % 720)").alias("ts"))
    right = events.groupBy("user_id", "ts").agg(F.max("event_id").alias("last_event")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return B.asof(left, right, "user_id", "ts", ["last_event"]).select("o_orderkey", "last_event")


@R.over("json_props", "events", sql="SELECT event_type, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY event_type")
def _(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


@R.over("downstream_links", "orders", "lineitem", sql="""
SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n_materials, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0)::BIGINT AS n_linked FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def _(orders: DataFrame, items: DataFrame) -> DataFrame:
    links = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("linked"))
    return orders.join(links, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n_materials"), F.coalesce(F.sum("linked"), F.lit(0)).alias("n_linked"))


_KEYS = "concat('in/', CAST(doc_id AS VARCHAR(9)), CASE CAST(doc_id % 7 AS INT) WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE ' a+b.pdf' END)"


@R.over("resolved_inputs", "documents", sql=f"""
WITH l AS (SELECT {_KEYS} AS key, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS size, sha256(text) AS sha FROM documents), p AS (SELECT * FROM l WHERE ends_with(lower(key), '.pdf')),
a AS (SELECT doc_id, [CASE WHEN doc_id % 5 = 0 THEN 'in/none.pdf' ELSE '' END, CASE doc_id % 3 WHEN 0 THEN {_KEYS} WHEN 1 THEN 'in/0 a+b.pdf' ELSE '' END] AS names, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE sha256(text) END AS declared_sha, CASE doc_id % 13 WHEN 1 THEN NULL WHEN 2 THEN n_chars + 1 ELSE n_chars END AS declared_size FROM documents),
n AS (SELECT doc_id, declared_sha, declared_size, unnest(names) AS name, generate_subscripts(names, 1) AS at_ FROM a),
b AS (SELECT n.doc_id, arg_min({{'key': p.key, 'sha': p.sha, 'size': p.size}}, at_) AS f FROM n JOIN p ON p.key = n.name WHERE (declared_size IS NULL OR p.size IS NULL OR declared_size = p.size) AND (declared_sha IS NULL OR declared_sha = p.sha) GROUP BY n.doc_id),
s AS (SELECT a.doc_id, arg_min({{'key': p.key, 'sha': p.sha, 'size': p.size}}, p.key) AS f FROM a JOIN p ON a.declared_sha = p.sha WHERE (declared_size IS NULL OR p.size IS NULL OR declared_size = p.size) AND a.doc_id NOT IN (SELECT doc_id FROM b) GROUP BY a.doc_id)
SELECT a.doc_id, coalesce(b.f, s.f).key AS key, coalesce(b.f, s.f).sha AS sha256, coalesce(b.f, s.f).size AS size, CASE WHEN b.f IS NOT NULL THEN 'name' WHEN s.f IS NOT NULL THEN 'sha' END AS matched_by FROM a LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)""")
def _(docs: DataFrame) -> DataFrame:
    """What each document declares of its input, by a name or a URL, its size and digest, against the listing."""
    i = F.col("doc_id")
    key = F.concat(F.lit("in/"), i.cast("string"), F.when(i % 7 == 1, ".PDF").when(i % 7 == 2, ".txt").otherwise(" a+b.pdf"))
    listed = docs.select(key.alias("key"), F.when(i % 11 != 0, F.col("n_chars")).alias("size"), F.sha2("text", 256).alias("sha256"))
    url = F.when(i % 3 == 0, F.concat(F.lit("http://store:9000/inputs/"), F.replace(F.replace(key, F.lit(" "), F.lit("%20")), F.lit("+"), F.lit("%2B")), F.lit("?sign=1"))).when(i % 3 == 1, "https://store//inputs/in/0%20a+b.pdf#x").otherwise("http://store/other/in/0.pdf")
    names = F.array(F.when(i % 5 == 0, " in/none.pdf ").otherwise(""), L.object_of_url(url, "inputs"))
    size = F.when(i % 13 == 2, F.col("n_chars") + 1).when(i % 13 != 1, F.col("n_chars"))
    asked = docs.select("doc_id", names.alias("names"), F.when(i % 4 != 3, F.sha2("text", 256)).alias("declared_sha"), size.alias("declared_size"))
    return L.resolved_inputs(asked, listed, "doc_id")
