"""Sources, sinks and the streaming queue over files and keys made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.plans.registry import Registry, table
from folioframe.sources import readers, sinks
from folioframe.streaming import queue, waits

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _listed(orders: DataFrame) -> DataFrame:
    """Orders as objects of a bucket: manifests, PDFs and files of a run."""
    name = F.when(F.col("o_orderkey") % 3 == 0, "manifest.json").when(F.col("o_orderkey") % 3 == 1, "Body.PDF").otherwise("status/done.json")
    return orders.select(F.concat(F.lit("raw/m"), "o_custkey", F.lit("/r"), "o_orderkey", F.lit("/"), name).alias("key"), F.col("o_totalprice").cast("long").alias("size"))


_KEY = "'raw/m' || o_custkey || '/r' || o_orderkey || '/' || CASE o_orderkey % 3 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'Body.PDF' ELSE 'status/done.json' END"


@R.over("manifest_scan", "orders", sql=f"SELECT {_KEY} AS key, 'm' || o_custkey AS material, 'r' || o_orderkey AS run FROM orders WHERE o_orderkey % 3 = 0")
def _(orders: DataFrame) -> DataFrame:
    material, run = readers.ids_from_manifest(F.col("key"))
    return readers.manifests(_listed(orders)).select("key", material.alias("material"), run.alias("run"))


@R.over("two_level_manifests", "orders", sql="SELECT 'm' || o_custkey AS material, 'r' || o_orderkey AS run FROM orders WHERE o_orderkey % 3 = 0")
def _(orders: DataFrame) -> DataFrame:
    return readers.two_level_manifests(_listed(orders), "raw/")


@R.over("pdf_scan", "orders", sql=f"SELECT {_KEY} AS key FROM orders WHERE o_orderkey % 3 = 1")
def _(orders: DataFrame) -> DataFrame:
    return readers.pdfs(_listed(orders)).select("key")


@R.over("manifest_resolver", "orders", "customer", sql="""
WITH k AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
SELECT c_custkey, CASE WHEN f.o_custkey IS NOT NULL THEN 'm' || c_custkey || '/F' WHEN o.o_custkey IS NOT NULL THEN 'm' || c_custkey || '/O' END AS resolved FROM customer
LEFT JOIN k f ON f.o_custkey = c_custkey AND f.o_orderstatus = 'F' AND c_custkey % 4 <> 0 LEFT JOIN k o ON o.o_custkey = c_custkey AND o.o_orderstatus = 'O'""")
def _(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The first of two candidate keys that is there; a quarter of the rows have no first candidate."""
    key = lambda id_, kind: F.concat(F.lit("m"), id_, F.lit("/"), kind)
    listed = orders.filter("o_orderstatus <> 'P'").select(key(F.col("o_custkey"), F.col("o_orderstatus")).alias("key"))
    rows = customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, key(F.col("c_custkey"), F.lit("F"))).alias("a"), key(F.col("c_custkey"), F.lit("O")).alias("b"))
    return readers.first_existing(rows, ["a", "b"], listed).select("c_custkey", "resolved")


@R.over("json_objects", "events", sql="SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def _(events: DataFrame) -> DataFrame:
    """Bad JSON and arrays read as objects without values."""
    text = F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return events.select("event_id", readers.json_or_empty(text, "k int")["k"].alias("k"))


def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines, with a broken line for each urgent one, and read back without those."""
    folder = sinks.shared_folder(spark)
    orders = table(spark, sf_dir, "orders")
    orders.select(F.explode(F.array(F.to_json(F.struct("o_custkey", "o_orderkey", "o_orderstatus")), F.when(F.col("o_orderpriority") == "1-URGENT", "{not json"))).alias("value")).filter("value is not null").write.text(folder)
    return readers.read_jsonl(spark, folder, "o_orderkey long, o_custkey long, o_orderstatus string").drop("file")


QUERIES["jsonl_round_trip"], ORACLE["jsonl_round_trip"] = _jsonl, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


@R.over("content_lists", "lineitem", sql="""
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS raw_index, CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'text' END AS type, 'p' || l_partkey AS text, CAST(l_suppkey AS INTEGER) AS page_idx FROM lineitem""")
def _(items: DataFrame) -> DataFrame:
    """Lists of blocks as JSON arrays of one document each, read with their ordinals."""
    text = F.concat(F.lit("p"), "l_partkey")
    block = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "table").otherwise("text").alias("type"), F.when(F.col("l_returnflag") != "R", text).alias("text"), F.when(F.col("l_returnflag") == "R", text).alias("table_body"), F.col("l_suppkey").alias("page_idx"))
    docs = items.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(block))).alias("body"))
    return readers.content_list(docs, "l_orderkey", "body").select("l_orderkey", "raw_index", "type", "text", "page_idx")


@R.over("table_cells", "part", sql="SELECT p_partkey, 2 AS n_rows, p_name || '|' || p_brand || ' & co' AS cells FROM part")
def _(part: DataFrame) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>Name<th>Brand</tr><tr><td> "), "p_name", F.lit(" </td><td><b>"), "p_brand", F.lit("</b> &amp; co</table>"))
    rows = part.select("p_partkey", readers.table_rows(html).alias("t"))
    return rows.select("p_partkey", F.size("t").alias("n_rows"), F.array_join(F.transform(F.get("t", F.lit(1)), lambda c: c["text"]), "|").alias("cells"))


@R.over("object_refs", "orders", sql="""
SELECT 'o/' || o_orderkey AS object, sha256(j) AS sha256, CAST(length(j) AS BIGINT) AS size FROM (SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS j FROM orders)""")
def _(orders: DataFrame) -> DataFrame:
    return sinks.with_refs(orders.withColumn("object", F.concat(F.lit("o/"), "o_orderkey")), "raw", "object", ["o_orderstatus", "o_custkey"]).select("object", "sha256", "size")


@R.over("mirror_extra", "orders", "lineitem", sql="SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(orders: DataFrame, items: DataFrame) -> DataFrame:
    return sinks.extra(orders.select("o_orderkey"), items.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@R.over("twin_markers", "customer", sql="""
SELECT 'by-material/' || c_custkey || '/' || c_mktsegment || '.json' AS key FROM customer UNION ALL SELECT 'by-source/' || left(sha256(c_name), 24) || '/' || c_mktsegment || '.json' FROM customer""")
def _(customer: DataFrame) -> DataFrame:
    return sinks.twin_markers(customer, "c_custkey", "c_name", "c_mktsegment").select("key")


@R.over("page_markdown", "conversations", sql=r"""
WITH p AS (SELECT conv_id, turn // 2 AS page, string_agg(role, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY ALL)
SELECT conv_id, md5(string_agg('## Page ' || (page + 1) || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page)) AS digest FROM p GROUP BY conv_id""")
def _(turns: DataFrame) -> DataFrame:
    pages = sinks.page_markdown(turns.withColumn("page", F.floor(F.col("turn") / 2)), "conv_id", "page", "turn", "role")
    return pages.select("conv_id", F.md5("markdown").alias("digest"))


@R.over("backup_head", "orders", sql=f"""
SELECT key, size, CASE WHEN key LIKE '%/manifest.json' THEN 'manifest' WHEN key LIKE '%/status/%' THEN 'status_marker' WHEN regexp_matches(key, '\\.(pdf|png|jpe?g|md|json)$') THEN 'official' ELSE 'auxiliary' END AS class, true AS truncated FROM (SELECT {_KEY} AS key, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders) ORDER BY key LIMIT 50""")
def _(orders: DataFrame) -> DataFrame:
    """The first fifty objects of a backup, with their class; the limit is the feature."""
    return sinks.backup_plan(_listed(orders), 50)


@R.over("missing_stages", "events", sql="""
SELECT user_id, array_to_string(list_filter(['click', 'purchase', 'audit'], lambda x: NOT list_contains(s, x)), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY user_id)""")
def _(events: DataFrame) -> DataFrame:
    return queue.required_stages(events, "user_id", "event_type", ["click", "purchase", "audit"]).select("user_id", F.array_join("missing", ",").alias("missing"))


@R.over("collected_results", "orders", "customer", sql="""
SELECT c_custkey, CASE WHEN a.o_custkey IS NOT NULL THEN 'by id' WHEN b.o_custkey IS NOT NULL THEN 'by sha' ELSE 'pending' END AS state FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') a ON a.o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') b ON b.o_custkey = c_custkey + 1""")
def _(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Submissions with their jobs: by document id, else by content digest."""
    job = lambda status, doc, sha, state: orders.filter(F.col("o_orderstatus") == status).select(doc.cast("long").alias("doc_id"), sha.cast("string").alias("sha"), F.lit(state).alias("state")).distinct()
    null, key = F.lit(None), F.col("o_custkey")
    jobs = job("P", key, null, "by id").unionByName(job("F", null, F.sha2(key.cast("string"), 256), "by sha"))
    submitted = customer.select("c_custkey", F.col("c_custkey").alias("doc_id"), F.sha2((F.col("c_custkey") + 1).cast("string"), 256).alias("sha"))
    return queue.collect_results(submitted, jobs).select("c_custkey", "state")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages through the streaming queue: what was done, and what failed with its error."""
    folder = sinks.shared_folder(spark)
    table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"), F.col("event_type").alias("status")).write.json(f"{folder}/in")
    work = lambda rows: rows.select("file_id", "user_id", F.when(F.col("status") == "signup", "no parser").alias("error"))
    queue.process(queue.messages(spark, f"{folder}/in"), work, f"{folder}/done", f"{folder}/failed", f"{folder}/progress").awaitTermination()
    done = spark.read.schema("file_id long, user_id long").parquet(f"{folder}/done").select("file_id", F.lit("").alias("error"))
    return done.unionByName(spark.read.schema("file_id long, user_id long, error string").parquet(f"{folder}/failed").select("file_id", "error"))


QUERIES["stream_queue"] = _queue
ORACLE["stream_queue"] = "SELECT event_id AS file_id, CASE event_type WHEN 'error' THEN 'a field is missing' WHEN 'signup' THEN 'no parser' ELSE '' END AS error FROM events"


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of a user are a run that ends with a purchase within a day of its first event; the stream is read in two
    parts, the second by a new query from the checkpoint of the first."""
    folder = sinks.shared_folder(spark)
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.floor((F.dayofmonth("ts") - 1) / 3)).cast("long").alias("run"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    middle = F.lit("2024-01-15").cast("timestamp")
    for part, rows in enumerate((events.filter(F.col("at") < middle), events.filter(F.col("at") >= middle))):
        rows.write.mode("append").parquet(f"{folder}/in")
        told = waits.stage_waits(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), "run", "status", "at", ends=["purchase"], seconds=86_400, keep_seconds=4 * 86_400)
        told.writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("run long, wait_status string, at timestamp").parquet(f"{folder}/told")
    return waits.with_waiting(found, events, "run").select("run", "wait_status", F.unix_millis("at").alias("ms"))


QUERIES["stage_waits"] = _waits
ORACLE["stage_waits"] = """
WITH e AS (SELECT CAST(user_id * 100 + (day(ts) - 1) // 3 AS BIGINT) AS run, event_type, epoch_us(ts) // 1000 AS ms FROM events), w AS (SELECT max(ms) - 10000 AS w FROM e),
r AS (SELECT run, min(ms) + 86400000 AS deadline, max(ms) AS last, min(ms) FILTER (event_type = 'purchase') AS ended FROM e GROUP BY run)
SELECT run, CASE WHEN ended <= deadline THEN 'terminal' WHEN last > deadline OR w >= deadline THEN 'timed_out' ELSE 'waiting' END AS wait_status, CASE WHEN ended <= deadline THEN ended WHEN last > deadline OR w >= deadline THEN deadline END AS ms FROM r, w"""
