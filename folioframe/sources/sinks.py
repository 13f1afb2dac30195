"""Sinks: JSON with digests, mirrors, markers, upserts on files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a table in a new shared folder: what reads them again doesn't make them again."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_refs(rows: DataFrame, bucket: str, object_: str, columns: list[str]) -> DataFrame:
    """(bucket, object, body, sha256, size): each row's columns as one JSON object with its reference."""
    body = F.to_json(F.struct(*sorted(columns)))
    return rows.select(F.lit(bucket).alias("bucket"), F.col(object_).alias("object"), body.alias("body")).withColumn("sha256", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a row, keys sorted."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)


def mirror(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that `rows` have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def extra(listed: DataFrame, published: DataFrame, key: str = "key") -> DataFrame:
    """Listed objects that were not published: what a mirror deletes."""
    return listed.join(published.select(key).distinct(), key, "left_anti")


def twin_markers(rows: DataFrame, material: str, source: str, status: str) -> DataFrame:
    """Two status markers a row: one below the material, one below the source's hash."""
    by = lambda folder, key: F.concat_ws("/", F.lit(folder), key, F.concat(F.col(status), F.lit(".json")))
    hashed = F.substring(F.sha2(F.col(source), 256), 1, 24)
    return rows.select(F.explode(F.array(by("by-material", F.col(material)), by("by-source", hashed))).alias("key"), material, status)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def page_markdown(rows: DataFrame, doc: str, page: str, order: str, text: str) -> DataFrame:
    """(doc, markdown): one section a page, blocks parted by blank lines. A document is the unit of a group."""
    pages = rows.groupBy(doc, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("body"))
    section = F.concat(F.lit("## Page "), (F.col(page) + 1).cast("string"), F.lit("\n\n"), F.col("body"))
    return pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), section.alias("s")))), lambda x: x["s"]), "\n\n").alias("markdown"))


def backup_plan(listed: DataFrame, limit: int) -> DataFrame:
    """The first `limit` objects by key with their class, and whether there were more."""
    kind = F.when(F.col("key").endswith("/manifest.json"), "manifest").when(F.contains("key", F.lit("/status/")), "status_marker").when(F.rlike("key", F.lit(r"\.(pdf|png|jpe?g|md|json)$")), "official").otherwise("auxiliary")
    from pyspark.sql import Window

    head = listed.select("key", "size", kind.alias("class")).orderBy("key").limit(limit + 1)
    n = F.count("*").over(Window.partitionBy())
    return head.withColumn("truncated", n > limit).orderBy("key").limit(limit)
