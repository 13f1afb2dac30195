"""The work queue as Structured Streaming: bounded micro-batches, errors set aside, monotone progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "file_id long, user_id long, parse_method string, status string, at timestamp"


def messages(spark: SparkSession, folder: str, slots: int = 4, schema: str = MESSAGE) -> DataFrame:
    """A folder of JSON messages, at most `slots` files in a batch: what the workers have room for."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", slots).json(folder)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, failed: str, checkpoint: str) -> StreamingQuery:
    """Runs `work` on each batch of valid messages. Messages without the needed fields go to `failed`, as do those for which
    `work` sets a column `error` (by try_ functions, say; it then returns file_id and user_id too): one bad message never stops its batch. Both are
    written by batch number, so that a batch that runs again replaces itself. Ends when the folder is read."""
    valid = F.col("file_id").isNotNull() & F.col("user_id").isNotNull()

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        out = work(rows.filter(valid)).persist()
        bad = rows.filter(~valid).select("file_id", "user_id", F.lit("a field is missing").alias("error"))
        good = out
        if "error" in out.columns:
            good = out.filter("error is null").drop("error")
            bad = bad.unionByName(out.filter("error is not null").select("file_id", "user_id", "error"))
        good.write.mode("overwrite").parquet(f"{done}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{failed}/batch={number}")
        out.unpersist()
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Percent that a parser status stands for.
PERCENT = {"queued": 0, "submitted": 5, "running": 50, "collecting": 90, "completed": 100, "failed": 100}


def progress(stream: DataFrame) -> DataFrame:
    """Per file the highest percent and the latest status: progress never goes down within a run."""
    percent = F.coalesce(F.create_map(*(F.lit(x) for p in PERCENT.items() for x in p))[F.col("status")], F.lit(0))
    return stream.groupBy("file_id").agg(F.max(percent).alias("percent"), F.max_by("status", "at").alias("status"))


def required_stages(stream: DataFrame, run: str, stage: str, required: list[str]) -> DataFrame:
    """Per run the evidence stages that are missing."""
    seen = stream.groupBy(run).agg(F.collect_set(stage).alias("seen"))
    return seen.select(run, F.array_except(F.array(*map(F.lit, required)), "seen").alias("missing"))


def hourly(stream: DataFrame, time: str = "at", late: str = "10 minutes") -> DataFrame:
    """Extension: counts by event-time hour with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "status", "n")


def once(stream: DataFrame, time: str = "at", late: str = "10 minutes") -> DataFrame:
    """Extension: each message once, as long as copies come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["file_id", "status"])


def collect_results(submitted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Streamed submissions with the static job table: by doc id, else by content digest."""
    by_id, by_sha = jobs.select("doc_id", F.col("state").alias("s1")), jobs.select("sha", F.col("state").alias("s2"))
    return submitted.join(by_id, "doc_id", "left").join(by_sha, "sha", "left").withColumn("state", F.coalesce("s1", "s2", F.lit("pending"))).drop("s1", "s2")
