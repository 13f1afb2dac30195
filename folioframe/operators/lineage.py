"""Lineage of source objects through stages: markers, states, gaps, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import ladder

#: Status markers that end a stage, and those that say it is under way.
TERMINAL = ("done", "popo_done", "popo_done_frozen", "mineru_done", "mineru_done_frozen", "error", "mineru_error", "popo_error", "submit_error", "collect_error", "failed")
ACTIVE = ("processing", "submitted", "mineru_submitted", "mineru_running", "popo_submitted", "popo_running")


def marker_class(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), "terminal").when(status.isin(*ACTIVE), "active").otherwise("other")


def latest_status(markers: DataFrame, key: str, status: str, time: str, unique: str) -> DataFrame:
    """The status that counts for each key: any terminal one beats any active one whatever the times;
    among equals the latest by time, then by `unique`. Other markers never win."""
    rank = F.when(marker_class(F.col(status)) == "terminal", 2).when(marker_class(F.col(status)) == "active", 1).otherwise(0)
    best = markers.withColumn("__rank", rank).filter("__rank > 0").groupBy(key).agg(F.max(F.struct("__rank", time, unique, status)).alias("__m"))
    return best.select(key, F.col(f"__m.{status}").alias("status"), F.col(f"__m.{time}").alias("at"))


def reconcile(markers: DataFrame, key: str, status: str, time: str, unique: str) -> DataFrame:
    """For each key: raw errors, and how many a later success supersedes (all, when the latest status is none)."""
    is_error = F.col(status).isin("error", "failed") | F.col(status).endswith("_error")
    counts = markers.groupBy(key).agg(F.count("*").alias("n_markers"), F.count_if(is_error).alias("n_errors"))
    last = latest_status(markers, key, status, time, unique)
    errs = F.col("status").isin("error", "failed") | F.col("status").endswith("_error")
    return counts.join(last, key, "left").withColumn("n_superseded", F.when(F.coalesce(errs, F.lit(False)), F.lit(0)).otherwise(F.col("n_errors")))


def state(popo: Column, mineru: Column, status: Column, twins: Column, canonical: Column) -> Column:
    """The lineage state of a source; duplicates rewrite it last."""
    base = ladder((popo | status.isin("popo_done", "popo_done_frozen"), "gpu_done"), (mineru | status.isin("mineru_done", "mineru_done_frozen"), "mineru_only"), (status.isin("error", "failed") | status.endswith("_error"), "error_marked"), (status.isin(*ACTIVE), "processing_marker"), default="unprocessed")
    return F.when(~canonical, "duplicate_noncanonical").when((base == "unprocessed") & (twins > 1), "duplicate_unprocessed").otherwise(base)


def scheduler_state(lineage: Column) -> Column:
    return ladder((lineage == "gpu_done", "done"), (lineage == "processing_marker", "active"), (lineage == "error_marked", "needs_review"), (lineage.startswith("duplicate"), "skip"), default="eligible")


def gap(have: DataFrame, need: DataFrame, key: list[str]) -> DataFrame:
    """Keys of `have` that `need` lacks."""
    return have.select(*key).distinct().join(need.select(*key), key, "left_anti")


def asset_gap(rows: DataFrame, popo: Column, mineru: Column, marker: Column) -> DataFrame:
    """The rows that lack something, with which of four gaps they have; a null flag counts as missing."""
    p, m, k = (F.coalesce(c, F.lit(False)) for c in (popo, mineru, marker))
    return rows.withColumn("bucket", F.when(p & ~m, "popo_without_mineru").when(m & ~p, "mineru_without_popo").when(k & ~p & ~m, "marker_only").when(~p & ~m, "nothing")).filter("bucket is not null")


def plan(items: DataFrame, order: str = "smallest", limit: int = 5) -> DataFrame:
    """At most five eligible items (columns id, size, name, state)."""
    by = {"smallest": [F.asc("size"), F.asc("id")], "largest": [F.desc("size"), F.asc("id")], "name": [F.asc("name"), F.asc("id")]}[order]
    return items.filter("state = 'eligible'").orderBy(*by).limit(max(1, min(5, limit)))


def plan_status(active: Column, allowed: Column, selected: Column, filtered: Column) -> Column:
    return ladder(((active > 0) & ~allowed, "BLOCKED_ACTIVE_MARKERS"), (selected > 0, "READY"), (filtered, "TARGET_NOT_ELIGIBLE"), default="IDLE")


def select_fresh(items: DataFrame, locked: DataFrame, material: str, time: str, unique: str, limit: int) -> DataFrame:
    """The oldest item of each material that is not locked, oldest materials first, up to `limit`."""
    free = items.join(locked.select(material).distinct(), material, "left_anti")
    w = Window.partitionBy(material).orderBy(time, unique)
    return free.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn").orderBy(time, unique).limit(limit)


def result_counts(status: Column, total: Column, success: Column, failed: Column) -> tuple[Column, Column]:
    """Counts repaired by the status: DONE without any is all success; PARTIAL that falls short has failed the rest."""
    good = F.when((status == "DONE") & (success == 0) & (failed == 0), total).otherwise(F.least(success, total))
    bad = F.when((status == "PARTIAL") & (success + failed < total), total - success).otherwise(F.least(failed, total - good))
    return good, bad


def object_of_url(url: Column, bucket: str) -> Column:
    """The object of a URL whose path begins with the bucket, decoded; '' for any other, and for null."""
    path = F.regexp_replace(F.try_url_decode(F.replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit("+"), F.lit("%2B"))), "^/+", "")
    return F.coalesce(F.when(F.startswith(path, F.lit(bucket + "/")), F.substring(path, len(bucket) + 2, 1 << 30)), F.lit(""))


def resolved_inputs(asked: DataFrame, listed: DataFrame, id_: str) -> DataFrame:
    """(id_, key, sha256, size, matched_by) of each row of `asked` (id_, names: array, declared_sha, declared_size): the listed PDF (key, size, sha256) that it means.

    Its names are tried in order: the first that is listed, with the declared size and digest where these are declared, is it (matched_by name). Else the first key, by name, with the declared
    digest and size (sha). Else all is null. Blank names are left out; a listed size that is null agrees with any. Ids and keys are unique."""
    pdfs = listed.filter(F.endswith(F.lower("key"), F.lit(".pdf")))
    sized = F.col("declared_size").isNull() | F.col("size").isNull() | (F.col("declared_size") == F.col("size"))
    sha = F.nullif("declared_sha", F.lit(""))
    names = asked.select(id_, sha.alias("__sha"), "declared_size", F.posexplode("names").alias("__at", "key")).withColumn("key", F.trim("key")).filter("key <> ''")
    found = lambda rows, how, order: rows.groupBy(id_).agg(F.min(F.struct(order, "key", "sha256", "size")).alias(how))
    by_name = found(names.join(pdfs, "key").filter(sized & (F.col("__sha").isNull() | (F.col("__sha") == F.col("sha256")))), "name", "__at")
    left = asked.join(by_name, id_, "left_anti").select(id_, sha.alias("sha256"), "declared_size").filter("sha256 is not null")
    # One digest may have many keys and be asked for often: the first key of each (digest, size) goes into the join, not every copy.
    first = pdfs.groupBy("sha256", "size").agg(F.min("key").alias("key"))
    by_sha = found(left.join(first, "sha256").filter(sized).withColumn("__k", F.col("key")), "sha", "__k")
    rows = asked.select(id_).join(by_name, id_, "left").join(by_sha, id_, "left")
    best = lambda c: F.coalesce(f"name.{c}", f"sha.{c}").alias(c)
    return rows.select(id_, *map(best, ("key", "sha256", "size")), F.when(F.col("name").isNotNull(), "name").when(F.col("sha").isNotNull(), "sha").alias("matched_by"))
