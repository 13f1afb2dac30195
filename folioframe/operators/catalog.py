"""Catalogue operators: listings, facets, counts, winners, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; make the last column a unique one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_struct(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """As latest() by descending columns, by a mergeable aggregate: hot keys meet in partial results."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *(k for k in keep if k not in order))).alias("__t")).select(*keys, *(F.col(f"__t.{c}").alias(c) for c in dict.fromkeys([*order, *keep])))


def search(rows: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column contains the query, in either case; % and _ are ordinary characters."""
    return rows.filter(reduce(Column.__or__, (F.contains(F.lower(F.col(c)), F.lit(query.lower())) for c in columns)))


def page(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of at most 100 rows; `order` must end with a unique column."""
    size = max(1, min(100, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def fixed_counts(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """How many rows have each of the values; zeros are kept."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"{column} string, position int")
    counts = rows.filter(F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(counts, column, "left").select(column, "position", F.coalesce("n", F.lit(0)).alias("n"))


def facets(rows: DataFrame, columns: Sequence[str], limit: int = 100) -> DataFrame:
    """Distinct non-empty values of each column, the first `limit` of each: one scan, and a ranking that stops at the limit."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    values = rows.select(pairs.alias("p")).select("p.*").filter("value <> ''").distinct()
    return values.withColumn("__rn", F.row_number().over(Window.partitionBy("field").orderBy("value"))).filter(F.col("__rn") <= limit).drop("__rn")


def value_stats(rows: DataFrame, columns: Sequence[str], manual: Column, confidence: Column, limit: int = 24) -> DataFrame:
    """For each field and value: rows, manual rows, mean confidence, authority; the top ones of each field."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    long = rows.select(manual.alias("manual"), confidence.alias("confidence"), pairs.alias("p")).select("p.*", "manual", "confidence").filter("value <> ''")
    stats = long.groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if("manual").alias("n_manual"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    stats = stats.withColumn("authority", F.when(F.col("n_manual") > 0, "manual_confirmed").otherwise("suggested"))
    w = Window.partitionBy("field").orderBy(F.desc("n_manual"), F.desc("n"), F.desc_nulls_last("mean_confidence"), "value")
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def duplicate_groups(rows: DataFrame, content: Column, id_: str) -> DataFrame:
    """For each content that several rows share: its hash, the number of rows, and the canonical (smallest) id."""
    return rows.select(F.sha2(content, 256).alias("sha"), id_).groupBy("sha").agg(F.count("*").alias("n"), F.min(id_).alias("canonical")).filter("n > 1")


def with_canonical(rows: DataFrame, content: Column, id_: str) -> DataFrame:
    """Every row with the state of its content: unique, canonical or noncanonical duplicate; a row without content is unique.
    Counts are aggregated before the join, so a content that many rows share is joined, never gathered."""
    hashed = rows.withColumn("sha", F.sha2(content, 256))
    groups = hashed.filter("sha is not null").groupBy("sha").agg(F.count("*").alias("twins"), F.min(id_).alias("canonical"))
    state = F.when(F.coalesce("twins", F.lit(1)) == 1, "unique").when(F.col(id_) == F.col("canonical"), "canonical").otherwise("duplicate_noncanonical")
    return hashed.join(groups, "sha", "left").withColumn("state", state)


def single_winner(rows: DataFrame, keys: Sequence[str], current: str, *order: Column) -> DataFrame:
    """Flags one row of each key: current ones first, else the best by `order`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(current), *order)
    return rows.withColumn("is_current", F.row_number().over(w) == 1)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], *, overwrite: bool) -> DataFrame:
    """Rows of both by key. Filled in where empty, or overwritten where the new value is there."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(*(F.when(F.col(f"{side}.{c}").cast("string") != "", F.col(f"{side}.{c}")) for side in ("no" if overwrite else "on")))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(pick(c).alias(c) for c in columns), F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "kept").otherwise("updated").alias("change"))


def merge_entities(by_ref: DataFrame, by_id: DataFrame, pairs: DataFrame, columns: Sequence[str], stage: str) -> DataFrame:
    """Rows kept (`kept` in pairs) with empty columns filled from their duplicates, and the higher stage."""
    k, d = by_ref.alias("k"), by_id.alias("d")
    joined = pairs.join(k, F.col("kept") == F.col("k.id")).join(d, F.col("dropped") == F.col("d.id"))
    fill = lambda c: F.coalesce(F.when(F.col(f"k.{c}") != "", F.col(f"k.{c}")), F.col(f"d.{c}")).alias(c)
    return joined.select(F.col("kept").alias("id"), "dropped", *map(fill, columns), F.greatest(f"k.{stage}", f"d.{stage}").alias(stage))


def run_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison of two runs: removed, added, changed or stable."""
    b, a = before.select(*keys, F.col(value).alias("old")).withColumn("in_b", F.lit(True)), after.select(*keys, F.col(value).alias("new")).withColumn("in_a", F.lit(True))
    change = F.when(F.col("in_a").isNull(), "removed").when(F.col("in_b").isNull(), "added").when(F.equal_null("old", "new"), "stable").otherwise("changed")
    return b.join(a, list(keys), "full_outer").withColumn("change", change).drop("in_a", "in_b")


def title_patterns(rows: DataFrame, series: str, title: str, limit: int = 10) -> DataFrame:
    """Titles by series and their last word: counts and the first three examples.

    Groups are counted before they are shuffled, and of each only its first three titles leave a task."""
    keyed = rows.withColumn("suffix", F.lower(F.element_at(F.split(F.trim(F.col(title)), " +"), -1)))
    w = Window.partitionBy(series, "suffix").orderBy(title)
    most = keyed.groupBy(series, "suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), series, "suffix").limit(limit)
    first = keyed.select(F.col(series).alias("__series"), F.col("suffix").alias("__suffix"), title, F.row_number().over(w).alias("__rn")).filter("__rn <= 3")
    found = most.join(first, F.col(series).eqNullSafe(F.col("__series")) & F.col("suffix").eqNullSafe(F.col("__suffix")), "left")
    return found.groupBy(series, "suffix", "n").agg(F.array_join(F.array_sort(F.collect_list(title)), " / ").alias("examples")).orderBy(F.desc("n"), series, "suffix")
