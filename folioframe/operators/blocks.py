"""Ordered rows of one document: heading paths, neighbours, carry-forward, islands, intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import ladder


def lines(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, line_no, line), numbered from 1; all of Python's line ends count, one at the end of the text gives no line."""
    parts = F.split(F.regexp_replace(F.col(text), "(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])$", ""), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return docs.filter(F.col(text) != "").select(id_, F.posexplode(parts).alias("pos", "line")).select(id_, (F.col("pos") + 1).alias("line_no"), "line")


def line_type(line: Column) -> Column:
    """The decision list that types a markdown line; the order matters."""
    return ladder(
        (F.rlike(line, F.lit("^#{1,6} +")), "heading"),
        (F.rlike(line, F.lit(r"^!\[")), "image"),
        (F.rlike(line, F.lit(r"^(\||<table)")), "table"),
        (F.rlike(line, F.lit(r"\$")), "formula"),
        (F.rlike(line, F.lit(r"^(Figure|Fig\.|Table) [0-9]+")), "caption"),
        (F.rlike(line, F.lit(r"^[0-9]+[.)] ")), "question"),
        (F.rlike(line, F.lit(r"^[A-D][.)] ")), "option"),
        (F.rlike(line, F.lit("_{3,}")), "blank"),
        (F.rlike(line, F.lit(r"^[^:]{1,79}:$")), "label"),
        (F.rlike(line, F.lit("^[ \t]*$")), "empty"),
        default="paragraph",
    )


def heading_path(rows: DataFrame, doc: str, order: str, level: str, title: str, depth: int = 6) -> DataFrame:
    """The path by the pop rule: an ancestor of level k counts unless a smaller level came after it.
    Windows only; one document is one partition."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(1, depth + 1):
        own = F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("at"), F.col(title).alias("t"))), ignorenulls=True).over(w)
        reset = F.last(F.when(F.col(level) < k, F.col(order)), ignorenulls=True).over(w)
        parts.append(F.when(reset.isNull() | (reset < own["at"]), own["t"]))
    return rows.withColumn("path", F.array_compact(F.array(*parts)))


def heading_path_positional(rows: DataFrame, doc: str, order: str, level: str, title: str, depth: int = 6) -> DataFrame:
    """The path by the positional rule: cut to level - 1 entries, then append; siblings nest where levels skip. Rows without level
    keep the path. The n-th heading's depth is min(level, depth before + 1), that is n plus the least level - n so far; an entry of the path
    is the last title of its depth."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__n", F.count(level).over(w))
    rows = rows.withColumn("__depth", (F.col("__n") + F.least(F.lit(0), F.min(F.col(level) - F.col("__n")).over(w))).cast("int"))
    parts = (F.last(F.when(F.col(level).isNotNull() & (F.col("__depth") == k), F.coalesce(title, F.lit(""))), ignorenulls=True).over(w) for k in range(1, depth + 1))
    return rows.withColumn("path", F.slice(F.array(*parts), F.lit(1), F.col("__depth"))).drop("__n", "__depth")


def carry_parent(rows: DataFrame, doc: str, order: str, *, parent: Column, reset: Column, child: Column, id_: str) -> DataFrame:
    """For each child the id of the last parent row, unless a reset came after it; other rows have null."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    p = F.last(F.when(parent, F.struct(F.col(order).alias("at"), F.col(id_).alias("id"))), ignorenulls=True).over(w)
    r = F.last(F.when(reset, F.col(order)), ignorenulls=True).over(w)
    return rows.withColumn("__p", p).withColumn("__r", r).withColumn("parent_id", F.when(child & (F.col("__r").isNull() | (F.col("__r") < F.col("__p.at"))), F.col("__p.id"))).drop("__p", "__r")


def neighbours(rows: DataFrame, doc: Sequence[str], order: str, value: str, before: int = 3, after: int = 3) -> DataFrame:
    """Arrays of the values of the rows before and after."""
    w = Window.partitionBy(*doc).orderBy(order)
    return rows.withColumn("before", F.collect_list(value).over(w.rowsBetween(-before, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, after)))


def look_back(rows: DataFrame, doc: str, order: str, *, anchor: Column, stop: Column, id_: str, reach: int = 7) -> DataFrame:
    """The nearest anchor among the `reach` rows before, unless a stop row lies between."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(-reach, -1)
    a = F.last(F.when(anchor, F.struct(F.col(order).alias("at"), F.col(id_).alias("id"))), ignorenulls=True).over(w)
    s = F.last(F.when(stop, F.col(order)), ignorenulls=True).over(w)
    return rows.withColumn("__a", a).withColumn("__s", s).withColumn("anchor_id", F.when(F.col("__s").isNull() | (F.col("__s") <= F.col("__a.at")), F.col("__a.id"))).drop("__a", "__s")


def islands(rows: DataFrame, group: Sequence[str], order: str, step: Column) -> DataFrame:
    """Runs of rows: a new one where `step` (an expression over the row and lag windows) holds."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("__new", step).withColumn("run", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs_of_ids(rows: DataFrame, group: Sequence[str], id_: str) -> DataFrame:
    """(group, run, first, n): runs of consecutive whole ids, numbered in each group; an id occurs once in its group. Within a run the id
    less its place is one number, and places come from ranges (`ranked_by_ranges`), so that no window holds a group."""
    placed = ranked_by_ranges(rows.select(*group, id_), group, [], id_, "__place").withColumn("__run", F.col(id_) - F.col("__place"))
    runs = placed.groupBy(*group, "__run").agg(F.min(id_).alias("first"), F.count("*").alias("n")).drop("__run")
    return ranked_by_ranges(runs, group, [], "first", "run").select(*group, "run", "first", "n")


def next_known(rows: DataFrame, group: Sequence[str], order: str, value: str) -> Column:
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return F.first(value, ignorenulls=True).over(w)


def asof(left: DataFrame, right: DataFrame, key: str, time: str, payload: Sequence[str]) -> DataFrame:
    """Each left row with the payload of the last right row at or before it: one union and one window, no range join."""
    tagged = left.withColumn("__right", F.lit(0)).unionByName(right.select(key, time, F.struct(*payload).alias("__v")).withColumn("__right", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(time), F.desc("__right")).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__right = 0")
    return out.select(*left.columns, *(F.col(f"__last.{c}").alias(c) for c in payload))


def interval_owner(pages: DataFrame, units: DataFrame, doc: str, page: str, start: str, end: str, index: str, unit: str) -> DataFrame:
    """The unit of each page: of those that start at or before it, containing ones (open ends count) first,
    then the latest start, then the latest index; the first unit if none starts in time."""
    inside = F.col(end).isNull() | (F.col(page) <= F.col(end))
    first = units.groupBy(doc).agg(F.min_by(unit, F.struct(start, index)).alias("__first"))
    best = pages.join(units, doc).filter(F.col(start) <= F.col(page)).groupBy(doc, page).agg(F.max_by(unit, F.struct(inside.alias("i"), F.col(start).alias("s"), F.col(index).alias("x"))).alias("__best"))
    return pages.join(best, [doc, page], "left").join(first, doc, "left").withColumn("owner", F.coalesce("__best", "__first")).drop("__best", "__first")


def prefix_offsets(rows: DataFrame, group: Sequence[str], order: str, text: str) -> DataFrame:
    """[start, end) of each row in the concatenation of its group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(text)).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length(text))


def ranked_by_ranges(rows: DataFrame, group: Sequence[str], coarse: Sequence[Column], unique: str, name: str = "place") -> DataFrame:
    """The place of every row in its group, by `coarse` columns of few values, then `unique` (nulls last), where a group may
    hold most of the table: rows are numbered within ranges of `unique`, and the sizes of all ranges before are added, so that no
    window holds a group. What is gathered is one row a range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.agg(F.percentile_approx(unique, [k / n for k in range(1, n)] or [0.5])).first()[0] or []
    part = F.coalesce(sum(((F.col(unique) > e).cast("int") for e in sorted(set(edges))), F.lit(0)), F.lit(n))
    keys = [*group, *(f"__c{k}" for k in range(len(coarse))), "__part"]
    rows = rows.select("*", *(F.struct(F.isnull(c), c).alias(f"__c{k}") for k, c in enumerate(coarse)), part.alias("__part"))
    before = Window.partitionBy(*group).orderBy(*keys[len(group) :]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(unique)))).alias("r")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    out = ranked.join(sizes.alias("s"), reduce(Column.__and__, same))
    return out.select("r.*", (F.col("__first") + F.col("__rank")).alias(name)).drop("__rank", *keys[len(group) :])
