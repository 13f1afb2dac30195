"""Joins of clean text with evidence rows: keys, windows, ordinals, overlaps."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A side of a join is broadcast up to this many bytes by its own count, beyond it both sides are shuffled.
BROADCAST_BYTES = 8 << 20


def small(side: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`side` with a broadcast hint if the text in it is small, else as it is."""
    size = side.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def unique_key_join(left: DataFrame, right: DataFrame, key: str, id_: str, minimum: int = 4) -> DataFrame:
    """Left rows with the right row of the same key where it is the only one; status tells the rest."""
    counts = right.groupBy(key).agg(F.count("*").alias("__n"), F.min(id_).alias("__id"))
    out = left.join(counts, key, "left")
    status = F.when(F.length(key) < minimum, "key_too_short").when(F.col("__n").isNull(), "not_found").when(F.col("__n") == 1, "unique").otherwise("ambiguous")
    return out.withColumn("match_status", status).withColumn("match_id", F.when(F.col("match_status") == "unique", F.col("__id"))).drop("__n", "__id")


def windows(rows: DataFrame, group: Sequence[str], order: str, text: str, most: int, between: str = "") -> DataFrame:
    """All runs of 1 to `most` consecutive rows: first order, number of rows, joined text; cut tails are left out."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(0, most - 1)
    kept = [*group, order]
    return rows.withColumn("__t", F.collect_list(text).over(w)).select(*kept, F.explode(F.sequence(F.lit(1), F.size("__t"))).alias("n_rows"), "__t").select(*kept, "n_rows", F.array_join(F.slice("__t", 1, F.col("n_rows")), between).alias("joined"))


def ordinal_join(left: DataFrame, right: DataFrame, key: str, l_order: str, r_order: str, least: int = 2, shortest: int = 6) -> DataFrame:
    """The n-th left row of a key with the n-th right row, where both sides have as many, `least` or more."""
    def ranked(rows: DataFrame, order: str, n: str) -> DataFrame:
        w = Window.partitionBy(key)
        return rows.withColumn("__rn", F.row_number().over(w.orderBy(order))).withColumn(n, F.count("*").over(w))

    l, r = ranked(left.filter(F.length(key) >= shortest), l_order, "__nl"), ranked(right, r_order, "__nr")
    return l.join(r, [key, "__rn"]).filter((F.col("__nl") == F.col("__nr")) & (F.col("__nl") >= least)).drop("__rn", "__nl", "__nr")


def consume_in_order(left: DataFrame, right: DataFrame, key: str, l_order: str, r_order: str) -> DataFrame:
    """The n-th equal left row takes the n-th right row; beyond the last it takes the last again."""
    l = left.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(l_order)))
    r = right.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(r_order)))
    counts = right.groupBy(key).agg(F.count("*").alias("__n"))
    return l.join(counts, key).withColumn("__at", F.least("__rn", "__n")).join(r, [key, "__at"]).drop("__rn", "__n", "__at")


def bag(tokens: Column) -> Column:
    """token -> count."""
    distinct = F.array_distinct(tokens)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda t: F.size(F.filter(tokens, lambda x: x == t))))


def bag_coverage(want: Column, have: Column) -> tuple[Column, Column]:
    """Share of the wanted tokens that are there, and of the ones there that are beyond, by counts."""
    both = F.map_zip_with(want, have, lambda k, a, b: F.least(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda x, y: x + y)
    return total(both) / total(want), (total(have) - total(both)) / total(have)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of the standard library's matcher; null where a side is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def bbox_union(rows: DataFrame, keys: Sequence[str], box: str) -> DataFrame:
    valid = rows.filter(F.size(box) == 4)
    at = lambda f, k: f(F.get(F.col(box), F.lit(k)))
    return valid.groupBy(*keys).agg(at(F.min, 0).alias("x0"), at(F.min, 1).alias("y0"), at(F.max, 2).alias("x1"), at(F.max, 3).alias("y1"), F.count("*").alias("n_boxes"))


def common_tokens(left: DataFrame, right: DataFrame, l_id: str, r_id: str, tokens: str, salts: int = 16) -> DataFrame:
    """(r_id, l_id, n): how many distinct `tokens` (array) two rows share, for all pairs that share one. A small right
    side is broadcast, so counts are partly summed before any shuffle; else tokens are salted by the left row."""
    of = lambda rows, id_: rows.select(id_, F.explode(F.array_distinct(tokens)).alias("__t"))
    l, r, on = of(left, l_id), of(right, r_id), ["__t"]
    hinted = small(r, ["__t"])
    if hinted is r:
        l, hinted, on = l.withColumn("__s", F.pmod(F.xxhash64(l_id), F.lit(salts))), r.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["__t", "__s"]
    return l.join(hinted, on).groupBy(r_id, l_id).agg(F.count("*").alias("n"))


def best_common(left: DataFrame, right: DataFrame, l_id: str, r_id: str, tokens: str, *, top: int = 5, of_larger: bool = False, others_only: bool = False) -> DataFrame:
    """(r_id, l_id, score, rank): for each right row the `top` left rows by how many distinct `tokens` (array) they share, ties to the smaller l_id. `of_larger`:
    the score is that number as millionths of the larger token set, rounded half up. `others_only` leaves out equal ids. Rows that share nothing are in no ranking; null ids are left out.

    A small right side is broadcast as an index, each task counts its left rows against it and keeps `top` an item, so what is shuffled does
    not grow with the pairs that share a word. A larger one is joined by salted tokens (`common_tokens`)."""
    l, r = (rows.filter(F.col(i).isNotNull() & F.col(tokens).isNotNull()).select(F.col(i).alias(s), F.array_distinct(tokens).alias("k")) for rows, i, s in ((left, l_id, "l"), (right, r_id, "r")))
    rank = Window.partitionBy("r").orderBy(F.desc("score"), "l")
    size = r.agg(F.sum(F.aggregate("k", F.lit(0), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
    if size > BROADCAST_BYTES:
        pairs = common_tokens(l, r, "l", "r", "k").join(l.select("l", F.size("k").alias("a")), "l").join(r.select("r", F.size("k").alias("b")), "r")
        larger = F.greatest("a", "b")
        scored = pairs.select("r", "l", (F.expr("(n * 2000000 + greatest(a, b)) div (2 * greatest(a, b))") if of_larger else F.col("n")).alias("score")).filter(larger > 0)
        scored = scored.filter("r <> l") if others_only else scored
    else:
        listed = r.collect()
        items = [(x.r, len(x.k)) for x in listed]
        index: dict[str, list[int]] = {}
        for at, x in enumerate(listed):
            for t in x.k:
                index.setdefault(t, []).append(at)
        held = left.sparkSession.sparkContext.broadcast((items, index))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, index = held.value
            sizes, places = np.array([size for _, size in items], np.int64), {t: np.array(at) for t, at in index.items()}
            best: list[list[tuple]] = [[] for _ in items]
            reach = np.ones(len(items), np.int64)  # the score that a row needs to be among the best so far
            for batch in batches:
                for own, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = words.as_py()
                    shared = [places[t] for t in words if t in places]
                    if not shared:
                        continue
                    n = np.bincount(np.concatenate(shared), minlength=len(items))
                    larger = np.maximum(sizes, len(words))
                    score = (n * 2_000_000 + larger) // (2 * larger) if of_larger else n
                    for at in np.flatnonzero((n > 0) & (score >= reach)).tolist():
                        if others_only and items[at][0] == own:
                            continue
                        insort(best[at], (-int(score[at]), own))
                        if len(best[at]) >= top:
                            del best[at][top:]
                            reach[at] = max(1, -best[at][-1][0])
            found = [(items[at][0], own, -score) for at, own_best in enumerate(best) for score, own in own_best]
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), pa.array(columns[1], kinds[1]), pa.array(columns[2], pa.int64())], ["r", "l", "score"])

        kinds = [to_arrow_type(x.dataType) for x in (r.schema["r"], l.schema["l"])]
        scored = l.mapInArrow(run, f"r {r.schema['r'].dataType.simpleString()}, l {l.schema['l'].dataType.simpleString()}, score long")
    return scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select(F.col("r").alias(r_id), F.col("l").alias(l_id), "score", "rank")


def nearest(rows: DataFrame, id_: str, vector: str, top: int = 5, block: int = 1000, asked: Column | None = None) -> DataFrame:
    """(id_, other, similarity, rank): the `top` other rows of each by cosine, of each row where `asked` holds (none: of all) against all rows, in blocks
    of about `block` rows. A task holds two blocks; a block of questions gives its best of each block of rows."""
    kind, arrow = rows.schema[id_].dataType.simpleString(), to_arrow_type(rows.schema[id_].dataType)

    def blocks(own: DataFrame, names: Sequence[str]) -> DataFrame:
        n = max(1, -(-own.count() // block))
        lists = own.groupBy(F.pmod(F.xxhash64(id_), F.lit(n)).alias("__b")).agg(F.collect_list(F.struct(F.col(id_).alias("i"), F.col(vector).cast("array<double>").alias("v"))).alias("l"))
        return lists.select(F.transform("l", lambda x: x["i"]).alias(names[0]), F.flatten(F.transform("l", lambda x: x["v"])).alias(names[1])).repartition(n)

    pairs = blocks(rows, ("ids", "vectors")).crossJoin(blocks(rows if asked is None else rows.filter(asked), ("asked", "by")))

    def side(ids: pa.ListScalar, vectors: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        own = ids.values.to_numpy(zero_copy_only=False)
        m = vectors.values.to_numpy(zero_copy_only=False).reshape(len(own), -1)
        return own, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (others, b), (ids, a) = (side(batch.column(c)[k], batch.column(c + 1)[k]) for c in (0, 2))
                scores, at = np.round(a @ b.T, 6), min(top + 1, len(others))
                least = np.partition(scores, len(others) - at, axis=1)[:, len(others) - at]
                found = []
                for q, own in enumerate(ids):
                    near = np.flatnonzero((scores[q] >= least[q]) & (others != own))
                    near = near[np.lexsort((others[near], -scores[q, near]))[:top]]
                    found.append((np.full(len(near), q), near))
                q, near = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], arrow), pa.array(others[near], arrow), pa.array(scores[q, near])], [id_, "other", "similarity"])

    found = pairs.mapInArrow(run, f"{id_} {kind}, other {kind}, similarity double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("similarity"), "other"))).filter(F.col("rank") <= top)
