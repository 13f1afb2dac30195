"""Joins on similarity of characters and words without comparing all pairs: exact candidate filters, then the measure itself.

The sequence ratio of texts of a and b characters is 2 M / (a + b), M the characters in matching blocks. Blocks come in the same order on
both sides, so that M is no more than the longest common subsequence, and a ratio of t or more needs M >= t (a + b) / 2. Of the a - 1
bigrams of a text each character not matched takes away two and each one put in takes away one, so at least
3 M - a - b - 1 bigrams of either side are in the other too. Three filters follow, each exact:

* count: with the bigrams of all texts in one order, the rarest first, two texts share one of their first (bigrams - least count + 1);
* position: a bigram that both texts have once is at most as far apart as characters are not matched;
* subsequence: the longest common subsequence by bits, some fifty times as fast as the ratio, which is asked for the rest only.

From t = 0.81 on the least count is one or more for all texts of two characters or more (at 0.8, ab and axb share no bigram); shorter ones must be equal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.operators.matching import small


def common_subsequence(a: str, b: str, least: int = 0) -> int:
    """The length of the longest common subsequence, a column of bits for each character of b; of one shorter than `least` any lower bound."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for start in range(0, len(b), 16):
        for c in b[start : start + 16]:
            own = row & at.get(c, 0)
            row = (row + own | row - own) & full
        if (found := len(a) - row.bit_count()) + len(b) - start - 16 < least:
            return found
    return len(a) - row.bit_count()


def least_matched(least: float, n: int) -> int:
    """The fewest matched characters of a ratio of `least` for n characters on both sides together."""
    return math.ceil(least * n / 2 - 1e-9)


def ratio_from(least: float) -> Column:
    """A pandas UDF of two texts: their sequence ratio where it is `least` or more, else null."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            r = None
            if x is not None and y is not None:
                need = least_matched(least, len(x) + len(y))
                if x == y:
                    r = 1.0
                elif min(len(x), len(y)) >= need and common_subsequence(x, y, need) >= need:
                    r = SequenceMatcher(None, x, y).ratio()
            out.append(r if r is not None and r >= least - 1e-12 else None)
        return pd.Series(out, dtype="float64")

    return ratio


def _bigrams(rows: DataFrame, id_: str, text: str, on: Sequence[str]) -> DataFrame:
    """(id, on, size, gram, nth, at): each bigram with how often it came before; `at` is its place where it comes once, else null. Shorter texts are a bigram by themselves."""
    chars = F.split(text, "")
    grams = F.when(F.length(text) < 2, F.array(F.concat(F.lit("\0"), text))).otherwise(F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda x, y: F.concat(x, y)))
    each = rows.select(id_, *on, F.length(text).alias("size"), F.posexplode(grams).alias("at", "gram"))
    counts = each.groupBy(id_, *on, "size", "gram").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return counts.select(id_, *on, "size", "gram", F.when(F.col("n") == 1, F.col("at")).alias("at"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))


def similar_pairs(left: DataFrame, right: DataFrame, l_id: str, l_text: str, r_id: str, r_text: str, *, least: float = 0.82, on: Sequence[str] = ()) -> DataFrame:
    """(on, l_id, r_id): the pairs within equal `on` that the count and position filters leave, each once. Null texts and null ids have none."""
    if not 0.81 <= least <= 1:
        raise ValueError("the count filter is exact from 0.81 on")
    l, r = (_bigrams(rows.filter(F.col(i).isNotNull() & F.col(t).isNotNull()).select(F.col(i).alias(f"__{s}"), *on, F.col(t).alias("__text")), f"__{s}", "__text", on) for rows, i, t, s in ((left, l_id, l_text, "l"), (right, r_id, r_text, "r")))
    # Sizes of a partner go from size * least / (2 - least); the count is smallest for the smallest.
    smallest = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * (F.col("size") + F.col("size") * (least / (2 - least))) - 1 - 1e-9))
    grams = F.greatest(F.lit(1), F.col("size") - 1)
    frequency = l.select("gram", "nth").unionAll(r.select("gram", "nth")).groupBy("gram", "nth").agg(F.count("*").alias("df"))

    def first(rows: DataFrame, id_: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*on, id_).orderBy("df", "gram", "nth"))
        return rows.join(frequency, ["gram", "nth"]).withColumn("place", place).filter(F.col("place") <= grams - smallest + 1)

    a = first(l, "__l").select(*on, "gram", "nth", "__l", F.col("size").alias("a"), F.col("at").alias("i"))
    b = first(r, "__r").select(*on, "gram", "nth", "__r", F.col("size").alias("b"), F.col("at").alias("j"))
    pairs = a.join(small(b, ["gram", "__r"]), [*on, "gram", "nth"])
    matched = F.ceil(least * (F.col("a") + F.col("b")) / 2 - 1e-9)
    near = (F.col("i") - F.col("j")).between(matched - F.col("b"), F.col("a") - matched) | F.col("i").isNull() | F.col("j").isNull()
    return pairs.filter((F.least("a", "b") >= matched) & near).select(*on, F.col("__l").alias(l_id), F.col("__r").alias(r_id)).distinct()


def edit_similar(left: DataFrame, right: DataFrame, l_id: str, l_text: str, r_id: str, r_text: str, *, least: float = 0.82, on: Sequence[str] = ()) -> DataFrame:
    """(on, l_id, r_id, ratio): all pairs within equal `on` with a sequence ratio of `least` or more, rounded to six places; ids are unique on their side."""
    pairs = similar_pairs(left, right, l_id, l_text, r_id, r_text, least=least, on=on)
    texts = pairs.join(left.select(l_id, F.col(l_text).alias("__a")), l_id).join(right.select(r_id, F.col(r_text).alias("__b")), r_id)
    return texts.withColumn("ratio", F.round(ratio_from(least)("__a", "__b"), 6)).filter("ratio is not null").select(*on, l_id, r_id, "ratio")


def overlapping(left: DataFrame, right: DataFrame, l_id: str, r_id: str, tokens: str, *, least: float, on: Sequence[str] = ()) -> DataFrame:
    """(on, l_id, r_id, overlap): pairs within equal `on` where the right side has a share of `least` or more of the left's distinct `tokens` (array).

    Of n tokens n - ceil(least n) may be missing, so one of the rarest n - ceil(least n) + 1 is there: only these are joined, then whole arrays are compared."""
    l, r = (rows.filter(F.size(tokens) > 0).select(F.col(i).alias(f"__{s}"), *on, F.array_distinct(tokens).alias("__k")) for rows, i, s in ((left, l_id, "l"), (right, r_id, "r")))
    each = lambda rows, s: rows.select(*on, f"__{s}", F.explode("__k").alias("__t"))
    frequency = each(r, "r").groupBy("__t").agg(F.count("*").alias("__df"))
    place = F.row_number().over(Window.partitionBy(*on, "__l").orderBy(F.coalesce("__df", F.lit(0)), "__t"))
    size = l.select(*on, "__l", F.size("__k").alias("__n"))
    first = each(l, "l").join(frequency, "__t", "left").withColumn("__p", place).join(size, [*on, "__l"]).filter(F.col("__p") <= F.col("__n") - F.ceil(least * F.col("__n") - 1e-9) + 1)
    pairs = each(r, "r").join(small(first.select(*on, "__l", "__t"), ["__t", "__l"]), [*on, "__t"]).select(*on, "__l", "__r").distinct()
    both = pairs.join(l.withColumnRenamed("__k", "__a"), [*on, "__l"]).join(r.withColumnRenamed("__k", "__b"), [*on, "__r"])
    both = both.withColumn("__n", F.size(F.array_intersect("__a", "__b"))).filter(F.col("__n") >= F.ceil(least * F.size("__a") - 1e-9))
    return both.select(*on, F.col("__l").alias(l_id), F.col("__r").alias(r_id), F.round(F.col("__n") / F.size("__a"), 6).alias("overlap"))
