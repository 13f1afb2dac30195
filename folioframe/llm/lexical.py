"""Ranked lexical search: postings in a DataFrame bucketed by term, joined with the items' terms, scored in integers.

1. One pass over the texts counts terms; a row's terms that no item can have are left out at once by a bitmap of BITMAP
   places over term checksums (of fixed size; what passes it wrongly goes at the join). N, L, each term's document
   frequency and its largest score in any document follow.
2. The postings (bucket, term, row, score) are written as a table, sorted by bucket and term within each block of documents, so that a term
   that every document holds is spread over all blocks and is no hot key.
3. An item's terms are joined to them, each match gives an integer score, groupBy item and document sums, and
   row_number over each item ranks. Lists of up to LISTED rows (item, term) are broadcast, so that sums are made within each block
   before any shuffle; larger ones are joined by bucket, term and a salt of the row.

Pairs of item and document grow as their product, so step 3 goes in an order that spares most of them and loses none. Of each
item the rarest terms (up to SEED postings) name some documents; the CANDIDATES best of these are scored in full, and the
k-th of their scores is a bound that the k-th best of all reaches. An item's terms are then ordered by the most that they
can add. Those at the low end that together stay below LIGHT times the bound can't lift a document into the ranking by themselves: only documents with
another term are scored, and of these only those that could still reach the bound are scored by the light ones too. Other values of SEED, CANDIDATES or
LIGHT (up to 1) cost time, never a row.

Nulls and edges: a null or empty text has no terms and counts in neither N nor L; each row of `docs` is a document, so rows
that repeat are ranked each, and a row without doc_id is ranked after others of its score; rows that share an item_id are one item, with the terms of all;
items without id or without terms have no ranking; a score of 0 is no match; empty tables give none. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import ALNUM
from .simhash import durable, written

BITMAP, BUCKETS, LISTED, SEED, CANDIDATES, LIGHT, SALTS = 1 << 20, 256, 100_000, 1000, 50, 0.5, 16
#: A-Z to a-z, other bytes of terms as they are, all others to a space.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if ALNUM[b] else 0x20 for b in range(256))


def term_counts(frame: DataFrame, key: str, text: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """(key, n, terms, tfs) of each row: how many terms its text has, and its distinct terms that are in the bitmap, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                counts = Counter((text.as_py() or "").encode().translate(_TERMS).split())
                sizes.append(counts.total())
                for term, tf in counts.items():
                    if bitmap is None or bitmap[crc32(term) % BITMAP]:
                        terms.append(term)
                        tfs.append(tf)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["key", "n", "terms", "tfs"])

    kind = frame.schema[key].dataType.simpleString()
    return frame.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body")).mapInArrow(run, f"key {kind}, n long, terms array<string>, tfs array<long>")


def _each_term(counts: DataFrame) -> DataFrame:
    return counts.select("*", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("*", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf")).drop("t", "terms", "tfs")


def _best(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), *order))
    return scores.withColumn("rank", place).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, seed: int = SEED, candidates: int = CANDIDATES, listed: int = LISTED, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of each item."""
    wanted = _each_term(term_counts(items.filter(F.col(item_id).isNotNull()), item_id, text)).groupBy(F.col("key").alias("item"), "term").agg(F.sum("tf").alias("qf"))
    wanted = durable(wanted)
    few_lists = wanted.count() <= listed  # so are the distinct terms
    hinted = F.broadcast if few_lists else lambda side: side
    bitmap = np.zeros(BITMAP, bool)
    places = wanted.select(F.expr(f"crc32(encode(term, 'UTF-8')) % {BITMAP}").cast("int").alias("place")).distinct().toPandas()["place"]  # BITMAP numbers at most
    bitmap[places.to_numpy()] = True

    numbered = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc")).alias("key"), F.col(text).alias("body"))
    rows = written(term_counts(numbered, "key", "body", bitmap).select("key.row", "key.doc", "n", "terms", "tfs").filter("n > 0"))
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    part = F.expr(f"(1000000000L * tf) div (1000 * tf + 8 * (25 + (75 * n * {n_docs}L) div {n_terms}L))")
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1)))).cast("long")
    matches = _each_term(rows.drop("doc")).select("term", "row", part.alias("part"))
    stats = matches.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")).join(wanted.select("term").distinct(), "term", "left_semi")
    stats = durable(stats.select("term", "df", weight.alias("w"), (weight * F.col("most")).alias("most")).filter("w > 0"))
    lists = durable(wanted.join(stats, "term").select("item", "term", "qf", "df", "w", (F.col("qf") * F.col("most")).alias("most")))

    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    postings = written(matches.join(hinted(stats.select("term", "w")), "term").select(bucket, "term", "row", (F.col("w") * F.col("part")).alias("s")).sortWithinPartitions("bucket", "term", "row"))

    def matched(chosen: DataFrame) -> DataFrame:
        """(item, row, score): sums over the terms in `chosen` (item, term, qf)."""
        side, own, on = chosen.select("item", "term", "qf", bucket), postings, ["bucket", "term"]
        if not few_lists:
            own, side, on = own.withColumn("salt", F.pmod("row", F.lit(SALTS))), side.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*on, "salt"]
        return own.join(hinted(side), on).groupBy("item", "row").agg(F.sum(F.col("qf") * F.col("s")).alias("score"))

    def added(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
        """(item, row, doc, score): given pairs (item, row, score), with the terms in `chosen` (item, term, qf, w) added."""
        each = _each_term(pairs.select("item", "row", "score").join(rows, "row")).withColumn("part", part)
        more = F.coalesce(F.col("qf") * F.col("w") * F.col("part"), F.lit(0))
        return each.join(hinted(chosen.select("item", "term", "qf", "w")), ["item", "term"], "left").groupBy("item", "row").agg(F.max("doc").alias("doc"), (F.max("score") + F.sum(more)).alias("score"))

    before = F.sum("df").over(Window.partitionBy("item").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    seeds = lists.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < seed)
    first = durable(_best(matched(seeds), max(candidates, k), F.asc("row")))
    bounds = _best(added(first.withColumn("score", F.lit(0).cast("long")), lists), k, F.asc("row")).filter(F.col("rank") == k).select("item", F.col("score").alias("bound"))

    upto = F.sum("most").over(Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    split = lists.withColumn("upto", upto).join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    split = durable(split.withColumn("light", F.col("upto") < LIGHT * F.col("bound")))
    rest = split.groupBy("item").agg(F.coalesce(F.sum(F.when(F.col("light"), F.col("most"))), F.lit(0)).alias("rest"), F.max("bound").alias("bound"))
    main = durable(matched(split.filter(~F.col("light"))).join(hinted(rest), "item").filter(F.col("score") + F.col("rest") >= F.col("bound")).select("item", "row", "score"))
    total = added(main, split.filter("light"))
    return _best(total, k, F.asc_nulls_last("doc"), F.asc("row")).select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def op12_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank_documents(docs, items)
