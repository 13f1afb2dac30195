"""Spelling variant grouping: a trie self-join with active-node sets over a vocabulary dealt by prefix.

Words within one edit of each other are found by walking the trie of all words from the root down and keeping, for each
node u, the nodes v whose strings are at distance 0 or 1 from u's (its active nodes): (u, u) at 0 and those at 1.

1. `word_counts`: the words of the texts, counted in each batch and then by Spark.
2. The top of the trie is walked over the whole vocabulary, level by level, as a join: below a node P at level p an edit at
   that very place leads to active nodes at distance 1 (Pc and Pd, or Pc and P), from where only equal characters go on.
   So terminals meet in a join on (P, what follows). The active pair (P, P) at distance 0 goes down one level to (Pc, Pc).
3. From level TOP on each prefix is a partition, as soon as at most `largest` words have it; prefixes with more of them go on as in 2.
4. In a partition `trie_pairs` propagates active pairs down its words' trie, level by level for all its prefixes at once in numpy. Pairs
   (u, u) with a single word below are dropped, for they can meet nothing, so that depth ends where words part.

A near pair differs in exactly one code point inserted, deleted or replaced. A word has at most some thousands of near words, whatever the vocabulary's size.

`group_variants` then takes for each word the near word that is most frequent and at least RATIO times as frequent as it, and follows
these forms to the last by pointer doubling (each step multiplies the count, so chains are short and have no ring).

Nulls and edges: a null or empty text has no words; a null doc_id is written as nothing before the colon; rows that repeat
count as often; words of any length are whole; an empty table has no words. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import byte_set
from .simhash import durable

SHORTEST, LEAST, RATIO, DAMAGE = 7, 2, 10, 31
TOP, LARGEST = 3, 100_000
#: In Latin-1 a letter is one byte: A-Z to a-z, other letters as they are, all other bytes to a space.
_LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF))
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _LETTERS[b] else 0x20 for b in range(256))


def words_of(doc_id: int | None, text: str, damage: int = DAMAGE) -> Iterator[tuple[bytes, int]]:
    """(word, how often), in Latin-1: the letter runs of a text, those whose checksum with the id `damage` divides without one letter."""
    head = b"" if doc_id is None else b"%d" % doc_id
    for run, n in Counter(text.encode("latin-1", "replace").translate(_WORDS).split()).items():
        if len(run) >= SHORTEST:
            h = crc32(b"%s:%s" % (head, run if run.isascii() else run.decode("latin-1").encode()))
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < SHORTEST:
                    continue
            yield run, n


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n): words of SHORTEST code points or more that occur `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc, text.as_py() or ""):
                    counts[word] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    found = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _children(level: int, node: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes one level below, from sorted words that each lie below `node` (-1: none): each word's child (or -1), and of the children parent, code point, words below, and a word that ends there (or -1)."""
    longer = np.flatnonzero((node >= 0) & (size > level))
    letter = flat[start[longer] + level]
    new = np.ones(len(longer), bool)
    new[1:] = (node[longer][1:] != node[longer][:-1]) | (letter[1:] != letter[:-1])
    own = np.cumsum(new) - 1
    child = np.full(len(node), -1)
    child[longer] = own
    first = np.flatnonzero(new)
    ends = np.full(len(first), -1)
    done = size[longer] == level + 1
    ends[own[done]] = longer[done]
    return child, node[longer][first], letter[first].astype(np.int64), np.bincount(own, minlength=len(first)), ends


def trie_pairs(words: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), both ways, of near words among sorted distinct `words` that share their first `level` code points.

    Active pairs are of two kinds: (u, u) at distance 0, and (u, v) at distance 1 with v at the level of u or one above it; the
    pairs with v below u are their mirror images. Words of several prefixes may come together: each first part is a root."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    roots = [w[:level] for w in words]
    node = np.cumsum([False, *(a != b for a, b in zip(roots, roots[1:], strict=False))])
    n_roots = int(node[-1]) + 1 if len(words) else 0
    below = np.bincount(node, minlength=n_roots)
    ends = np.full(n_roots, -1)
    whole = size == level
    ends[node[whole]] = np.flatnonzero(whole)
    same = np.flatnonzero(below > 1)  # u of (u, u)
    level_u, level_v = np.zeros(0, np.int64), np.zeros(0, np.int64)  # distance 1, same level
    upper_u, upper_v = np.zeros(0, np.int64), np.zeros(0, np.int64)  # distance 1, v one level above u
    old = None  # the children of the level above, for those v
    found_a, found_b = [], []

    def pairs_below(u: np.ndarray, v: np.ndarray, of_u: tuple, of_v: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Children of u and of v by the same code point."""
        parent_u, letter_u = of_u
        parent_v, letter_v = of_v
        low, high = np.searchsorted(parent_u, u), np.searchsorted(parent_u, u, "right")
        pair = np.repeat(np.arange(len(u)), high - low)
        child = np.arange(len(pair)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        key = (parent_v << 32) + letter_v
        asked = (v[pair] << 32) + letter_u[child]
        at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
        good = key[at] == asked if len(key) else np.zeros(len(asked), bool)
        return child[good], at[good]

    while len(same) or len(level_u) or len(upper_u):
        child, parent, letter, n_below, child_ends = _children(level, node, flat, start, size)
        kids = (parent, letter)
        # Distance 1 stays so by equal code points only.
        next_level = pairs_below(level_u, level_v, kids, kids)
        next_upper = pairs_below(upper_u, upper_v, kids, old) if old else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # From (u, u): children of u by other code points (replaced), and a child against u itself (inserted).
        low, high = np.searchsorted(parent, same), np.searchsorted(parent, same, "right")
        count = high - low
        own = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        fan = np.repeat(count, count)
        left = np.repeat(own, fan)
        right = np.repeat(np.repeat(low, count), fan) + np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan)
        other = left < right
        next_level = (np.concatenate([next_level[0], left[other]]), np.concatenate([next_level[1], right[other]]))
        next_upper = (np.concatenate([next_upper[0], own]), np.concatenate([next_upper[1], np.repeat(same, count)]))
        for (u, v), ends_v in ((next_level, child_ends), (next_upper, ends)):
            both = (child_ends[u] >= 0) & (ends_v[v] >= 0)
            found_a.append(child_ends[u][both])
            found_b.append(ends_v[v][both])
        # One pair may be reached by several edits (as in aab and ab).
        (level_u, level_v), (upper_u, upper_v) = (np.unique(np.stack(p, 1), axis=0).T for p in (next_level, next_upper))
        same = own[n_below[own] > 1]
        node, old, ends, level = child, kids, child_ends, level + 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    pair = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def _in_partitions(level: int):
    """Pairs within each prefix; the partition comes sorted by word, and a prefix may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(words: list[str]) -> pa.RecordBatch:
            a, b = trie_pairs(words, level)
            column = pa.array(words, pa.string())
            return pa.RecordBatch.from_arrays([column.take(pa.array(x, pa.int64())) for x in (a, b)], ["word", "near"])

        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            last = next((k for k in range(len(held) - 1, 0, -1) if held[k][:level] != held[k - 1][:level]), 0)
            if last:
                yield emit(held[:last])
                held = held[last:]
        if held:
            yield emit(held)

    return run


def near_words(words: DataFrame, *, top: int = TOP, largest: int = LARGEST) -> DataFrame:
    """(word, near), both ways: the pairs of distinct words (column word) that differ in exactly one code point."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, level, found = words.select("word"), 0, None
    while True:
        prefix = F.substring("word", 1, level)
        if level >= top:
            hot = durable(left.groupBy(prefix.alias("prefix")).count().filter(F.col("count") > largest).select("prefix"))
            some = not hot.isEmpty()
            keyed = left.withColumn("prefix", prefix)
            cold = keyed.join(hot, "prefix", "left_anti") if some else keyed
            pairs = cold.repartition(parts, "prefix").sortWithinPartitions("word").select("word").mapInArrow(_in_partitions(level), "word string, near string")
            found = pairs if found is None else found.unionByName(pairs)
            if not some:
                return found.distinct()
            left = durable(keyed.join(hot, "prefix", "left_semi").select("word"))
        # An edit at this place: P c s against P d s (both without their letter here) and against P s.
        cut = F.concat(prefix, F.lit("\0"), F.expr(f"substring(word, {level + 2})"))
        whole = F.concat(prefix, F.lit("\0"), F.expr(f"substring(word, {level + 1})"))
        without = left.filter(F.length("word") > level).select("word", cut.alias("rest"))
        as_is = left.select(F.col("word").alias("near"), whole.alias("rest"))
        replaced = without.join(without.withColumnRenamed("word", "near"), "rest").filter("word <> near").select("word", "near")
        inserted = without.join(as_is, "rest").filter("word <> near").select(F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).alias("p")).select("p.*")
        pairs = replaced.unionByName(inserted)
        found = pairs if found is None else found.unionByName(pairs)
        level += 1
        if level > top:
            left = left.filter(F.length("word") >= level)


def group_variants(words: DataFrame, *, ratio: int = RATIO, top: int = TOP, largest: int = LARGEST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of the distinct `words` (word, n)."""
    words = durable(words.select("word", "n"))
    pairs = near_words(words, top=top, largest=largest)
    best = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("form_n")), "near")
    best = best.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("near").alias("form"), "form_n")).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.form_n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    told = durable(told.select("word", "n", "n_near", F.col("best.form").alias("form"), F.col("best.form_n").alias("form_n")))
    steps = durable(told.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = durable(further)
        steps = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return told.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_rows(docs: DataFrame) -> DataFrame:
    return group_variants(word_counts(docs))
