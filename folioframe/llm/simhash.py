"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, verified Hamming distance.

Fingerprints within `distance` bits agree on at least `parts - distance` of `parts` bit blocks. So
each distinct fingerprint is sent once for every choice of that many blocks, keyed by the bits in
them; within a key a breadth-first walk over the fingerprints not yet reached verifies Hamming
distances and links every fingerprint to the smallest of its group there (never all pairs). Links
meet in connected components by alternating large and small stars, with a checkpoint each round.

A key that more than `largest` distinct fingerprints share is keyed anew by blocks of the bits the
key leaves open, which loses no link, until its groups are small.

Nulls and edges: a null, empty or blank text has fingerprint zero and links like any other; a row without doc_id links
like any other and gets the smallest doc_id of its component, null where no row of it has one; rows that repeat are
returned as often; an empty table gives none. Other columns are never read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import LOWER, SPACE, U, pieces, text_buffer, word_spans

_IN_WORD = ~SPACE
SHARE = 1000
#: _LANES[k][b]: bits 4k to 4k + 3 of byte b, each in a lane of 16 bits.
_LANES = [np.array([sum(((b >> (4 * k + i)) & 1) << (16 * i) for i in range(4)) for b in range(256)], np.uint64) for k in range(2)]


def _count_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each range of hashes that begins at `starts` (up to 65535 of them), how many have each bit: (ranges, 64)."""
    raw = hashes.view(np.uint8).reshape(-1, 8)
    out = np.empty((len(starts), 16), np.uint64)
    for byte in range(8):
        for k in range(2):
            out[:, 2 * byte + k] = np.add.reduceat(_LANES[k][raw[:, byte]], starts)
    return out.view(np.uint16).reshape(len(starts), 64).astype(np.int64)


def fingerprints(column: pa.Array, width: int, seed: int) -> np.ndarray:
    """The 64-bit SimHash of every text, over its shingles of `width` words, repeats included."""
    data, offsets = text_buffer(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for low, high in pieces(offsets):
        raw = LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, doc_words = word_spans(raw, offsets[low : high + 1] - offsets[low], _IN_WORD)
        if not len(starts):
            continue
        # All words with one space between, so that a shingle is a slice.
        gap = np.arange(len(starts))
        size = ends - starts
        begin = np.cumsum(size) - size + gap
        joined = np.full(int(size.sum()) + len(starts), 0x20, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(begin, size) + within] = raw[np.repeat(starts, size) + within]
        text, end = joined.tobytes(), begin + size
        count = np.diff(doc_words)
        shingles = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
        own = np.repeat(doc_words[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
        last = np.minimum(own + width - 1, np.repeat(doc_words[1:] - 1, shingles))
        hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(begin[own].tolist(), end[last].tolist(), strict=True)), np.uint64, len(own))
        docs = np.flatnonzero(shingles)
        at = (np.cumsum(shingles) - shingles)[docs]
        sizes = shingles[docs]
        cuts = [np.arange(a, a + n, 65535) for a, n in zip(at[sizes > 65535], sizes[sizes > 65535], strict=True)]
        pieces_at = np.unique(np.concatenate([at, *cuts]))
        bits = np.add.reduceat(_count_bits(hashes, pieces_at), np.searchsorted(pieces_at, at), axis=0)
        set_ = (2 * bits > sizes[:, None]).astype(np.uint8)
        out[low + docs] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_column(docs: DataFrame, *, width: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), width, seed).view(np.int64))], ["doc", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body")).mapInArrow(run, "doc long, fp long")


def bit_blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` blocks of neighbouring positions out of `bits`."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def choose_masks(bits: list[int], parts: int, distance: int) -> list[int]:
    """Masks of which two values that differ in `distance` of `bits` at most share one."""
    return [reduce(int.__or__, c) for c in combinations(bit_blocks(bits, parts), parts - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keyed(masks: list[int], fp: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks]))


def _group_links(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """(member, smallest) for each set of distinct values that are linked by steps of `distance` bits."""
    left = np.sort(values)
    while len(left) > 1:
        root, left, frontier = left[0], left[1:], [left[0]]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= distance
            if near.any():
                reached = left[near]
                yield from ((x, root) for x in reached)
                frontier.extend(reached)
                left = left[~near]


def _links(distance: int):
    """Links within each key; the partition comes sorted by key, and a key may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            new = np.ones(len(fp) + 1, bool)
            new[1:-1] = (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])
            edges = np.flatnonzero(new)
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = np.bitwise_count(a ^ b) <= distance
            members, roots = [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
            for k in np.flatnonzero(size > 2):
                found = list(_group_links(fp[edges[k] : edges[k + 1]].view(np.uint64), distance))
                if found:
                    members.append(np.array([x for x, _ in found], np.uint64))
                    roots.append(np.array([x for _, x in found], np.uint64))
            left, right = np.concatenate(members), np.concatenate(roots)
            if not len(left):
                return None
            pair = np.unique(np.stack([left, right], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], ["a", "b"])

        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            columns = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(columns[0]):
                continue
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut and (out := emit(*[np.ascontiguousarray(c[:cut]) for c in columns])):
                yield out
            held = [c[cut:] for c in columns]
        if len(held[0]) and (out := emit(*[np.ascontiguousarray(c) for c in held])):
            yield out

    return run


def _finer(distance: int):
    """Keys anew for the members of keys that are too large: their values agree on the key's bits and differ in
    `distance` of the others at most, so of distance + 1 blocks of the others they share one."""

    def masks_of(mask: int) -> list[int]:
        open_ = [b for b in range(64) if not (mask >> b) & 1]
        return [mask | x for x in bit_blocks(open_, distance + 1)] if len(open_) > distance else [2**64 - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, fp = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            for m in np.unique(mask):
                own = fp[mask == m]
                for finer in masks_of(int(m)):
                    full = np.full(len(own), finer, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (full, own & full, own)], ["mask", "bits", "fp"])

    return run


def near_pairs(fps: DataFrame, *, distance: int = 4, parts: int = 7, largest: int = 100_000) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that differ in `distance` bits at
    most, enough of them to connect all that are connected; a is linked to a smaller b, as unsigned."""
    n, largest = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(largest, 1 << distance)  # smaller groups can't always be split without loss
    keyed = fps.select(_keyed(choose_masks(list(range(64)), parts, distance), F.col("fp")).alias("k"), "fp").select("k.mask", "k.bits", "fp")
    found = None
    while True:
        hot = durable(keyed.groupBy("mask", "bits").count().filter(F.col("count") > largest).select("mask", "bits"))
        some = not hot.isEmpty()
        cold = keyed.join(hot, ["mask", "bits"], "left_anti") if some else keyed
        links = cold.repartition(n, "mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(_links(distance), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if not some:
            return found
        members = keyed.join(hot, ["mask", "bits"], "left_semi").select("mask", "fp")
        keyed = durable(members.mapInArrow(_finer(distance), "mask long, bits long, fp long").distinct())


def durable(frame: DataFrame) -> DataFrame:
    """The frame, written to the folder that all executors share: the one named by spark.checkpoint.dir. Only a
    local master, whose executor is the driver, may do without one."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(shared)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the folder where checkpoints lie, compressed and read column by column."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        durable(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of `edges` (a, b: long) the smallest node reachable.

    Alternating large-star and small-star rounds; the sum over all edges no longer changes when done."""
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = durable(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def near_duplicates(docs: DataFrame, *, width: int = 4, seed: int = 42, distance: int = 4, parts: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of `docs`; component_id is the smallest
    doc_id reachable over links of `distance` bits."""
    rows = durable(fingerprint_column(docs, width=width, seed=seed, doc_id=doc_id, text=text))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc").alias("least"), F.count("*").alias("n")))
    found = components(near_pairs(distinct.select("fp"), distance=distance, parts=parts))
    grouped = distinct.join(found, distinct.fp == found.node, "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("group"))
    names = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = durable(grouped.join(names, "group").select("fp", "n", "component_id"))
    # A fingerprint with more than one row in SHARE is hot: there are fewer than SHARE of them, and their rows stay where they are.
    total = rows.count()
    hot, cold = (named.filter(c).select("fp", "component_id") for c in (F.col("n") * SHARE > total, F.col("n") * SHARE <= total))
    out = rows.join(F.broadcast(hot), "fp").unionByName(rows.join(F.broadcast(hot), "fp", "left_anti").join(cold, "fp"))
    return out.select(F.col("doc").alias(doc_id), "fp", "component_id")


def op9_rows(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
