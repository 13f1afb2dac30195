"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

1. Documents are dealt to chunks of about CHUNK_BYTES of text by a hash of doc_id (rows without one, and those of an
   id that very many rows share, by a hash of their text). Each chunk hashes all its windows with two
   rolling hashes and sends every distinct hash once, with the smallest doc_id that has it there, to
   the bucket of its leading bits. So a window that a third of all rows hold reaches a bucket once
   for each chunk, not once for each row.
2. A bucket sorts what it got, finds for each hash the smallest doc_id of all, and answers each
   chunk with one bit for each hash it sent: whether an earlier document has it.
3. Each chunk hashes its windows again, reads the bits, and merges the repeated windows (all but the
   first occurrence) into maximal removal intervals.

The text is shuffled once (both passes read the same exchange), the hashes once, the bits are small. The number of chunks and
buckets follows from the bytes of the texts, so that neither grows with the input.
Hashes have 80 bits: among n distinct windows about n**2 / 2**81 pairs match wrongly (at 100 TB, some hundred).

Nulls and edges: a null or empty text has no words and keeps nothing (kept text ""); texts shorter
than a window lose nothing; a null doc_id sorts after all others; rows that share a doc_id count as
one after the other in the order of their texts, so that the first keeps its words (rows without doc_id, and those of an id
with more than HOT rows and one in SHARE of all, in the order of a hash of their texts); an empty table gives none. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import SPACE, U, mix, pieces, text_buffer, window_hashes, word_hashes, word_spans
from .simhash import durable

_LAST = np.iinfo(np.int64).max
#: Text of one chunk in a large table, in bytes; smaller tables have smaller ones, down to a quarter, to use all partitions. An id is hot, and its rows are spread over chunks, beyond HOT rows and one in SHARE of all.
CHUNK_BYTES, HOT, SHARE = 16 << 20, 10_000, 1000
#: The second hash of a window, of 16 bits, comes from its words' hashes mixed with this value.
_SECOND = U(0x8EBC6AF09C88C6E3)
_IN_WORD = ~SPACE


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the leading ones hardly change and compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _from_planes(blob: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


class Chunk:
    """All windows of some documents, in the order of (doc_id, sub, text); sub is a hash of the text where rows of one id are spread."""

    def __init__(self, table: pa.Table, width: int) -> None:
        order = pc.sort_indices(table, sort_keys=[("doc", "ascending"), ("sub", "ascending"), ("body", "ascending")])
        self.table = table.take(order)
        self.ids = np.stack([pc.fill_null(self.table["doc"], _LAST).to_numpy(), self.table["sub"].to_numpy()], 1)
        data, offsets = text_buffer(self.table["body"])
        hashes, seconds, docs, firsts, self.n_words = [], [], [], [], np.zeros(len(self.ids), np.int64)
        for low, high in pieces(offsets):
            raw = data[offsets[low] : offsets[high]]
            starts, ends, doc_words = word_spans(raw, offsets[low : high + 1] - offsets[low], _IN_WORD)
            count = np.diff(doc_words)
            self.n_words[low:high] = count
            words = word_hashes(raw, starts, ends)
            window = window_hashes(words, width)
            doc = np.repeat(np.arange(low, high), count)
            whole = np.flatnonzero(doc[: len(window)] == doc[width - 1 :]) if len(window) else np.zeros(0, np.int64)
            hashes.append(window[whole])
            seconds.append((window_hashes(mix(words ^ _SECOND), width)[whole] >> U(48)).astype(np.uint16))
            docs.append(doc[whole].astype(np.int32))
            firsts.append((whole - doc_words[doc[whole] - low]).astype(np.int32))
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash, second, self.doc, self.start = joined(hashes, np.uint64), joined(seconds, np.uint16), joined(docs, np.int32), joined(firsts, np.int32)
        self.by_hash, self.new = _by_hash(self.hash, second)
        first = self.by_hash[self.new]
        self.distinct, self.second = self.hash[first], second[first]

    def bounds(self, buckets: int) -> np.ndarray:
        """Where the distinct hashes of each bucket begin, and the end: bucket b has the b-th of equal ranges of hashes."""
        edges = np.array([-((-b << 64) // buckets) for b in range(1, buckets)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.distinct, edges), [len(self.distinct)]])


def _by_hash(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both hashes (equal ones as they come), and where in it a new pair begins."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # rare: equal first hashes of different windows
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _send(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, width)
        number, at = table["chunk"][0].as_py(), chunk.bounds(buckets)
        owner = chunk.doc[chunk.by_hash[chunk.new]]
        own_buckets = np.flatnonzero(np.diff(at))
        spread = bool(chunk.ids[:, 1].any())
        hashes, seconds, ranks, ids = [], [], [], []
        for b in own_buckets:
            part = slice(at[b], at[b + 1])
            used, rank = np.unique(owner[part], return_inverse=True)
            hashes.append(_planes(chunk.distinct[part]))
            seconds.append(chunk.second[part].tobytes())
            ranks.append(_planes(rank.astype(np.uint32)))
            ids.append((chunk.ids if spread else chunk.ids[:, :1])[used].tobytes())
        columns = {"hashes": hashes, "seconds": seconds, "ranks": ranks, "ids": ids}
        return pa.table({"bucket": pa.array(own_buckets, pa.int64()), "chunk": pa.array([number] * len(own_buckets), pa.int64()), "wide": pa.array([spread] * len(own_buckets), pa.bool_())} | {c: pa.array(x, pa.binary()) for c, x in columns.items()})

    return run


_SENT = "bucket long, chunk long, wide boolean, hashes binary, seconds binary, ranks binary, ids binary"


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk in a bucket, the bits of the hashes that an earlier document (by doc_id, sub) has elsewhere."""
    hashes = [_from_planes(x.as_py(), np.uint64) for x in table["hashes"]]
    owners = []
    for wide, blob, rank in zip(table["wide"].to_pylist(), table["ids"], table["ranks"], strict=True):
        ids = np.frombuffer(blob.as_py(), np.int64).reshape(-1, 2 if wide else 1)
        owners.append(np.column_stack([ids, np.zeros((len(ids), 2 - ids.shape[1]), np.int64)])[_from_planes(rank.as_py(), np.uint32)])
    owner = np.concatenate(owners)
    order, new = _by_hash(np.concatenate(hashes), np.frombuffer(b"".join(x.as_py() for x in table["seconds"]), np.uint16))
    group = np.cumsum(new) - 1
    doc, sub = owner[order, 0], owner[order, 1]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[group]
    least_sub = np.minimum.reduceat(np.where(doc == least, sub, _LAST), np.flatnonzero(new))[group]
    later = np.empty(len(order), bool)
    later[order] = (doc > least) | (sub > least_sub)
    chunks, bits, at = [], [], 0
    for chunk, own in zip(table["chunk"].to_pylist(), hashes, strict=True):
        if (flags := later[at : at + len(own)]).any():
            chunks.append(chunk)
            bits.append(np.packbits(flags).tobytes())
        at += len(own)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(chunks), pa.int64()), "bits": pa.array(bits, pa.binary())})


def _remove(width: int, buckets: int, with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, width)
        at, later = chunk.bounds(buckets), np.zeros(len(chunk.distinct), bool)
        for b, packed in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            later[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(at[b + 1] - at[b]))
        repeated = np.empty(len(chunk.hash), bool)
        repeated[chunk.by_hash] = ~chunk.new | later[np.cumsum(chunk.new) - 1]
        doc_at = np.concatenate([[0], np.cumsum(chunk.n_words)])
        first = doc_at[chunk.doc[repeated]] + chunk.start[repeated]
        delta = np.zeros(int(doc_at[-1]) + 1, np.int64)
        np.add.at(delta, first, 1)
        np.add.at(delta, first + width, -1)
        gone = np.cumsum(delta[:-1]) > 0
        n_removed, digests, texts, spans = [], [], [], []
        for d, text in enumerate(chunk.table["body"]):
            own = gone[doc_at[d] : doc_at[d + 1]]
            words = (text.as_py() or "").encode().split()
            n = int(own.sum())
            kept = b" ".join(compress(words, (~own).tolist()) if n else words)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))) if n else np.zeros(0, np.int64)
            n_removed.append(n)
            digests.append(hashlib.sha256(kept).hexdigest())
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            if with_text:
                texts.append(kept.decode())
        out = {"doc": chunk.table["doc"], "n_words": pa.array(chunk.n_words), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        return pa.table(out | ({"kept": pa.array(texts, pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, *, width: int = 20, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept]): words that lie in no repeated window.

    A first pass over the table counts bytes, and rows of each id, to deal by."""
    spark = docs.sparkSession
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body"))
    sizes = durable(dealt.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes")))
    rows, size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    spread = [r.doc for r in sizes.filter((F.col("n") > hot) & (F.col("n") * SHARE > rows) & F.col("doc").isNotNull()).collect()]  # fewer than SHARE
    wanted, most, least = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-4 * size // chunk_bytes)), -(-size // chunk_bytes)
    chunks, buckets, partitions = max(least, min(4 * wanted, most)), max(least, min(wanted, most)), max(wanted, -(-least // 4))
    is_spread = F.isnull("doc") | (F.col("doc").isin(spread) if spread else F.lit(False))
    dealt = dealt.withColumn("sub", F.when(is_spread, F.coalesce(F.xxhash64("body"), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc", "sub"), F.lit(chunks))).repartition(partitions, "chunk")
    sent = dealt.groupBy("chunk").applyInArrow(_send(width, buckets), _SENT).repartition(partitions, "bucket")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, bits binary")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept string" * with_text
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(width, buckets, with_text), schema)
    return out.withColumnRenamed("doc", doc_id)


def op2_rows(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
