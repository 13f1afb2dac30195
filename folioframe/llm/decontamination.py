"""Benchmark decontamination by an FM-index of each shard of training text.

A shard is one Arrow batch of documents. Words outside the benchmark can't be part of a match, so a
shard keeps only the runs of words in which every neighbouring pair also occurs in the benchmark
(a superset, by hash) and that are as long as the shortest test phrase. These runs, as numbers of
benchmark words, form the indexed text: the index is one of what may match, not of the whole shard. Test phrases are searched backwards, occurrences are
located by sampled suffix positions, and the spans merge into the words to remove.

Nulls and edges: a null or empty text, or one without words, has no words and no hits; a benchmark
item that is null or has no words is left out; an empty benchmark leaves every document clean;
repeated documents give repeated rows; a null doc_id stays null. Columns of `docs` other than the
named ones are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .rows import ALNUM, LOWER, U, fresh, mix, pieces, ragged, text_buffer, word_hashes, word_spans
from .simhash import durable

#: Bytes of benchmark text that one pass over the documents takes along (about 30 times that in memory); a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20


def split_words(text: str | None) -> list[bytes]:
    """Lower-case words of one text, as the vectorised reader sees them."""
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(starts, ends, strict=True)]


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * U(3) + hashes[1:])


class Phrases:
    """The test phrases of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        words = [(i, w) for i, text in items if i is not None and (w := split_words(text))]
        self.numbers: dict[bytes, int] = {}
        for _, own in words:
            for w in own:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.items = sorted({item for item, _ in words})
        places = {item: k for k, item in enumerate(self.items)}
        ids = [np.array([self.numbers[w] for w in own], np.int32) for _, own in words]
        of = np.array([places[item] for item, _ in words], np.int32)
        sizes = np.array([min(width, len(x)) for x in ids], np.int64)
        #: For each size the distinct phrases, and (CSR) the places in `items` of those that have them.
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            phrases, number = np.unique(np.concatenate([sliding_window_view(ids[k], size) for k in own]), axis=0, return_inverse=True)
            owner = np.repeat(of[own], [len(ids[k]) - size + 1 for k in own])
            pair = np.unique(np.stack([number.ravel(), owner], 1), axis=0)
            self.by_size[size] = phrases, np.searchsorted(pair[:, 0], np.arange(len(phrases) + 1)), pair[:, 1]
        self.shortest = min(self.by_size, default=0)
        joined, at = b" ".join(self.numbers), np.cumsum([0, *(len(w) + 1 for w in self.numbers)])
        raw = np.frombuffer(joined, np.uint8)
        single = word_hashes(raw, at[:-1], at[1:] - 1)
        pairs = [np.zeros(0, np.uint64)]
        for _, own in words:
            pairs.append(_pairs(single[[self.numbers[w] - 1 for w in own]]))
        self.words_seen, self.pairs_seen = self._bitmap(single), self._bitmap(np.concatenate(pairs))

    @staticmethod
    def _bitmap(hashes: np.ndarray) -> np.ndarray:
        """2**n flags, a sixteenth of them set at most, by the top bits of the hashes."""
        bits = max(12, int(len(hashes)).bit_length() + 4)
        flags = np.zeros(1 << bits, bool)
        flags[(hashes >> U(64 - bits)).astype(np.int64)] = True
        return flags

    @staticmethod
    def _has(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return flags[(hashes >> U(64 - (len(flags).bit_length() - 1))).astype(np.int64)]

    def runs(self, hashes: np.ndarray, doc_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the runs of words that may hold a phrase."""
        n = len(hashes)
        if not n or not self.shortest:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.shortest == 1:
            known = self._has(self.words_seen, hashes)
        else:
            known = np.ones(n, bool)
        tied = np.zeros(n, bool)  # tied[i]: word i goes on from word i - 1
        tied[1:] = self._has(self.pairs_seen, _pairs(hashes))
        tied[doc_words[:-1][doc_words[:-1] < n]] = False
        starts = np.flatnonzero(~tied)
        lengths = np.diff(np.append(starts, n))
        fit = (lengths >= self.shortest) & ((lengths > 1) | known[starts])
        return starts[fit], lengths[fit]


def find_hits(phrases: Phrases, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Over a shard: number of words of each text, the merged spans (text, first word, words beyond,
    in words of the text), and (text, item) pairs; also the byte spans of the merged spans."""
    n_docs = len(offsets) - 1
    n_words = np.zeros(n_docs, np.int64)
    symbols, sources, docs_of, byte_from, byte_to, words_before = [], [], [], [], [], []
    for low, high in pieces(offsets):
        at = offsets[low : high + 1] - offsets[low]
        raw = LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, doc_words = word_spans(raw, at, ALNUM)
        n_words[low:high] = np.diff(doc_words)
        first, lengths = phrases.runs(word_hashes(raw, starts, ends), doc_words)
        if not len(first):
            continue
        kept = ragged(first, lengths)
        whole, get = raw.tobytes(), phrases.numbers.get
        ids = np.fromiter((get(whole[a:b], 0) for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)), np.int64, len(kept))
        close = np.cumsum(lengths)
        doc = np.searchsorted(doc_words, kept, "right") - 1
        symbols.append(np.insert(ids, close, 0))
        sources.append(np.insert(kept - doc_words[doc], close, -1))
        docs_of.append(np.insert(doc + low, close, -1))
        byte_from.append(np.insert(starts[kept] + offsets[low], close, -1))
        byte_to.append(np.insert(ends[kept] + offsets[low], close, -1))
    none = np.zeros(0, np.int64)
    if not symbols:
        return n_words, none, none, none, np.zeros((0, 2), np.int64), []
    text, word, doc, b_from, b_to = (np.concatenate(x) for x in (symbols, sources, docs_of, byte_from, byte_to))
    index = FMIndex(text, len(phrases.numbers) + 1)
    delta = np.zeros(len(text) + 1, np.int64)
    pairs: set[tuple[int, str]] = set()
    for size, (patterns, owner_at, owners) in phrases.by_size.items():
        low, high = index.search(patterns)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        at = index.locate(ragged(low[found], counts))
        np.add.at(delta, at, 1)
        np.add.at(delta, at + size, -1)
        for d, p in set(zip(doc[at].tolist(), np.repeat(found, counts).tolist(), strict=True)):
            pairs.update((d, phrases.items[o]) for o in owners[owner_at[p] : owner_at[p + 1]].tolist())
    hit = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
    if not len(hit):
        return n_words, none, none, none, np.zeros((0, 2), np.int64), []
    new = np.ones(len(hit), bool)  # a span goes on where the next word of the same text is hit
    new[1:] = (doc[hit[1:]] != doc[hit[:-1]]) | (word[hit[1:]] != word[hit[:-1]] + 1)
    begin, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hit)) - 1
    spans = doc[hit[begin]], word[hit[begin]], word[hit[end]] + 1
    return n_words, *spans, np.stack([b_from[hit[begin]], b_to[hit[end]]], 1), sorted(pairs)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(shipped, first: bool, last: bool):
    """One block of the benchmark over the batches; what earlier blocks found is merged in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shipped.value
        for batch in batches:
            n = batch.num_rows
            data, offsets = text_buffer(batch.column(1))
            n_words, doc, start, end, _, pairs = find_hits(phrases, data, offsets)
            spans: list[list] = [[] for _ in range(n)] if first else [[(s["start"], s["end"]) for s in x] for x in batch.column(3).to_pylist()]
            items: list[set] = [set() for _ in range(n)] if first else [set(x) for x in batch.column(4).to_pylist()]
            for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
                spans[d].append((a, b))
            for d, item in pairs:
                items[d].add(item)
            found = [pa.array(n_words), pa.array([[{"start": a, "end": b} for a, b in _merge(x)] for x in spans], _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            kept = [batch.column(0)] if last else [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*kept, *found], ["doc", *([] if last else ["body"]), "n_words", "spans", "items"])

    return run


_CUTS = pa.list_(pa.list_(pa.int64()))


def _cut(shipped, at: int, name: str, first: bool, last: bool):
    """One block of the benchmark over the batches: its spans join those of earlier blocks, which the last
    column holds as (first word, words beyond, first byte, bytes beyond); the last block cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            data, offsets = text_buffer(column)
            _, doc, start, end, cut, _ = find_hits(shipped.value, data, offsets)
            spans: dict[int, list] = {} if first else {d: x for d, x in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if x}
            cut = cut - offsets[doc][:, None]
            for d, *span in zip(doc.tolist(), start.tolist(), end.tolist(), cut[:, 0].tolist(), cut[:, 1].tolist(), strict=True):
                spans.setdefault(d, []).append(span)
            kept = batch if first else batch.select(batch.schema.names[:-1])
            if not last:
                yield kept.append_column(name, pa.array([spans.get(d, []) for d in range(batch.num_rows)], _CUTS))
                continue
            if spans:
                out, whole = column.to_pylist(), data.tobytes()
                for d, own in spans.items():
                    left, parts, beyond = int(offsets[d]), [], -1
                    for a, b, a_byte, b_byte in sorted(own):
                        if a > beyond:  # else the words go on from the span before, and so does the cut
                            parts.append(whole[left : int(offsets[d]) + a_byte])
                        beyond, left = max(beyond, b), max(left, int(offsets[d]) + b_byte)
                    out[d] = b"".join([*parts, whole[left : offsets[d + 1]]]).decode()
                kept = kept.set_column(at, kept.schema.field(at), pa.array(out, column.type))
            yield kept

    return run


def _blocks(items: DataFrame, item_id: str, text: str, width: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """The number of blocks of bounded size that the benchmark needs, and the blocks, built one at a time."""
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    own = lambda k: items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
    return n, (Phrases([(r.i, r.t) for r in own(k).toLocalIterator()], width) for k in range(n))


def _by_blocks(out: DataFrame, blocks: tuple[int, Iterator[Phrases]], step: Callable, schemas: Callable) -> DataFrame:
    """One pass over the rows for each block. What a pass found is written before the next block is built, and its broadcast
    released, so that driver and workers hold one block at a time."""
    n, made = blocks
    for k, phrases in enumerate(made):
        shipped = out.sparkSession.sparkContext.broadcast(phrases)
        del phrases
        last = k == n - 1
        out = out.mapInArrow(step(shipped, k == 0, last), schemas(last))
        if not last:
            out = durable(out)
            shipped.destroy()
    return out


def benchmark_hits(docs: DataFrame, items: DataFrame, *, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): the spans of words to remove, as word numbers with the end
    exclusive, and the sorted ids, as strings, of the items whose phrases occur. Nothing is shuffled; a benchmark of
    more than `block_bytes` is searched in blocks, one after the other over the same rows."""
    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("body"))
    out = _by_blocks(out, _blocks(items, item_id, item_text, width, block_bytes), _scan, lambda last: f"doc {kind}, {'' if last else 'body string, '}{_OUT}")
    return out.withColumnRenamed("doc", doc_id)


def strip_hits(docs: DataFrame, items: DataFrame, *, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with the hit spans cut out of `text` (from the first hit word's first character to the
    last one's last), all other columns as they are. Every block of a large benchmark is searched in the
    unchanged text; what they found is merged by word and cut once, by the last."""
    at = docs.columns.index(text)
    with_cuts = T.StructType([*docs.schema.fields, T.StructField(fresh("__cuts", docs.columns), T.ArrayType(T.ArrayType(T.LongType())))])
    return _by_blocks(docs, _blocks(items, item_id, item_text, width, block_bytes), lambda shipped, first, last: _cut(shipped, at, with_cuts.names[-1], first, last), lambda last: docs.schema if last else with_cuts)


def op1_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns, derived from `benchmark_hits`."""
    hits = benchmark_hits(docs, items)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long")), F.lit(0).cast("long"))
    listed = F.array_join("items", ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
