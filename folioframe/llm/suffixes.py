"""Suffix-array dedup: a radix sort of suffixes through the first `depth` bytes only; equal groups are the repeated strings.

A text of n bytes has about n suffixes, and only the first `depth` = 50 bytes of each matter. Sending them all would move fifty times the input, so
that two steps come before the sort, and neither loses a repeat:

1. Documents are dealt to chunks of about CHUNK_BYTES. In each, every position has the least hash of the SPAN grams (of GRAM bytes)
   from it on. Equal strings of `depth` bytes have equal least hashes at all their inner places, so a string can only
   repeat if each of these is in another document too. A chunk sends its distinct ones, 40 bits each, to the bucket of their
   leading bits; the bucket answers with one bit for each: whether another chunk has it.
2. Suffixes of which all are shared are left. Neighbouring ones that have the same least hash overall go
   together as one stretch of bytes to the bucket of that hash, a distinct stretch once from each chunk, with the smallest doc_id that has it there.
   All equal strings meet in one bucket. A hash that more than HOT documents have (the edges of a common passage, with other
   bytes beside it in each) would fill its bucket: its suffixes go one by one, each to the bucket of its own `depth` bytes.
3. A bucket sorts its suffixes by most-significant-digit passes: digits of eight bytes, then of five, each pass only within groups that are still mixed;
   suffixes that become alone drop out. After the pass that reaches `depth`, a group is one repeated string, and the smallest doc_id in it
   is known. The bucket answers each chunk with one bit for each suffix: whether an earlier document has it.
4. Each chunk marks the bytes that such strings cover.

The text is shuffled once (the three passes over it read the same exchange). Wrong matches of hashes only send more to the sort, which compares bytes.

Nulls and edges: a null or empty text has no bytes and keeps nothing; texts under `depth` bytes lose nothing; a null doc_id sorts
after all others; rows that share a doc_id (or have none) take nothing from each other; rows of the same id and the same text share a chunk; an empty table gives none. Bytes are cut, so
that what is kept may end within a character; it is returned as binary. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import _BYTE_VALUES, mix, ragged, text_buffer, window_hashes
from .substring_dedup import _from_planes, _planes

_LAST = np.iinfo(np.int64).max
CHUNK_BYTES, HOT, GRAM, SPAN = 16 << 20, 4096, 24, 16
#: Bytes or suffixes worked on at a time; of how many documents of a chunk on a hash's count is sent.
_STEP, _MANY = 1 << 18, 16


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """The least of the `span` values from each place on."""
    done = 1
    while done < span:
        by = min(done, span - done)
        hashes = np.minimum(hashes[:-by], hashes[by:])
        done += by
    return hashes


def _spread(flags: np.ndarray, by: int) -> None:
    """Each flag also holds for the `by` places before it, in place."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        flags[:-step] |= flags[step:].copy()
        done += step


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where in sorted keys each bucket begins, and the end: bucket b has the b-th of equal ranges."""
    edges = np.array([-((-b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Chunk:
    """The bytes of some documents in the order of (doc, text), as stretches with the same least hash."""

    def __init__(self, table: pa.Table, depth: int) -> None:
        self.depth, self.inner = depth, depth - GRAM - SPAN + 1
        self.table = table.take(pc.sort_indices(table, sort_keys=[("doc", "ascending"), ("body", "ascending")]))
        self.ids = pc.fill_null(self.table["doc"], _LAST).to_numpy()
        self.data, self.offsets = text_buffer(self.table["body"])
        reach, total = GRAM + SPAN - 1, len(self.data)
        size = np.diff(self.offsets)
        tail = np.minimum(size, reach - 1)
        outside = np.zeros(total + 1, bool)  # positions from which a span would leave the document
        outside[ragged(self.offsets[1:] - tail, tail)] = True
        begins = np.zeros(total + 1, bool)
        begins[self.offsets[:-1]] = True
        values, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a in range(0, total, _STEP):
            z = min(a + _STEP, total)
            least = np.zeros(z - a, np.uint64)
            if z - a >= reach or total - a >= reach:
                found = _least(window_hashes(_BYTE_VALUES[self.data[a : z + reach - 1]], GRAM), SPAN)
                least[: len(found)] = found[: z - a]
            least[outside[a:z]] = 0
            new = begins[a:z].copy()
            new[0] = True
            new[1:] |= least[1:] != least[:-1]
            at = np.flatnonzero(new)
            values.append(least[at])
            places.append(a + at)
        self.value, self.place = np.concatenate(values), np.concatenate(places)
        self.key = mix(self.value)
        order = np.argsort(self.key, kind="stable")
        key, doc = self.key[order], (np.searchsorted(self.offsets, self.place, "right") - 1)[order]
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        other = np.ones(len(order), np.int64)
        other[1:] = new[1:] | (doc[1:] != doc[:-1])
        self.distinct, self.n_docs = key[first], np.add.reduceat(other, first) if len(first) else first
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def stretches(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, suffixes, route) of the stretches of suffixes that may repeat; `shared` and `hot` are for each of `distinct`."""
        shared = (shared & (self.distinct != 0))[self.which]
        hot = hot[self.which]
        apart = np.repeat(~shared, np.diff(np.append(self.place, len(self.data))))
        _spread(apart, self.inner)
        left = np.flatnonzero(~apart)
        out = []
        for k in range(0, len(left), _STEP):
            p = left[k : k + _STEP]
            here, there = (np.searchsorted(self.place, p + by, "right") - 1 for by in (0, self.inner))
            least = np.where(self.value[there] < self.value[here], there, here)
            key, alone = self.key[least], hot[least]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1] + 1) | (key[1:] != key[:-1]) | alone[1:] | alone[:-1]
            first = np.flatnonzero(new)
            route, own = key[first], np.flatnonzero(alone[first])
            for j in range(0, len(own), 4096):
                part = own[j : j + 4096]
                route[part] = _string_hashes(self.data, p[first[part]], self.depth)
            out.append((p[first], np.diff(np.append(first, len(p))), route))
        starts, counts, routes = zip(*out, strict=True) if out else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)])
        return np.concatenate(starts), np.concatenate(counts), mix(np.concatenate(routes) + np.uint64(1))

    def read_shared(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The flags (shared, hot) of `distinct`, from its own documents and the answers of the buckets."""
        shared, hot, at = self.n_docs > 1, np.zeros(len(self.distinct), bool), _bounds(self.distinct, buckets)
        for b, packed in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            n = int(at[b + 1] - at[b])
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=2 * n).astype(bool)
            shared[at[b] : at[b + 1]] |= bits[:n]
            hot[at[b] : at[b + 1]] = bits[n:]
        return shared, hot


class Stretches:
    """The distinct stretches of a chunk, by bucket, and where each occurs."""

    def __init__(self, chunk: Chunk, answers: pa.Table, buckets: int) -> None:
        self.start, self.count, route = chunk.stretches(*chunk.read_shared(answers, buckets))
        raw, more = chunk.data.tobytes(), chunk.depth - 1
        number: dict[bytes, int] = {}
        item = np.fromiter((number.setdefault(raw[a : a + n + more], len(number)) for a, n in zip(self.start.tolist(), self.count.tolist(), strict=True)), np.int64, len(self.start))
        first = np.unique(item, return_index=True)[1]
        order = np.argsort(route[first], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.item, self.at = place[item] if len(item) else item, _bounds(route[first][order], buckets)
        texts = list(number)
        self.texts = [texts[k] for k in order.tolist()]
        self.doc = chunk.ids[np.searchsorted(chunk.offsets, self.start, "right") - 1]  # of each occurrence
        self.least = self.doc[first][order]  # documents come in order, so the first has the smallest id
        self.suffixes = self.count[first][order]


def _string_hashes(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    values = _BYTE_VALUES[data[starts[:, None] + np.arange(depth)]]
    return mix((values * mix(np.arange(1, depth + 1, dtype=np.uint64))).sum(1, dtype=np.uint64))


def _send(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, depth)
        at = _bounds(chunk.distinct, buckets)
        own = np.flatnonzero(np.diff(at))
        # 40 bits below those that all hashes of a bucket share tell them apart well enough.
        short = (chunk.distinct << np.uint64((buckets - 1).bit_length())) >> np.uint64(24)
        hashes, many, counts = [], [], []
        for b in own:
            part = short[at[b] : at[b + 1]]
            hashes.append(_planes(part)[: 5 * len(part)])
            often = np.flatnonzero(chunk.n_docs[at[b] : at[b + 1]] >= _MANY)
            many.append(_planes(often.astype(np.uint32)))
            counts.append(_planes(chunk.n_docs[at[b] : at[b + 1]][often]))
        number = table["chunk"][0].as_py()
        return pa.table({"bucket": pa.array(own, pa.int64()), "chunk": pa.array([number] * len(own), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "many": pa.array(many, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _answer(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For each chunk in a bucket two bits for each of its hashes: whether another chunk has it, and whether more than `hot` documents have."""
        sent = []
        for blob in table["hashes"]:
            raw = np.frombuffer(blob.as_py(), np.uint8).reshape(5, -1)
            sent.append(np.ascontiguousarray(np.concatenate([raw, np.zeros((3, raw.shape[1]), np.uint8)]).T).view(np.uint64).ravel())
        docs = []
        for own, many, counts in zip(sent, table["many"], table["counts"], strict=True):
            n = np.ones(len(own), np.int64)
            n[_from_planes(many.as_py(), np.uint32)] = _from_planes(counts.as_py(), np.int64)
            docs.append(n)
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        size, n_docs = np.bincount(group), np.add.reduceat(np.concatenate(docs)[order], first)
        shared, often = np.empty(len(order), bool), np.empty(len(order), bool)
        shared[order], often[order] = (size > 1)[group], (n_docs > hot)[group]
        chunks, bits, at = [], [], 0
        for chunk, own in zip(table["chunk"].to_pylist(), sent, strict=True):
            flags = np.concatenate([shared[at : at + len(own)], often[at : at + len(own)]])
            at += len(own)
            if flags.any():
                chunks.append(chunk)
                bits.append(np.packbits(flags).tobytes())
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(chunks), pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def _send_stretches(depth: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("bucket", "chunk", "suffixes", "docs", "bytes")
        rows: dict[str, list] = {c: [] for c in names}
        if table.num_rows:
            own, number = Stretches(Chunk(table, depth), answers, buckets), table["chunk"][0].as_py()
            for b in np.flatnonzero(np.diff(own.at)).tolist():
                part = slice(own.at[b], own.at[b + 1])
                for c, x in zip(names, (b, number, _planes(own.suffixes[part].astype(np.uint32)), _planes(own.least[part]), b"".join(own.texts[part])), strict=True):
                    rows[c].append(x)
        return pa.table({c: pa.array(rows[c], pa.int64() if c in ("bucket", "chunk") else pa.binary()) for c in names})

    return run


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` whose first `depth` bytes are not theirs alone: their places in `starts`, sorted by those bytes, and where a new group of equal ones begins.

    Passes go from the first digit to the last. A pass looks at all groups left, sorts those that its digit splits, and drops suffixes that are alone."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    member = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    new[:1] = True
    for off in (0, *range(8, depth - 5, 5), depth - 5):  # the last digit may overlap the one before
        if not len(member):
            break
        value = np.ascontiguousarray(view[starts[member] + off]).view(">u8").ravel().astype(np.uint64)
        if off:
            value >>= np.uint64(24)
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        mixed = np.logical_or.reduceat(value != value[first][group], first)
        at = np.flatnonzero(mixed[group])
        # The number of a mixed group and the digit, as one key: 24 bits and 40.
        key = value[at] if not off else value[at] | ((np.cumsum(mixed) - 1)[group[at]].astype(np.uint64) << np.uint64(40))
        order = at[np.argsort(key) if mixed.sum() < 1 << 24 else np.lexsort((value[at], group[at]))]
        member[at], value[at] = member[order], value[order]
        new[1:] |= value[1:] != value[:-1]
        keep = ~(new & np.append(new[1:], True))
        member, new = member[keep], new[keep]
    return member, new


def _sort(depth: int):
    def run(table: pa.Table) -> pa.Table:
        """For each chunk in a bucket, one bit for each of its suffixes: whether an earlier document has it."""
        sent = [_from_planes(x.as_py(), np.uint32).astype(np.int64) for x in table["suffixes"]]
        count, doc = np.concatenate(sent), np.concatenate([_from_planes(x.as_py(), np.int64) for x in table["docs"]])
        # A stretch that several chunks sent is sorted once, for the smallest of its documents.
        number: dict[bytes, int] = {}
        same = np.empty(len(count), np.int64)
        k = 0
        for blob, own in zip(table["bytes"], sent, strict=True):
            raw, ends = blob.as_py(), np.cumsum(own + depth - 1).tolist()
            for a, z in zip([0, *ends], ends, strict=False):
                same[k] = number.setdefault(raw[a:z], len(number))
                k += 1
        data = np.frombuffer(b"".join(number), np.uint8)
        size = np.fromiter(map(len, number), np.int64, len(number))
        del number
        each = size - depth + 1
        first = np.full(len(size), _LAST)
        np.minimum.at(first, same, doc)
        starts, least = ragged(np.cumsum(size) - size, each), np.repeat(first, each)
        member, new = repeated_suffixes(data, starts, depth)
        if len(member):
            least[member] = np.minimum.reduceat(least[member], np.flatnonzero(new))[np.cumsum(new) - 1]
        begin = np.cumsum(each) - each
        chunks, bits, at = [], [], 0
        for chunk, own in zip(table["chunk"].to_pylist(), sent, strict=True):
            part = slice(at, at + len(own))
            at += len(own)
            flags = np.repeat(doc[part], own) > least[ragged(begin[same[part]], own)]
            if flags.any():
                chunks.append(chunk)
                bits.append(np.packbits(flags).tobytes())
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(chunks), pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def _remove(depth: int, buckets: int, with_kept: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, depth)
        about = answers["about"].to_numpy()
        own = Stretches(chunk, answers.filter(pa.array(about == 0)), buckets)
        bit_at = np.concatenate([[0], np.cumsum(own.suffixes)])
        later = np.zeros(int(bit_at[-1]), bool)
        sorted_ = answers.filter(pa.array(about == 1))
        for b, packed in zip(sorted_["bucket"].to_pylist(), sorted_["bits"].to_pylist(), strict=True):
            a, z = bit_at[own.at[b]], bit_at[own.at[b + 1]]
            later[a:z] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(z - a))
        gone = np.zeros(len(chunk.data) + 1, bool)
        for k in range(0, len(own.start), _STEP // 8):
            part = slice(k, k + _STEP // 8)
            start, count, item = own.start[part], own.count[part], own.item[part]
            again = later[ragged(bit_at[item], count)] | np.repeat(own.doc[part] > own.least[item], count)
            gone[ragged(start, count)[again]] = True
        backwards = gone[::-1]
        _spread(backwards, depth - 1)
        n_removed, digests, spans, texts = [], [], [], []
        for a, z in zip(chunk.offsets.tolist(), chunk.offsets[1:].tolist(), strict=False):
            off, own_bytes = gone[a:z], chunk.data[a:z]
            n = int(off.sum())
            kept = own_bytes[~off].tobytes() if n else own_bytes.tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]))) if n else np.zeros(0, np.int64)
            n_removed.append(n)
            digests.append(hashlib.sha256(kept).hexdigest())
            spans.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            if with_kept:
                texts.append(kept)
        size = np.diff(chunk.offsets)
        out = {"doc": chunk.table["doc"], "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return pa.table(out | ({"kept": pa.array(texts, pa.binary())} if with_kept else {}))

    return run


def remove_repeated_bytes(docs: DataFrame, *, depth: int = 50, doc_id: str = "doc_id", text: str = "text", with_kept: bool = False, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept_sha256, spans[, kept]): bytes in no string of `depth` bytes that a document with a smaller id has. `depth` is GRAM + SPAN or more."""
    if depth < GRAM + SPAN:
        raise ValueError(f"depth must be {GRAM + SPAN} or more")
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body"))
    size = dealt.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    most, least = max(1, -(-4 * size // chunk_bytes)), -(-size // chunk_bytes)
    chunks, buckets, partitions = max(least, min(4 * wanted, most)), max(1, least, min(wanted, most)), max(wanted, -(-least // 4))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc", "body"), F.lit(chunks))).repartition(partitions, "chunk")
    bits = "chunk long, bucket long, bits binary"
    sent = dealt.groupBy("chunk").applyInArrow(_send(depth, buckets), "bucket long, chunk long, hashes binary, many binary, counts binary").repartition(partitions, "bucket")
    shared = sent.groupBy("bucket").applyInArrow(_answer(hot), bits)
    moved = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_stretches(depth, buckets), "bucket long, chunk long, suffixes binary, docs binary, bytes binary").repartition(partitions, "bucket")
    sorted_ = moved.groupBy("bucket").applyInArrow(_sort(depth), bits)
    answers = shared.withColumn("about", F.lit(0)).unionByName(sorted_.withColumn("about", F.lit(1)))
    schema = "doc long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_kept
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(depth, buckets, with_kept), schema)
    return out.withColumnRenamed("doc", doc_id)


def op11_rows(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
