"""Language ID: averaged hashed subword embeddings and a linear softmax, trained in numpy.

A text's subwords are its runs of 2, 3 and 4 bytes (A-Z in lower case, other ASCII than letters as
a space), hashed into buckets. A text is the mean of its subwords' vectors; a softmax over it gives
the languages. Both are trained by stochastic gradient descent on a bounded sample of documents.

Calibration uses short excerpts (EXCERPTS bytes) of the rows that training left out. The temperature
is fitted on them. The threshold comes from models that each leave one language out: it is where
they tell excerpts of the language they never saw from excerpts of those they know best, though at
most KEPT_BACK of the known ones may be rejected. What is rejected keeps its prediction.

Scoring folds the vectors and the softmax into one table of whole numbers, a row for each bucket, so
that a text's score is a function of the text alone, whatever it shares a batch with.

Nulls and edges: a null text or one without letters is `und` with score 0, and rejected; rows with a
null lang are never learned from; without any row to learn from, all is `und`; ties go to the
language that sorts first; a null doc_id counts as held out of training. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import pieces, text_buffer

BITS = 15
#: Documents that a model is fitted on, at most: those whose ids hash lowest.
SAMPLE = 2000
UNKNOWN = "und"
#: Sizes of the excerpts that calibrate, in bytes, and the share of known ones that may be rejected.
EXCERPTS, KEPT_BACK = (30, 60, 120, 240), 0.05
#: Documents that each model which leaves a language out is fitted on, at most.
LEFT_OUT = 400
#: Steps of a logit in the folded table.
STEPS = 1 << 16
SIZES = (2, 3, 4)
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[:128] = 32
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subword the buckets, in text order, and the n + 1 positions of the texts in them.
    Subwords that span two texts fall to the bucket 1 << BITS, which has no weight."""
    plain = _PLAIN[data]
    run = plain.copy()
    for size in SIZES:
        run = (run[:-1] << np.uint32(8)) | plain[size - 1 :] if len(run) else run
        bucket = ((run * np.uint32(2654435761 + 2 * size)) >> np.uint32(32 - BITS)).astype(np.int32)
        at = np.minimum(offsets, len(bucket))
        for back in range(1, size):
            cross = offsets[1:-1] - back
            bucket[cross[(cross >= 0) & (cross < len(bucket))]] = 1 << BITS
        yield bucket, at


def n_subwords(sizes: np.ndarray) -> np.ndarray:
    """How many subwords texts of these numbers of bytes have themselves."""
    return sum(np.maximum(sizes - size + 1, 0) for size in SIZES)


def _count(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their share of it."""
    found = np.concatenate([b for b, _ in subwords(own, np.array([0, len(own)]))])
    bucket, n = np.unique(found, return_counts=True)
    return bucket, (n / max(1, len(found))).astype(np.float32)


def _excerpts(own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The counts of an excerpt of each size that the text has, from a place that its bytes choose."""
    place = int(own.sum(dtype=np.int64)) * 2654435761 % (1 << 32) / (1 << 32)
    cuts = (own[int(place * (len(own) - size)) :][:size] for size in EXCERPTS if len(own) >= size)
    return [_count(x) for x in cuts]


class Model:
    """`table`: a row of logits for each bucket, in steps of 1 / STEPS, and a last row of zeros."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(column)
        total = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        for low, high in pieces(offsets, 1 << 18):
            at = offsets[low : high + 1] - offsets[low]
            for bucket, cut in subwords(data[offsets[low] : offsets[high]], at):
                full = np.flatnonzero(np.diff(cut))
                if len(full):
                    total[low + full] += np.add.reduceat(self.table[bucket], cut[:-1][full], axis=0, dtype=np.int64)
        return total / (np.maximum(n_subwords(np.diff(offsets)), 1)[:, None] * float(STEPS)) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


Counts = tuple[np.ndarray, np.ndarray]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(rows: list[tuple[str, Counts]], languages: list[str], dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The folded table (a row of logits a bucket) and the biases, by stochastic gradient descent."""
    target = np.array([languages.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / dim, ((1 << BITS) + 1, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order, steps, done = np.arange(len(rows)), epochs * -(-len(rows) // 16), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for low in range(0, len(order), 16):
            batch = order[low : low + 16]
            bucket, share = (np.concatenate([rows[k][1][i] for k in batch]) for i in (0, 1))
            sizes = np.array([len(rows[k][1][0]) for k in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            mean = np.add.reduceat(vectors[bucket] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            p = _softmax(mean @ weights + bias)
            p[np.arange(len(batch)), target[batch]] -= 1
            step = rate * (1 - done / steps) / len(batch)
            to_mean = p @ weights.T
            weights -= step * (mean.T @ p)
            bias -= step * 0.1 * p.sum(0)
            by = np.argsort(bucket, kind="stable")
            new = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            vectors[bucket[by[new]]] -= step * 16 * np.add.reduceat(share[by, None] * to_mean[owner[by]], new, axis=0)
            done += 1
    table = vectors @ weights
    table[-1] = 0
    return table, bias


def _logits(table: np.ndarray, bias: np.ndarray, counted: list[Counts]) -> np.ndarray:
    return np.array([share @ table[bucket] for bucket, share in counted]).reshape(-1, len(bias)) + bias


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of the least log loss, between 1 / 1000 and 1000; half an excerpt's weight is spread evenly over the
    languages, so that a model without errors on the excerpts does not end at certainty."""
    n = len(target)
    wanted = np.full(logits.shape, 0.5 / n / logits.shape[1])
    wanted[np.arange(n), target] += 1 - 0.5 / n
    loss = lambda t: -(wanted * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum()
    grid = np.geomspace(1e-3, 1e3, 121)
    return float(min(grid, key=loss))


def _threshold(known: np.ndarray, unseen: np.ndarray) -> float:
    """Where scores of unseen languages part best from known ones, at most KEPT_BACK of which may lie below."""
    if not len(known) or not len(unseen):
        return 0.0
    cuts = np.quantile(known, np.linspace(0, KEPT_BACK, 51))
    return float(max(cuts, key=lambda c: (unseen < c).mean() - (known < c).mean()))


def train(rows: list[tuple[str, Counts, list[Counts]]], *, dim: int = 16, epochs: int = 6, rate: float = 8.0, seed: int = 7) -> Model | None:
    """A model of (language, counts of the text, counts of its excerpts); every tenth row is kept for calibration."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    order = np.random.default_rng(seed).permutation(len(rows))
    kept, learned = ([rows[k] for k in part] for part in (order[: len(rows) // 10], order[len(rows) // 10 :]))
    table, bias = _descend([r[:2] for r in learned], languages, dim, epochs, rate, seed)
    excerpts = [(x, r[0]) for r in kept for x in r[2]]
    temperature, threshold = 1.0, 0.0
    if excerpts:
        temperature = _temperature(_logits(table, bias, [x for x, _ in excerpts]), np.array([languages.index(l) for _, l in excerpts]))
    if excerpts and len(languages) > 2:
        known, unseen = [], []
        for without in languages:
            others = [x for x in languages if x != without]
            part = [r[:2] for r in learned if r[0] != without][:LEFT_OUT]
            if {r[0] for r in part} == set(others):
                t, b = _descend(part, others, dim, epochs // 2, rate, seed)
                own = np.array([l != without for _, l in excerpts])
                z = _logits(t, b, [x for x, _ in excerpts])
                if own.any():
                    p = _softmax(z / _temperature(z[own], np.array([others.index(l) for _, l in excerpts if l != without]))).max(1)
                    known.append(p[own])
                    unseen.append(p[~own])
        if known:
            threshold = _threshold(np.concatenate(known), np.concatenate(unseen))
    return Model(languages, np.round(table * STEPS).astype(np.int32), bias.astype(np.float64), temperature, threshold)


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def fit(docs: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of at most `sample` rows of `docs` that fulfil `learn` and have a lang: one for each of the doc_ids that
    hash lowest (of rows that share one, that with the lowest hash of its text), so that repeats bring no more rows."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows if learn is None else rows.filter(learn)
    rows = rows.select(F.col(doc_id).cast("long").alias("doc"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("body"))
    ids = rows.select("doc").distinct().orderBy(F.xxhash64("doc"), "doc").limit(sample)
    one = rows.join(F.broadcast(ids), "doc").groupBy("doc").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "lang", "body")).alias("r"))
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            found = [[_count(data[a:z]), *_excerpts(data[a:z])] for a, z in zip(offsets, offsets[1:], strict=False)]
            flat = [x for own in found for x in own]
            cuts = ends([len(b) for b, _ in flat])
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[k] for x in flat] or [np.zeros(0)]).astype(kind))) for k, kind in ((0, np.int32), (1, np.float32))]
            counts = pa.ListArray.from_arrays(ends([len(x) for x in found]), pa.StructArray.from_arrays(lists, ["bucket", "share"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc", "lang", "counts"])

    table = one.select("doc", "r.lang", "r.body").mapInArrow(run, "doc long, lang string, counts array<struct<bucket:array<int>,share:array<float>>>").toArrow().sort_by("doc").combine_chunks()
    values = []
    for part in table.to_batches():
        lists = part.column(2)
        of_doc, inner = lists.offsets.to_numpy(), lists.values
        cuts, bucket, share = inner.field("bucket").offsets.to_numpy(), inner.field("bucket").values.to_numpy(), inner.field("share").values.to_numpy()
        for name, a, z in zip(part.column(1).to_pylist(), of_doc.tolist(), of_doc[1:].tolist(), strict=False):
            counts = [(bucket[cuts[k] : cuts[k + 1]], share[cuts[k] : cuts[k + 1]]) for k in range(a, z)]
            if len(counts[0][0]):
                values.append((name, counts[0], counts[1:]))
    return train(values)


def identify(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                letters[:] = False
            else:
                p = model.probabilities(model.logits(batch.column(1)))
                best, score = p.argmax(1), p.max(1)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(~letters | (score < (model.threshold if model else 1)))], ["doc", "lang_pred", "score", "rejected"])

    body = F.col(text).cast("string")
    out = docs.select(F.col(doc_id).cast("long").alias("doc"), body.alias("body"), F.coalesce(F.rlike(body, F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    return out.mapInArrow(run, "doc long, lang_pred string, score double, rejected boolean").withColumnRenamed("doc", doc_id)


def op5_rows(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True))
    model = fit(docs, learn=~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
