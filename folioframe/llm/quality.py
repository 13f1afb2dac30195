"""Quality by positive-unlabelled learning with the non-negative risk.

Positives are documents that trusted labels call good; unlabelled are documents of the web text that
no label covers. The class prior is estimated from both: a first scorer, of positives against
unlabelled, is fitted on one half; on the other the unlabelled ones' share above a score can't be less than
the prior times the positives' share above it, and the least such ratio estimates the prior. A linear scorer over text statistics minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss, by Adam in numpy; where the second part turns negative its gradient is
reversed. No label that calls a document bad is used.

Nulls and edges: a null or empty text has all statistics zero and a score like any other; labels
with a null doc_id or quality are left out; several labels of one document count once, good if any says so;
without positives every score is 0.5; a null doc_id counts as held out of training. Columns of
`docs` other than the id and the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import SPACE, U, byte_set, fresh, mix, pieces, text_buffer, word_hashes, word_spans

#: Documents of either kind that a model is fitted on, at most: those whose ids hash lowest.
SAMPLE = 6000
_IN_WORD = ~SPACE
_UPPER, _LOWER_CASE, _DIGIT, _BEYOND = byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A)), byte_set((0x30, 0x39)), byte_set((0x80, 0xFF))
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
#: A column of byte classes: upper, lower, digits, beyond ASCII, line ends, then each ASCII mark.
_CLASS = np.full(256, 5 + len(_MARKS), np.int64)
for _k, _flags in enumerate((_UPPER, _LOWER_CASE, _DIGIT, _BEYOND)):
    _CLASS[_flags] = _k
_CLASS[10] = 4
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = 5 + _k
N_CLASSES = 6 + len(_MARKS)


def _shares(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of each text's values; `starts` has n + 1 positions."""
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[starts[1:]] - total[starts[:-1]]).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of byte classes, of repeated words, word and line lengths."""
    data, offsets = text_buffer(column)
    out = []
    for low, high in pieces(offsets):
        raw, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        n = high - low
        owner = np.repeat(np.arange(n), np.diff(at))
        counts = np.bincount(owner * N_CLASSES + _CLASS[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
        starts, ends, words = word_spans(raw, at, _IN_WORD)
        n_words = np.diff(words).astype(np.float64)
        hashes = word_hashes(raw, starts, ends)
        doc = np.repeat(np.arange(n), np.diff(words))
        per_word = np.maximum(n_words, 1)
        again = []
        for lag in (1, 2, 3):
            same = np.zeros(len(hashes))
            same[lag:] = (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
            again.append(_shares(same, words) / per_word)
        key = mix(hashes ^ mix(doc.astype(np.uint64) + U(1)))
        seen = np.unique(key, return_index=True)[1]
        distinct = np.bincount(doc[seen], minlength=n) / per_word
        size = (ends - starts).astype(np.float64)
        length = _shares(size, words) / per_word
        long_ = _shares((size > 24).astype(np.float64), words) / per_word
        single = _shares((size == 1).astype(np.float64), words) / per_word
        letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 3], 1)
        shouted = counts[:, 0] / letters
        lines = counts[:, 4]
        per_byte = np.maximum(counts.sum(1), 1)
        marks = counts[:, 5:-1]
        part = np.column_stack([
            np.tanh(marks / per_word[:, None] * 4), np.tanh(marks.sum(1) / per_byte * 10), np.tanh(counts[:, 2] / per_byte * 10), np.tanh(shouted * 3), np.tanh(lines / per_word * 10),
            *(np.tanh(4 * a) for a in again), np.minimum(1, distinct), np.tanh(np.maximum(0, 0.4 - distinct) * 5) * np.tanh(n_words / 50), np.tanh(length / 8), np.tanh(long_ * 20), np.tanh(single * 5),
            np.tanh(n_words / 5), np.tanh(n_words / 30), np.tanh(n_words / 200), np.minimum(1, np.log1p(n_words) / 10),
        ])
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, len(_MARKS) + 17))


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float) -> None:
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, column: pa.Array) -> np.ndarray:
        z = ((statistics(column) - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """The share of positives among the unlabelled rows, from the scores of a logistic regression of one against the other
    (least squares steps), at the quantiles of the positives that a half left out of the fit has."""
    rng = np.random.default_rng(seed)
    halves = [np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled)]
    (p, p_out), (u, u_out) = halves
    if not min(map(len, (p, p_out, u, u_out))):
        return 0.5
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), np.maximum(both.std(0), 0.02)
    with_one = lambda x: np.column_stack([(x - mean) / scale, np.ones(len(x))])
    x, y = with_one(both), np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    weight = np.where(y > 0, 0.5 / len(p), 0.5 / len(u))
    w = np.zeros(x.shape[1])
    for _ in range(12):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (weight * (q - y)) + 1e-3 * w)
    zp, zu = np.sort(with_one(p_out) @ w), np.sort(with_one(u_out) @ w)
    cuts = np.quantile(zp, np.linspace(0, 0.5, 21))
    above = lambda z: 1 - np.searchsorted(z, cuts) / len(z)
    ratio = above(zu) / np.maximum(above(zp), 1e-9)
    slack = np.sqrt(ratio * np.maximum(1 - above(zu), 0) / (np.maximum(above(zp), 1e-9) * len(zu)))
    return float(np.clip((ratio + slack).min(), 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 3000, rate: float = 0.02, decay: float = 3e-4) -> Model | None:
    """Minimises the non-negative risk over all rows given."""
    if not len(positive) or not len(unlabelled):
        return None
    prior = float(np.clip(prior, 0.02, 0.98))
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 0.02)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w = np.zeros(p.shape[1] + 1)
    p, u = np.column_stack([p, np.ones(len(p))]), np.column_stack([u, np.ones(len(u))])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -60, 60))), 1 / (1 + np.exp(-np.clip(zu, -60, 60)))
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = -of_negative if as_negative < 0 else prior * (p.T @ (sp - 1)) / len(p) + of_negative
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model of at most `sample` positives and as many unlabelled documents; `learn` says, of doc_id, which rows may be learned
    from. Of rows that share a doc_id that with the lowest hash of its text counts, so that repeats bring no more rows."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc")).filter("doc is not null")
    known = labels.select(F.col(doc_id).cast("long").alias("doc"), F.col(quality).cast("int").alias("good")).filter("doc is not null and good is not null")
    if learn is not None:
        ids, known = ids.filter(learn), known.filter(learn)
    known = known.groupBy("doc").agg(F.max("good").alias("good"))
    low = lambda rows: rows.select("doc").orderBy(F.xxhash64("doc"), "doc").limit(sample)
    chosen = low(known.filter("good = 1").join(ids, "doc", "left_semi")).withColumn("kind", F.lit(1)).unionByName(low(ids.join(known, "doc", "left_anti").distinct()).withColumn("kind", F.lit(0)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body")).join(F.broadcast(chosen), "doc")
    rows = rows.groupBy("doc", "kind").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "body")).alias("r")).select("doc", "kind", "r.body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["doc", "kind", "found"])

    table = rows.mapInArrow(run, "doc long, kind int, found array<double>").toPandas().sort_values(["doc", "kind"], kind="stable")
    if table.empty:
        return None
    values, kind = np.stack(table["found"].to_list()), table["kind"].to_numpy()
    unlabelled = values[kind == 0] if (kind == 0).any() else values  # labels cover all: then the labelled texts stand for the web
    return train(values[kind == 1], unlabelled, estimate_prior(values[kind == 1], unlabelled))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column `score` between 0 and 1."""
    from pyspark.sql import types as T

    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            found = np.full(batch.num_rows, 0.5) if model is None else model.score(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op4_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    model = fit(docs, labels, learn=fold(F.col("doc"), 3) != 1)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject."""
    model = fit(docs, labels, learn=fold(F.col("doc"), 3) != 1)
    name = fresh("__score", docs.columns)
    return score(docs, model, name=name).filter(F.col(name) >= 0.5).drop(name)
