"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; everything else is unlabelled web
text, so no negative label is ever read.  The class prior is estimated by the best bin
of a positive-versus-unlabelled scorer (the least ratio of the two shares above a
threshold, with a margin for chance).  The model is logistic on piecewise-linear text
measures and minimises the non-negative unbiased risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

with logistic loss, ascending on the negative part where it falls below zero.  The fit
uses at most ``max_positives`` and ``max_unlabelled`` training rows, picked by a hash
of the id and measured on the executors; only their measures reach the driver.
Scoring is one narrow pass over all whole texts.  Labels, language, source and id are
no inputs of a score.

Null and empty texts get the score of a text without words; rows with null ids are
scored but never learnt from; with no positives every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import (column_bytes, lines_of_words, map_batches, mix64, per_row, prefix_hash, repeated,
                              sequence_hash, slices, span_hash, texts, words)

MAX_POSITIVES, MAX_UNLABELLED, THRESHOLD = 20_000, 40_000, 0.3

# Byte classes whose shares are measured; 0 is the rest.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:", b"!?",
            b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"\"'()[]{}", b"-_/\\@=+~^`", bytes(range(128, 256))]
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_CLASSES, 1):
    _CLASS_OF[list(_chars)] = _i
_N_CLASSES = len(_CLASSES) + 1
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>!@^~=+_{}[]\\")] = True
N_MEASURES = _N_CLASSES + 11
KNOTS = (0.5, 0.8, 0.95, 0.99)


def measures(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(texts, N_MEASURES) of shares and log sizes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n, dtype=np.int32), size)
    kinds = np.bincount(row_of * _N_CLASSES + _CLASS_OF[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    start, end, row = words(offsets, data)
    count = per_row(row, n)
    length = end - start
    prefix = prefix_hash(data)
    word = span_hash(prefix, start, end)
    salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    uppers = upper[end] - upper[start]
    marked = _MARK[data[end - 1]] if len(end) else np.zeros(0, bool)
    same = np.zeros(len(row), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    _, again = repeated(word ^ salt[row])
    three = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    many, _ = repeated(mix64(word[three] + mix64(word[three + 1] + mix64(word[three + 2]))) ^ salt[row[three]])
    line = lines_of_words(offsets, data, start, row)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    line_row = row[first]
    _, line_again = repeated(sequence_hash(word, first, np.append(first[1:], len(line))) ^ salt[line_row])
    n_lines = per_row(line_row, n)
    w, lines = np.maximum(count, 1), np.maximum(n_lines, 1)
    mean = per_row(row, n, length.astype(float)) / w
    spread = np.sqrt(np.maximum(per_row(row, n, (length * length).astype(float)) / w - mean ** 2, 0))
    return np.column_stack([
        np.sqrt(kinds / np.maximum(size, 1)[:, None]),
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread),
        per_row(row[marked], n) / w, per_row(row[(uppers >= 2) & (2 * uppers >= length)], n) / w,
        per_row(row[same], n) / w, per_row(row[again], n) / w, per_row(row[three[many]], n) / w,
        per_row(line_row[line_again], n) / lines, np.log1p(count / lines)])


def measure_batch(column: pa.Array) -> np.ndarray:
    offsets, data = column_bytes(column)
    return np.concatenate([measures(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]])
                           for a, b in slices(offsets, 1 << 20)])


class Model:
    """Logistic over standardised measures and their rises above a few quantiles."""

    def __init__(self, sample: np.ndarray):
        self.mean, self.scale = sample.mean(0), sample.std(0) + 1e-6
        self.knots = np.quantile(self._plain(sample), KNOTS, axis=0)
        self.weights, self.bias = np.zeros(sample.shape[1] * (1 + len(KNOTS))), 0.0

    def _plain(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = self._plain(x)
        return np.hstack([z, *(np.maximum(z - k, 0) for k in self.knots)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def descend(self, gradient, rounds: int, step: float = 0.03, decay: float = 1e-4) -> None:
        """Adam on the parameters; ``gradient(weights, bias)`` gives both parts."""
        theta = np.append(self.weights, self.bias)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            g = gradient(theta[:-1], theta[-1])
            g[:-1] += decay * theta[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - step * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
        self.weights, self.bias = theta[:-1], float(theta[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, rounds: int = 150) -> float:
    """Share of positives among the unlabelled rows, by the best bin of a scorer fitted on
    one half and judged on the other."""
    p, u = positives[::2], unlabelled[::2]
    model = Model(np.vstack([p, u]))
    x, y = model.inputs(np.vstack([p, u])), np.r_[np.ones(len(p)), np.zeros(len(u))]
    weight = np.where(y == 1, 0.5 / max(len(p), 1), 0.5 / max(len(u), 1))

    def gradient(w, b):
        g = weight * (_sigmoid(x @ w + b) - y)
        return np.append(x.T @ g, g.sum())

    model.descend(gradient, rounds)
    sp, su = np.sort(model.margin(positives[1::2])), np.sort(model.margin(unlabelled[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    above = lambda s: 1 - np.searchsorted(s, sp, side="left") / len(s)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    share_p, share_u = above(sp), above(su)
    ok = share_p > 0.05
    best = int(np.argmin(np.where(ok, (share_u + slack) / np.maximum(share_p, 1e-9), np.inf)))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray, rounds: int = 600) -> tuple[Model, float]:
    """The model of least non-negative risk, and the prior it was fitted with."""
    prior = estimate_prior(positives, unlabelled)
    model = Model(unlabelled)
    p, u = model.inputs(positives), model.inputs(unlabelled)

    def gradient(w, b):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        # logistic loss: l(f) = -log s(f), l(-f) = -log(1 - s(f))
        as_negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gp, gn_p, gn_u = (sp - 1) / len(p), sp / len(p), su / len(u)
        negative = np.append(u.T @ gn_u - prior * (p.T @ gn_p), gn_u.sum() - prior * gn_p.sum())
        if as_negative < 0:
            return -negative
        return prior * np.append(p.T @ gp, gp.sum()) + negative

    model.descend(gradient, rounds)
    return model, prior


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> tuple[Model, float] | None:
    """Fit on a bounded sample of the training fold; None without positives."""
    def chosen(ids: DataFrame, most: int, mark: int) -> DataFrame:
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        return (ids.where(~held_out()).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(most)
                .withColumn("positive", F.lit(mark)))

    good = chosen(labels.where("quality = 1"), max_positives, 1)
    web = chosen(docs.select(F.col(id_col).alias("doc_id")), max_unlabelled, 0)   # as found: good rows among it
    picked = F.broadcast(good.unionByName(web))                      # at most the two bounds
    rows = (texts(docs, id_col, text_col).join(picked, "doc_id")     # of the rows of one id, the least text
            .groupBy("positive", "doc_id").agg(F.min("text").alias("text")))

    def run(batch):
        x = measure_batch(batch.column(2))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_MEASURES).cast(pa.list_(pa.float64()))],
            ["positive", "doc_id", "x"])

    table = map_batches(rows, run, "positive int, doc_id long, x array<double>").toPandas()
    table = table.sort_values("doc_id", kind="stable")               # the same fit whatever the row order
    x = {k: np.array(g["x"].tolist()).reshape(-1, N_MEASURES) for k, g in table.groupby("positive")}
    if not len(x.get(1, ())):
        return None
    positives, others = x[1], x.get(0, np.zeros((0, N_MEASURES)))
    return fit(positives, others if len(others) else positives)


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        score = (model.value.score(measure_batch(batch.column(1))) if model.value is not None
                 else np.full(batch.num_rows, 0.5))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score),
                                           pa.array((score >= threshold).astype(np.int32))],
                                          ["doc_id", "held_out", "score", "predicted"])

    return map_batches(texts(docs, id_col, text_col, held_out(id_col).alias("held_out")), run,
                       "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all columns."""
    at, schema = docs.columns.index(text_col), docs.schema
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        if model.value is None:
            return batch
        return batch.filter(pa.array(model.value.score(measure_batch(batch.column(at).fill_null(""))) >= threshold))

    return map_batches(docs, run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    fitted = train(docs, labels, **bounds)
    return classify(docs, fitted and fitted[0], threshold)
