"""Multinomial regression on smoothed targets (M6), trained by distributed gradient sums.

Texts become hashed term indices once (a table); a term's value is its count times its inverse document frequency.
Every step scans that table: a task adds up the loss and the gradient of its rows (``mapInArrow``), cut into blocks
of features; the blocks are dealt over the cluster and summed there, so only the finished sum, classes x features numbers,
reaches the driver, which holds the weights and takes L-BFGS steps.  The smoothed target of a row is 1 - e + e / K for its class
and e / K for the others; it enters the gradient directly, no row is copied.  All penalties of a grid are trained side by side: one scan serves
a step of each.  ``num_features`` and the number of labels bound what is broadcast and collected.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import tokens
from kestrel.session import cut_lineage, spread

FEATURE_BLOCK = 8192
HISTORY = 10


@dataclass
class TextModel:
    labels: list[str]
    weights: np.ndarray  # labels x features, for plain counts: the inverse document frequency is in it
    bias: np.ndarray
    loss: float          # the training objective, penalty included


def hashed_terms(df: DataFrame, text_col: str = "text", num_features: int = 1 << 18, out: str = "_idx") -> DataFrame:
    """Adds the hashed indices of a text's words, a word as often as it occurs; a null text has none."""
    idx = F.transform(tokens(text_col), lambda t: F.pmod(F.hash(t), F.lit(num_features)))
    return df.withColumn(out, F.coalesce(idx, F.array().cast("array<int>")))


def inverse_frequencies(table: DataFrame, num_features: int, idx_col: str = "_idx") -> np.ndarray:
    """ln((n + 1) / (df + 1)) of every index, infinite where it does not occur; at most ``num_features`` rows reach the driver."""
    n = table.count()
    df = np.full(num_features, -1.0)
    for r in table.select(F.explode(F.array_distinct(idx_col)).alias("i")).groupBy("i").count().toLocalIterator():
        df[r[0]] = r[1]
    with np.errstate(divide="ignore"):
        return np.log((n + 1) / (df + 1))


def _entries(col: pa.Array, num_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, count) of a batch's index lists."""
    lens = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    key, n = np.unique(np.repeat(np.arange(len(col)), lens) * num_features + flat, return_counts=True)
    return key // num_features, key % num_features, n.astype(float)


def _scores(row: np.ndarray, idx: np.ndarray, value: np.ndarray, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Class probabilities, rows x labels."""
    z = np.stack([np.bincount(row, weights=value * w[idx], minlength=n) + b for w, b in zip(weights, bias)], axis=1)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def compacted(table: DataFrame, idf: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(``_y``, ``_w``, ``_at``, ``_value``) of every row, written once, and the indices that occur at all.

    ``_at`` holds a row's distinct places among those indices, ``_value`` count times idf.
    """
    used = np.flatnonzero(np.isfinite(idf))
    place = np.zeros(len(idf), np.int32)
    place[used] = np.arange(len(used))
    shared = table.sparkSession.sparkContext.broadcast((place, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf = shared.value
        for batch in batches:
            row, idx, count = _entries(batch.column(2), len(idf))
            off = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(off, pa.array(place[idx])),
                                              pa.ListArray.from_arrays(off, pa.array(count * idf[idx]))], ["_y", "_w", "_at", "_value"])

    return cut_lineage(table.select("_y", "_w", "_idx").mapInArrow(run, "_y int, _w double, _at array<int>, _value array<double>")), used


def evaluate(table: DataFrame, points: Sequence[np.ndarray], smoothing: float) -> list[tuple[float, np.ndarray]]:
    """(sum of losses, gradient) of each point over a ``compacted`` table, in one scan.

    A point is labels x (used indices + 1), the bias last.
    """
    n_labels, num_features = points[0].shape[0], points[0].shape[1] - 1
    shared = table.sparkSession.sparkContext.broadcast(np.stack(points))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        grad, loss, seen = np.zeros_like(at), np.zeros(len(at)), False
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            seen = True
            y, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row = np.repeat(np.arange(n), batch.column(2).value_lengths().to_numpy())
            idx, value = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            target = np.full((n, n_labels), smoothing / n_labels)
            target[np.arange(n), y] += 1 - smoothing
            for m, point in enumerate(at):
                p = _scores(row, idx, value, n, point[:, :-1], point[:, -1])
                loss[m] -= (w[:, None] * target * np.log(np.maximum(p, 1e-300))).sum()
                off = (p - target) * w[:, None]
                grad[m, :, -1] += off.sum(axis=0)
                for k in range(n_labels):
                    grad[m, k, :-1] += np.bincount(idx, weights=value * off[row, k], minlength=num_features)
        if seen:
            parts = {-1: np.concatenate([loss, grad[:, :, -1].ravel()])}
            parts |= {lo // FEATURE_BLOCK: np.ascontiguousarray(grad[:, :, lo:min(lo + FEATURE_BLOCK, num_features)]) for lo in range(0, num_features, FEATURE_BLOCK)}
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([b.tobytes() for b in parts.values()], pa.binary())], ["block", "body"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(body)
                total[block] = total[block] + part if block in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([b.tobytes() for b in total.values()], pa.binary())], ["block", "body"])

    schema = "block int, body binary"
    rows = table.select("_y", "_w", "_at", "_value").mapInArrow(partial, schema).repartition("block").mapInArrow(summed, schema).collect()
    grad, loss = np.zeros((len(points), n_labels, num_features + 1)), np.zeros(len(points))
    for block, body in rows:
        part = np.frombuffer(body)
        if block < 0:
            loss += part[:len(points)]
            grad[:, :, -1] += part[len(points):].reshape(len(points), n_labels)
        else:
            lo = block * FEATURE_BLOCK
            hi = min(lo + FEATURE_BLOCK, num_features)
            grad[:, :, lo:hi] += part.reshape(len(points), n_labels, hi - lo)
    shared.unpersist()
    return list(zip(loss.tolist(), grad))


def lbfgs(start: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float]]:
    """Asks for (value, gradient) at the points it yields; returns the best point and its value."""
    x = start
    f, g = yield x
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        d, back = -g, []
        for s, y, rho in reversed(past):
            a = rho * (s * d).sum()
            back.append(a)
            d = d - a * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s * y).sum() / (y * y).sum())
        for (s, y, rho), a in zip(past, reversed(back)):
            d = d + s * (a - rho * (y * d).sum())
        slope = (g * d).sum()
        if slope > -1e-14:
            break
        step = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        for _ in range(25):
            f2, g2 = yield x + step * d
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, g2 - g
        if (s * y).sum() > 1e-12:
            past = [*past[-(HISTORY - 1):], (s, y, 1 / (s * y).sum())]
        done = f - f2 <= tol * max(abs(f), abs(f2), 1e-12)
        x, f, g = x + s, f2, g2
        if done:
            break
    return x, f


def fit_grid(train: DataFrame, labels: Sequence[str], label_col: str = "label", *, smoothing: float = 0.1, reg_grid: Sequence[float] = (0.0,),
             num_features: int = 1 << 18, max_iter: int = 50, tol: float = 1e-6, weight_col: str | None = None) -> list[TextModel]:
    """One model per penalty, from rows with ``_idx`` (``hashed_terms``).

    The objective is the mean cross-entropy to the smoothed targets plus half the penalty times the squared weights (the bias is free).
    Rows of other labels are left out.
    """
    names = F.array(*[F.lit(x) for x in labels])
    rows = train.where(F.col(label_col).isin(list(labels))).select(
        (F.array_position(names, F.col(label_col)) - 1).cast("int").alias("_y"), "_idx",
        (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("_w"))
    rows = cut_lineage(spread(rows))
    idf = inverse_frequencies(rows, num_features)
    table, used = compacted(rows, idf)
    n = table.agg(F.sum("_w")).first()[0] or 1.0
    k = len(labels)
    runs = [lbfgs(np.zeros((k, len(used) + 1)), max_iter, tol) for _ in reg_grid]
    asked, ended = {m: next(r) for m, r in enumerate(runs)}, {}
    while asked:
        order = list(asked)
        found = evaluate(table, [asked[m] for m in order], smoothing)
        for m, (loss, grad) in zip(order, found):
            free = asked[m].copy()
            free[:, -1] = 0
            try:
                asked[m] = runs[m].send((loss / n + reg_grid[m] / 2 * (free ** 2).sum(), grad / n + reg_grid[m] * free))
            except StopIteration as end:
                ended[m] = end.value
                del asked[m]
    models = []
    for m in range(len(runs)):
        point, loss = ended[m]
        weights = np.zeros((k, num_features))
        weights[:, used] = point[:, :-1] * idf[used]
        models.append(TextModel(list(labels), weights, point[:, -1].copy(), float(loss)))
    return models


def probabilities(df: DataFrame, model: TextModel, idx_col: str = "_idx", out: str = "_p") -> DataFrame:
    """All columns but ``idx_col``, and the class probabilities in the order of the model's labels."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    keep = [c for c in df.columns if c != idx_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            row, idx, count = _entries(batch.column(len(keep)), weights.shape[1])
            p = _scores(row, idx, count, len(batch), weights, bias)
            off = pa.array(np.arange(len(batch) + 1) * p.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(off, pa.array(p.ravel()))], [*keep, out])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select(*keep, idx_col).mapInArrow(run, schema)
