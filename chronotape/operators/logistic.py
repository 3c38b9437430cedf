"""Many logistic fits at once: Newton steps on Gram matrices that one pass over the rows adds up for all of them.

A fit is a set of feature columns, a strength and a fold that it leaves out. A task adds up gradient, Hessian and
loss of every fit over its rows; these are matrices of the size of the features, whatever the number of rows, and
are added up over the tasks in a tree. The driver solves the steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task multiplies at a time.
CHUNK_ROWS = 4096
#: Partial sums that one task of the tree adds up.
FAN_IN = 32
MOST_STEPS = 100
TOLERANCE = 1e-9
LEAST_GAIN = 1e-15


@dataclass
class Fit:
    """One model: `columns` are places in the feature array, `fold` is left out (-1: none)."""

    name: str
    columns: tuple[int, ...]
    strength: float
    fold: int
    weights: np.ndarray = field(default=None, repr=False)
    loss: float = float("nan")

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x[:, list(self.columns)] @ self.weights[:-1] + self.weights[-1]


def matrix(batch: pa.RecordBatch | pa.Table, column: str = "features") -> np.ndarray:
    lists = batch.column(column)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]) if isinstance(lists, pa.ChunkedArray) else lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(float)


def chance(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -700, 700)))


def losses(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """-ln of the chance of the label."""
    return np.logaddexp(0, np.where(y == 1, -margins, margins))


def summed(rows: DataFrame, measure) -> np.ndarray | None:
    """The sum over all rows of measure(features, y, fold), an array of floats; none without rows.

    Each task adds up its rows, then FAN_IN partial sums meet in a task until one is left.
    """

    def own(batches):
        total = None
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(begin, CHUNK_ROWS)
                found = measure(matrix(some), some.column("y").to_numpy().astype(int), some.column("fold").to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    def add(batches):
        total = None
        for batch in batches:
            for part in batch.column(0):
                found = np.frombuffer(part.as_buffer())
                total = found.copy() if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("features", "y", "fold").mapInArrow(own, "part binary")
    count = rows.rdd.getNumPartitions()
    while count > 1:
        count = -(-count // FAN_IN)
        parts = parts.repartition(count).mapInArrow(add, "part binary")
    one = parts.first()
    return None if one is None else np.frombuffer(one["part"])


def fit_all(rows: DataFrame, sets: dict[str, Sequence[int]], strengths: Sequence[float], folds: int) -> list[Fit]:
    """Logistic regressions of y on every set of columns, for every strength, without each fold and on all rows.

    `rows` has features (array<double>, no gaps), y (0/1) and fold (0 to folds - 1). Each fit minimises the mean
    log-loss plus |w|^2 / (2 * strength * rows) over columns scaled to mean 0 and deviation 1 in its own rows,
    without a penalty on the constant; a column without spread has weight 0. The loss of a fit is the mean over
    the rows of its fold. Weights are returned for the columns as they come, the constant last.
    """
    moments = summed(rows, lambda x, y, fold: _moments(x, y, fold, folds))
    if moments is None:
        return []
    by_fold = moments.reshape(folds, -1)
    width = (by_fold.shape[1] - 2) // 2
    count, ones = by_fold[:, 0], by_fold[:, 1]
    mean = by_fold[:, 2 : 2 + width].sum(axis=0) / count.sum()
    # Second moments around the common mean, so that large means lose nothing.
    spread = summed(rows, lambda x, y, fold: _moments(x - mean, y, fold, folds)).reshape(folds, -1)
    sums, squares = spread[:, 2 : 2 + width], spread[:, 2 + width :]
    scale = np.sqrt(squares.sum(axis=0) / max(1.0, count.sum() - 1))
    scale = np.where(scale > 1e-12 * np.maximum(1, np.abs(mean)), scale, 0.0)
    inverse = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)
    left = [np.arange(folds) != k for k in range(folds)] + [np.ones(folds, bool)]
    fits = [Fit(name, tuple(columns), s, k if k < folds else -1) for name, columns in sets.items() for s in strengths for k in range(folds + 1)]
    size, penalty = [], []
    for f in fits:
        inside, at = left[f.fold], list(f.columns)
        n = count[inside].sum()
        # Deviation in the rows of the fit, in units of the common scale.
        own = (squares[inside].sum(axis=0) - sums[inside].sum(axis=0) ** 2 / max(1.0, n)) / max(1.0, n - 1)
        own = np.sqrt(np.maximum(0, own))[at] * inverse[at]
        size.append(n)
        penalty.append(np.where(own > 1e-9, own**2 / (f.strength * max(1.0, n)), np.inf))
        share = np.clip(ones[inside].sum() / max(1.0, n), 1e-6, 1 - 1e-6)
        f.weights = np.append(np.zeros(len(at)), np.log(share / (1 - share)))
    _newton(rows, fits, size, penalty, mean, inverse)
    for f in fits:
        at = list(f.columns)
        slopes = f.weights[:-1] * inverse[at]
        f.weights = np.append(slopes, f.weights[-1] - slopes @ mean[at])
    held = summed(rows, lambda x, y, fold: np.array([losses(f.margins(x), y)[fold == f.fold].sum() for f in fits]))
    for f, total in zip(fits, held, strict=True):
        f.loss = total / count[f.fold] if f.fold >= 0 and count[f.fold] else float("nan")
    return fits


def _moments(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int) -> np.ndarray:
    out = np.zeros((folds, 2 + 2 * x.shape[1]))
    for k in range(folds):
        mine = x[fold == k]
        out[k] = np.concatenate([[len(mine), (y[fold == k] == 1).sum()], mine.sum(axis=0), np.square(mine).sum(axis=0)])
    return out.ravel()


def _newton(rows: DataFrame, fits: list[Fit], size: list[float], penalty: list[np.ndarray], mean: np.ndarray, inverse: np.ndarray) -> None:
    """Newton steps of all fits that have not converged, one pass a step; a step that does not lower the loss is halved."""
    going = list(range(len(fits)))
    before = {i: (np.inf, fits[i].weights) for i in going}

    for _ in range(MOST_STEPS):
        if not going:
            return
        now = [(fits[i].columns, fits[i].fold, fits[i].weights) for i in going]

        def measure(x, y, fold, now=now):
            z = (x - mean) * inverse
            out, last, design = [], None, None
            for columns, leave, weights in now:
                if columns != last:
                    last, design = columns, np.hstack([z[:, list(columns)], np.ones((len(z), 1))])
                inside = fold != leave
                margins = design @ weights
                p = np.where(inside, chance(margins), 0.0)
                gradient = design.T @ (p - np.where(inside, y, 0))
                curved = (design * (p * (1 - p))[:, None]).T @ design
                out += [[losses(margins, y)[inside].sum()], gradient, curved.ravel()]
            return np.concatenate(out)

        total, at, still = summed(rows, measure), 0, []
        for i in going:
            f, n, free = fits[i], max(1.0, size[i]), np.isfinite(penalty[i])
            d = len(f.weights)
            loss, gradient, curved = total[at], total[at + 1 : at + 1 + d], total[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
            at += 1 + d + d * d
            ridge = np.append(np.where(free, penalty[i], 0.0), 0.0)
            loss = loss / n + 0.5 * float(ridge @ np.square(f.weights))
            old_loss, old = before[i]
            if loss > old_loss + 1e-12:
                f.weights = (f.weights + old) / 2
                if np.abs(f.weights - old).max() > TOLERANCE:
                    still.append(i)
                continue
            before[i] = (loss, f.weights)
            use = np.append(free, True)
            slope = (gradient / n + ridge * f.weights)[use]
            bend = (curved / n + np.diag(ridge))[np.ix_(use, use)] + 1e-12 * np.eye(int(use.sum()))
            step = np.zeros(d)
            step[use] = np.linalg.solve(bend, slope)
            f.weights = f.weights - step
            # Where the loss is flat, steps need not shrink: what counts is by how much they lower the loss.
            if np.abs(step).max() > TOLERANCE and slope @ step[use] > LEAST_GAIN:
                still.append(i)
        going = still


def scores(rows: DataFrame, fits: Sequence[Fit], *columns: str, out_of_fold: bool = False) -> DataFrame:
    """name, `columns`, y and score of the rows under each fit; `out_of_fold` scores only the fold that a fit left out."""
    kept = [*columns, "y"]

    def run(batches):
        for batch in batches:
            x = matrix(batch)
            for f in fits:
                mine = batch
                score = chance(f.margins(x)) if batch.num_rows else np.zeros(0)
                if out_of_fold:
                    inside = batch.column("fold").to_numpy() == f.fold
                    mine, score = batch.filter(pa.array(inside)), score[inside]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.name] * mine.num_rows, pa.string()), *[mine.column(c) for c in kept], pa.array(score)], names=["name", *kept, "score"]
                )

    schema = rows.select(F.lit("").alias("name"), *kept, F.lit(0.0).alias("score")).schema
    return rows.select(*kept, "features", *(["fold"] if out_of_fold else [])).mapInArrow(run, schema)


def best_strengths(fits: Sequence[Fit]) -> dict[str, float]:
    """Of every set of columns the strength with the lowest mean loss over the folds, the lowest of equals."""
    found: dict[str, dict[float, list[float]]] = {}
    for f in fits:
        if f.fold >= 0:
            found.setdefault(f.name, {}).setdefault(f.strength, []).append(f.loss)
    return {name: min(by, key=lambda s: (np.nanmean(by[s]), s)) for name, by in found.items()}
