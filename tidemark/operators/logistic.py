"""Logistic regression of many fits at a time, by Newton's method in shared passes over their rows.

L2 with C = 1 and balanced classes on columns scaled to mean 0 and population deviation 1; the intercept is free.
One pass counts gradients and curvatures of all fits. A step that doesn't lower a fit's loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.boosting import expand, matrix, squeeze

#: Passes at most, and the share of its loss that a fit's last step may still promise.
PASSES, ENOUGH = 100, 1e-12


def _blocks(rows: DataFrame, jobs: int, numbers: Column) -> DataFrame:
    """Rows with ``_jobs`` as blocks: labels, members of each fit, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, member = b.column(1), np.zeros((jobs, b.num_rows), bool)
            member[of.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b.num_rows), of.value_lengths().to_numpy(zero_copy_only=False))] = True
            label = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
            found = (label.tobytes(), np.packbits(member, axis=1).tobytes(), squeeze(matrix(b.column(2)).T))
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary()) for f in found], names=["label", "member", "x"])

    return rows.where(F.size("_jobs") > 0).select("label", "_jobs", numbers.alias("x")).mapInArrow(run, "label binary, member binary, x binary").persist()


def _each(batches: Iterator[pa.RecordBatch], jobs: int, features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fit, its labels, its rows' values) of every block."""
    for b in batches:
        for label, member, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
            label, x = np.frombuffer(label, np.uint8), expand(x, np.float64, features).T
            member = np.unpackbits(np.frombuffer(member, np.uint8).reshape(jobs, -1), axis=1, count=len(label)).astype(bool)
            for j in range(jobs):
                if member[j].any():
                    yield j, label[member[j]], x[member[j]]


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Rows, positives, means and squared deviations of two parts together."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[2] - a[2]
    return n, a[1] + b[1], a[2] + d * (b[0] / n), a[3] + b[3] + d * d * (a[0] * b[0] / n)


def _statistics(blocks: DataFrame, jobs: int, features: int) -> dict[int, tuple]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for j, label, x in _each(batches, jobs, features):
            mean = x.mean(axis=0)
            held[j] = _merged(held.get(j), (len(x), int(label.sum()), mean, ((x - mean) ** 2).sum(axis=0)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *[pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1)], *[pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (2, 3)]], names=["job", "n", "p", "mean", "m2"])

    found: dict[int, tuple] = {}
    for r in blocks.mapInArrow(run, "job int, n bigint, p bigint, mean binary, m2 binary").collect():  # two vectors a task and fit
        found[r.job] = _merged(found.get(r.job), (r.n, r.p, np.frombuffer(r.mean), np.frombuffer(r.m2)))
    return found


def _curvature(blocks: DataFrame, jobs: int, features: int, at: dict[int, tuple]) -> dict[int, np.ndarray]:
    """Of each fit in ``at`` (mean, scale, weights of both labels, coefficients): loss, gradient and curvature in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = features + 1
        held = {j: np.zeros(1 + width + width * width) for j in at}
        for j, label, x in _each(batches, jobs, features):
            if j not in at:
                continue
            mean, scale, weights, b = at[j]
            x = np.c_[(x - mean) / scale, np.ones(len(x))]
            z, w = x @ b, np.where(label == 1, weights[1], weights[0])
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            held[j][0] += w @ np.logaddexp(0, np.where(label == 1, -z, z))
            held[j][1 : 1 + width] += x.T @ (w * (p - label))
            held[j][1 + width :] += ((x.T * (w * p * (1 - p))) @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["job", "sums"])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"job": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sum(np.frombuffer(s.as_py()) for s in table["sums"]).tobytes()], pa.binary())})

    sums = blocks.mapInArrow(run, "job int, sums binary").groupBy("job").applyInArrow(total, "job int, sums binary")
    return {r.job: np.frombuffer(r.sums) for r in sums.collect()}  # one row a fit


def fit_logistic(rows: DataFrame, jobs: int, features: int, numbers: Column) -> dict[int, tuple]:
    """(mean, scale, coefficients) of each fit, the intercept last; None in place of coefficients: one class, whose label the mean is."""
    blocks = _blocks(rows, jobs, numbers)
    blocks.count()
    width, found, state, steps, loss = features + 1, {}, {}, {}, {}
    ridge = np.r_[np.ones(features), 0.0]
    for j, (n, p, mean, m2) in _statistics(blocks, jobs, features).items():
        if p in (0, n):
            found[j] = (float(p == n), None, None)
            continue
        scale = np.sqrt(m2 / n)
        state[j] = (mean, np.where(scale == 0, 1.0, scale), (n / (2 * (n - p)), n / (2 * p)), np.zeros(width))
        steps[j], loss[j] = None, np.inf
    open_ = set(state)
    for _ in range(PASSES):
        if not open_:
            break
        for j, sums in _curvature(blocks, jobs, features, {j: state[j] for j in open_}).items():
            mean, scale, weights, b = state[j]
            now = sums[0] + (ridge * b * b).sum() / 2
            if steps[j] is not None and not now <= loss[j] + 1e-9 * max(1.0, loss[j]):
                steps[j] = steps[j] / 2
                state[j] = (mean, scale, weights, b + steps[j])  # back by half of the way
                continue
            slope = sums[1 : 1 + width] + ridge * b
            step = np.linalg.solve(sums[1 + width :].reshape(width, width) + np.diag(ridge), slope)
            loss[j] = now
            if slope @ step <= ENOUGH * max(1.0, now):
                open_.discard(j)
                continue
            steps[j], state[j] = step, (mean, scale, weights, b - step)
    blocks.unpersist()
    return found | {j: (mean, scale, b) for j, (mean, scale, _, b) in state.items()}


def probabilities(fitted: dict[str | None, tuple], numbers: Column) -> Column:
    """Each row's score by the fit of its day, or by the only one (None)."""

    def run(days: pa.Array, rows: pa.Array) -> pa.Array:
        x, day, out = matrix(rows), days.to_numpy(zero_copy_only=False), np.full(len(rows), np.nan)
        for d, (mean, scale, b) in fitted.items():
            mine = np.ones(len(x), bool) if d is None else day == d
            out[mine] = mean if b is None else 1 / (1 + np.exp(-np.clip((x[mine] - mean) / scale @ b[:-1] + b[-1], -700, 700)))
        return pa.array(out)

    return F.arrow_udf(run, "double")("cutoff_date", numbers)
