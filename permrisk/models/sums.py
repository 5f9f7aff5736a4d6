"""Sums over all rows of what a batch gives, for Newton's method on few parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.models.levels import matrix


def summed(rows: DataFrame, columns: list[str], of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of the vectors ``of(matrix)`` of all batches; each task adds up its own before they are shuffled."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["at", "x"])

    got = rows.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(size)
    for r in got.toLocalIterator():
        out[r["at"]] = r.x
    return out


def packed(x: np.ndarray) -> np.ndarray:
    """The upper triangles of x x' of every row."""
    a, b = np.triu_indices(x.shape[1])
    return x[:, a] * x[:, b]


def unpacked(v: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = v
    return out + np.triu(out, 1).T


def newton(start: np.ndarray, value: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], steps: int = 40, tolerance: float = 1e-8) -> np.ndarray:
    """The maximum of a smooth function of few parameters; ``value`` gives it with gradient and Hessian. Steps are at most two long and are halved while the value falls."""
    at, (now, gradient, hessian) = start, value(start)
    for _ in range(steps):
        down = -(hessian + hessian.T) / 2
        least = np.linalg.eigvalsh(down)[0]
        if least <= 1e-10:
            down = down + (1e-6 - least) * np.eye(len(at))
        step = np.clip(np.linalg.solve(down, gradient), -2.0, 2.0)
        for _ in range(30):
            then = value(at + step)
            if np.isfinite(then[0]) and then[0] >= now - 1e-12 * abs(now):
                break
            step = step / 2
        else:
            break
        at, (now, gradient, hessian) = at + step, then
        if np.abs(step).max() < tolerance:
            break
    return at
