"""Logistic regression by Newton steps: one pass over the rows per step, a small solve between them.

Every task reduces its rows to one gradient and one curvature matrix, so what is shuffled and sent to the driver is
fixed by the number of terms and not by the rows. A fitted model is plain numbers: scoring is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .features import class_weights

#: Levels of one nominal column; the curvature matrix has a row and a column for each.
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Logit:
    """Intercept, one coefficient per numeric column and per level seen in training."""

    numeric: tuple[str, ...]
    levels: Mapping[str, tuple[str, ...]]
    coef: tuple[float, ...]
    steps: int
    change: float

    @property
    def terms(self) -> list[str]:
        return ["const", *self.numeric, *(f"{c}_{v}" for c, values in self.levels.items() for v in values)]

    def linear(self) -> Column:
        """Linear predictor; a level not seen in training (or a null one) adds nothing, a null number makes it null."""
        out, at = F.lit(self.coef[0]), 1
        for c in self.numeric:
            out = out + F.lit(self.coef[at]) * F.col(c).cast("double")
            at += 1
        for c, values in self.levels.items():
            if values:
                table = F.create_map(*[F.lit(x) for pair in zip(values, self.coef[at : at + len(values)]) for x in pair])
                out = out + F.coalesce(F.try_element_at(table, F.col(c).cast("string")), F.lit(0.0))
                at += len(values)
        return out

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., prediction, score): probability of class 1, and 1 where it exceeds one half."""
        score = 1 / (1 + F.exp(-self.linear()))
        return df.select(*keep, (score > 0.5).cast("double").alias("prediction"), score.alias("score"))


def levels_seen(train: DataFrame, column: str) -> tuple[str, ...]:
    """The distinct values in order; ValueError where one-hot columns would be too many."""
    found = train.select(F.col(column).cast("string").alias("v")).dropna().distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels: pool rare ones first")
    return tuple(sorted(r["v"] for r in found))


def _sums(rows: DataFrame, numeric: Sequence[str], levels: Mapping[str, tuple[str, ...]], coef: np.ndarray) -> np.ndarray:
    """Curvature and gradient of the weighted log likelihood, side by side: size x (size + 1)."""
    size = len(coef)

    def reduce(frames: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        total = np.zeros((size, size + 1))
        for frame in frames:
            x = np.zeros((frame.num_rows, size))
            x[:, 0] = 1
            for j, c in enumerate(numeric, 1):
                x[:, j] = frame.column(c).to_numpy(zero_copy_only=False)
            at = 1 + len(numeric)
            for c, values in levels.items():
                place = pc.fill_null(pc.index_in(frame.column(c), pa.array(values, pa.string())), -1).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(place >= 0)
                x[known, at + place[known]] = 1
                at += len(values)
            y, w = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w"))
            p = 1 / (1 + np.exp(-(x @ coef)))
            total[:, :size] += (x * (w * p * (1 - p))[:, None]).T @ x
            total[:, size] += x.T @ (w * (y - p))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    # a task's matrix is shuffled cell by cell, so no task adds up all matrices
    cells = rows.mapInArrow(reduce, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(size * (size + 1))
    for r in cells.collect():
        out[r["cell"]] = r["v"]
    return out.reshape(size, size + 1)


def fit_logistic(
    train: DataFrame, label: str, numeric: Sequence[str], nominal: Sequence[str] = (), balanced: bool = False, penalty: float = 1.0,
    steps: int = 25, tol: float = 1e-9,
) -> Logit:
    """L2-regularised fit (``penalty`` / 2 times the squared slopes, added to the summed loss; the intercept is free).

    ``balanced`` weighs every class alike. Rows with a null label or number are left out; a null level is none of the
    levels. Steps end when no coefficient moves by more than ``tol``. No rows (or one class) leave a flat start or drift
    only as far as the penalty lets them; the model says how many steps were made and how far the last one went.
    """
    rows = train.dropna(subset=[label, *numeric])
    weighted = class_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0))
    data = staged(
        weighted.select(
            *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in nominal],
            F.col(label).cast("double").alias("_y"), F.col("weight").cast("double").alias("_w"),
        )
    )
    levels = {c: levels_seen(data, c) for c in nominal}
    size = 1 + len(numeric) + sum(map(len, levels.values()))
    ridge = np.full(size, float(penalty))
    ridge[0] = 0.0
    coef, change, made = np.zeros(size), np.inf, 0
    while made < steps and change > tol:
        found = _sums(data, numeric, levels, coef)
        # the pseudo-inverse answers for no rows and for an intercept that the levels already span
        move = np.linalg.pinv(found[:, :size] + np.diag(ridge), hermitian=True) @ (found[:, size] - ridge * coef)
        coef, change, made = coef + move, float(np.abs(move).max()), made + 1
    return Logit(tuple(numeric), levels, tuple(coef.tolist()), made, change)
