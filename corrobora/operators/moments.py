"""Sufficient statistics: everything a test or a linear model needs from the raw table.

``covar_pop`` is Spark's one-pass, mergeable, centred update, so near-collinear columns keep
their digits without a second scan. One row per group leaves the table; the solve is on that row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalars import as_col
from ..functions.tails import f_sf, t_sf2


def group_moments(df: DataFrame, value: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, var, sum, min, max); var with ddof 1; NULL values are skipped."""
    v = as_col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.var_samp(v).alias("var"),
        F.sum(v).alias("sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def spread(value: Column | str, ddof: int) -> Column:
    """Standard deviation with the divisor stated: 0, 1, or any other n - ddof."""
    v = as_col(value)
    if ddof == 0:
        return F.stddev_pop(v)
    if ddof == 1:
        return F.stddev_samp(v)
    return F.sqrt(F.var_pop(v) * F.count(v) / (F.count(v) - ddof))


def gram(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, means[p+1], sscp[(p+1)^2]) of xs + [y], centred, over complete rows."""
    cols = [*xs, y]
    data = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    q = [f"`{c}`" for c in cols]
    # one expression text: the upper triangle is computed once, the lower refers to the same aggregate
    cells = [f"covar_pop({q[min(i, j)]}, {q[max(i, j)]}) * count(1)" for i in range(len(q)) for j in range(len(q))]
    return data.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.expr(f"array({', '.join(f'avg({c})' for c in q)})").alias("means"),
        F.expr(f"array({', '.join(cells)})").alias("sscp"),
    )


_ARRAYS = ("coef", "se", "t", "p", "xtx_inv", "centre")
_NUMBERS = ("rows", "r2", "adj_r2", "sse", "sigma2", "df_resid", "f", "f_p", "condition")
FIT_TYPE = StructType(
    [StructField(name, ArrayType(DoubleType())) for name in _ARRAYS]
    + [StructField(name, DoubleType()) for name in _NUMBERS]
)


def _solve_one(n: float, means: np.ndarray, sscp: np.ndarray, ridge: float) -> dict:
    size = len(means)
    p = size - 1
    full = np.asarray(sscp, dtype=float).reshape(size, size)
    sxx, sxy, syy = full[:p, :p], full[:p, p], full[p, p]
    scale = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    corr = sxx / np.outer(scale, scale)
    if ridge:
        # penalty acts on population-standardised predictors, as in the usual scaled fit
        inv = np.linalg.inv(corr + np.eye(p) * ridge / n)
    else:
        inv = np.linalg.pinv(corr, hermitian=True)
    slopes_std = inv @ (sxy / scale)
    slopes = slopes_std / scale
    inv_xx = inv / np.outer(scale, scale)
    mx = np.asarray(means[:p], dtype=float)
    intercept = means[p] - mx @ slopes
    sse = max(float(syy - 2 * slopes @ sxy + slopes @ sxx @ slopes), 0.0)
    df = n - p - 1
    xtx_inv = np.empty((size, size))
    xtx_inv[1:, 1:] = inv_xx
    xtx_inv[0, 1:] = xtx_inv[1:, 0] = -inv_xx @ mx
    xtx_inv[0, 0] = 1.0 / n + mx @ inv_xx @ mx
    coef = np.concatenate([[intercept], slopes])
    with np.errstate(all="ignore"):
        sigma2 = sse / df if df > 0 else np.nan
        se = np.sqrt(sigma2 * np.diag(xtx_inv))
        t = coef / se
        r2 = 1 - sse / syy if syy > 0 else np.nan
        adj = 1 - (1 - r2) * (n - 1) / df if df > 0 else np.nan
        f = (r2 / p) / ((1 - r2) / df) if p and df > 0 and r2 < 1 else np.nan
    return {
        "coef": coef, "se": se, "t": t, "p": t_sf2(t, float(df)), "r2": r2, "adj_r2": adj, "sse": sse,
        "sigma2": sigma2, "df_resid": float(df), "f": f, "f_p": float(f_sf(f, p, df)) if np.isfinite(f) else np.nan,
        "xtx_inv": xtx_inv.ravel(), "centre": mx, "rows": float(n), "condition": float(np.linalg.cond(corr)) if p else 1.0,
    }


@F.pandas_udf(FIT_TYPE)
def _solve(n: pd.Series, means: pd.Series, sscp: pd.Series, ridge: pd.Series) -> pd.DataFrame:
    rows = [
        _solve_one(float(count), np.asarray(mean, float), np.asarray(cells, float), float(penalty))
        for count, mean, cells, penalty in zip(n, means, sscp, ridge)
    ]
    return pd.DataFrame(rows, columns=[*_ARRAYS, *_NUMBERS])


def solve(gram_df: DataFrame, ridge: float = 0.0) -> DataFrame:
    """Add ``fit`` to a gram table: one small dense solve per group, spread over the groups."""
    return gram_df.withColumn("fit", _solve(F.col("n").cast("double"), "means", "sscp", F.lit(float(ridge))))


def fit_linear(
    df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), ridge: float = 0.0
) -> DataFrame:
    """(by..., n, fit) of y ~ 1 + xs by least squares (or ridge)."""
    return solve(gram(df, xs, y, by), ridge).drop("means", "sscp")


def coefficient_table(fits: DataFrame, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form: (by..., term, coef, se, t, p)."""
    names = F.array(*[F.lit(x) for x in ["const", *xs]])
    zipped = F.arrays_zip(
        names.alias("term"),
        F.col("fit.coef").alias("coef"),
        F.col("fit.se").alias("se"),
        F.col("fit.t").alias("t"),
        F.col("fit.p").alias("p"),
    )
    return fits.select(*by, F.explode(zipped).alias("_c")).select(
        *by, *[F.col("_c").getField(f).alias(f) for f in ("term", "coef", "se", "t", "p")]
    )


def predicted(xs: Sequence[str], coef: Column) -> Column:
    """b0 + sum b_i x_i with ``coef`` an array column (scalar subquery or joined)."""
    out = F.element_at(coef, 1)
    for i, x in enumerate(xs):
        out = out + F.element_at(coef, i + 2) * F.col(x).cast("double")
    return out


def attach_fit(df: DataFrame, fits: DataFrame, by: Sequence[str] = (), name: str = "_fit") -> DataFrame:
    """Fit of each row's group next to the row: a scalar subquery, or an equi-join when grouped."""
    if not by:
        return df.withColumn(name, fits.select("fit").scalar())
    return df.join(fits.select(*by, F.col("fit").alias(name)), list(by))


def beside(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary rows of the same groups next to each other.

    Without groups both sides are one row and meet on a key that is the same for all. (A scalar
    subquery would do for plain expressions, but must not become the input of a Python function.)
    """
    if by:
        return left.join(right, list(by))
    key = lambda df: df.withColumn("_one", F.pmod(F.hash(df.columns[0]), F.lit(1)))
    return key(left).join(key(right), "_one").drop("_one")
