"""Linear models with the diagnostics that show whether to believe them.

Each operator reads the table once for the Gram statistics and, where residuals are needed, once
more with the coefficients as literals of a scalar subquery. Only summary rows are solved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.draws import POISSON_STEPS_32, Digests
from ..functions.scalars import hash_order
from ..functions.tails import chi2_pvalue, t_pvalue, t_sf2
from ..session import parallelism, staged
from .moments import attach_fit, beside, coefficient_table, fit_linear, gram, predicted, solve
from .scan import lagged, previous, with_halo, with_row_index

FIT_COLUMNS = ("r2", "adj_r2", "sse", "sigma2", "df_resid", "f", "f_p", "condition")


def ols(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient table: (by..., term, coef, se, t, p)."""
    return coefficient_table(fit_linear(df, xs, y, by), xs, by)


def fit_summary(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: n, number of predictors, r2, adjusted r2 and the gap between them."""
    fits = fit_linear(df, xs, y, by)
    out = fits.select(*by, "n", F.lit(len(xs)).alias("predictors"), *[F.col(f"fit.{c}") for c in FIT_COLUMNS])
    return out.withColumn("overfit_gap", F.col("r2") - F.col("adj_r2")).withColumn(
        "rows_per_predictor", F.col("n") / F.col("predictors")
    )


def significant_terms(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mark significant terms of a coefficient table; the constant never counts."""
    return table.withColumn("significant", (F.col("p") < alpha) & (F.col("term") != "const"))


def sub_gram(gram_df: DataFrame, keep: Sequence[int], size: int) -> DataFrame:
    """Gram statistics of a subset of the columns, from the statistics already at hand."""
    return gram_df.withColumns(
        {
            "means": F.array(*[F.col("means")[i] for i in keep]),
            "sscp": F.array(*[F.col("sscp")[i * size + j] for i in keep for j in keep]),
        }
    )


def naive_vs_controlled(df: DataFrame, x: str, controls: Sequence[str], y: str) -> DataFrame:
    """Effect of x alone and with controls: two solves of one pass over the table."""
    xs = [x, *controls]
    size = len(xs) + 1
    full = gram(df, xs, y)
    naive = coefficient_table(solve(sub_gram(full, [0, size - 1], size)), [x]).filter(F.col("term") == x)
    controlled = coefficient_table(solve(full), xs).filter(F.col("term") == x)
    both = naive.withColumn("model", F.lit("naive")).unionByName(controlled.withColumn("model", F.lit("controlled")))
    return both.select("model", "term", "coef", "se", "t", "p")


def partial_correlation(df: DataFrame, x: str, y: str, controls: Sequence[str]) -> DataFrame:
    """Correlation of x and y, plain and with the controls held fixed (from the t of x)."""
    xs = [x, *controls]
    size = len(xs) + 1
    full = gram(df, xs, y)
    marginal = F.col("sscp")[size - 1] / F.sqrt(F.col("sscp")[0] * F.col("sscp")[size * size - 1])
    t = F.col("fit.t")[1]
    return solve(full).select(
        "n", marginal.alias("marginal"), (t / F.sqrt(t * t + F.col("fit.df_resid"))).alias("partial")
    )


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation per predictor: diagonal of the inverse correlation matrix."""
    xs = list(xs)
    size = len(xs)
    fit = solve(gram(df.withColumn("_zero", F.lit(0.0)), xs, "_zero"))
    rows = F.array(
        *[
            F.struct(
                F.lit(x).alias("term"),
                (F.col("sscp")[i * (size + 1) + i] * F.col("fit.xtx_inv")[(i + 1) * (size + 1) + i + 1]).alias("vif"),
            )
            for i, x in enumerate(xs)
        ]
    )
    return fit.select(F.explode(rows).alias("r")).select("r.*")


def ridge(df: DataFrame, xs: Sequence[str], y: str, alpha: float) -> DataFrame:
    """(term, coef, coef_std): ridge on population-standardised predictors, intercept unpenalised."""
    size = len(xs) + 1
    g = solve(gram(df, xs, y), ridge=alpha)
    rows = [F.struct(F.lit("const").alias("term"), F.col("fit.coef")[0].alias("coef"), F.lit(None).cast("double").alias("coef_std"))]
    for i, x in enumerate(xs):
        sd = F.sqrt(F.col("sscp")[i * size + i] / F.col("n"))
        c = F.col("fit.coef")[i + 1]
        rows.append(F.struct(F.lit(x).alias("term"), c.alias("coef"), (c * sd).alias("coef_std")))
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def residuals(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), fits: DataFrame | None = None, out: str = "resid") -> DataFrame:
    """Rows with their residual; ``_fit`` stays for operators that need more of the model."""
    fits = fits if fits is not None else fit_linear(df, xs, y, by)
    rows = attach_fit(df.dropna(subset=[*xs, y]), fits, by)
    return rows.withColumn(out, F.col(y) - predicted(xs, F.col("_fit.coef")))


def breusch_pagan(df: DataFrame, xs: Sequence[str], y: str, ridge_alpha: float = 0.0) -> DataFrame:
    """Lagrange-multiplier test of constant residual variance."""
    fits = fit_linear(df, xs, y, ridge=ridge_alpha)
    rows = residuals(df, xs, y, fits=fits).withColumn("_e2", F.col("resid") * F.col("resid"))
    aux = fit_linear(rows, xs, "_e2")
    out = aux.select("n", (F.col("n") * F.col("fit.r2")).alias("lm"), F.col("fit.f").alias("f"), F.col("fit.f_p").alias("f_p"))
    return out.withColumn("p", chi2_pvalue(F.col("lm"), len(xs)))


def cooks_distance(df: DataFrame, xs: Sequence[str], y: str, fits: DataFrame | None = None) -> DataFrame:
    """Rows with leverage and Cook's distance, evaluated as row expressions."""
    size = len(xs) + 1
    fits = fits if fits is not None else fit_linear(df, xs, y)
    rows = df.dropna(subset=[*xs, y]).withColumn("_m", fits.select("fit").scalar())
    resid = F.col(y) - predicted(xs, F.col("_m.coef"))
    z: list[Column] = [F.col(x).cast("double") - F.col("_m.centre")[i] for i, x in enumerate(xs)]
    inv = F.col("_m.xtx_inv")
    leverage = 1 / F.col("_m.rows")
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            leverage = leverage + (1 if i == j else 2) * inv[(i + 1) * size + j + 1] * z[i] * z[j]
    rows = rows.withColumns({"resid": resid, "leverage": leverage})
    open_part = 1 - F.col("leverage")
    d = F.col("resid") * F.col("resid") / (size * F.col("_m.sigma2")) * F.col("leverage") / (open_part * open_part)
    return rows.withColumns({"cooks_d": d, "_n": F.col("_m.rows")}).drop("_m")


def influence_refit(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Coefficients on all rows and without rows of Cook's distance above 4/n."""
    first = fit_linear(df, xs, y)
    kept = cooks_distance(df, xs, y, first).filter(F.col("cooks_d") <= 4 / F.col("_n"))
    second = fit_linear(kept, xs, y)

    def table(fits: DataFrame, label: str) -> DataFrame:
        return coefficient_table(fits, xs, ["n"]).withColumn("model", F.lit(label))

    return table(first, "all").unionByName(table(second, "without_influential"))


# ---- ordered residuals --------------------------------------------------------------------

def _ordered_residuals(
    df: DataFrame, fits: DataFrame, xs: Sequence[str], y: str, order: Sequence[str], by: Sequence[str], n_buckets: int | None
) -> DataFrame:
    rows = df.select(*dict.fromkeys([*by, *order, *xs, y])).dropna(subset=[*xs, y])
    placed = with_row_index(rows, order, by, n_buckets=n_buckets)
    return residuals(placed, xs, y, by, fits)


def durbin_watson(
    df: DataFrame, xs: Sequence[str], y: str, order: Sequence[str], by: Sequence[str] = (), n_buckets: int | None = None
) -> DataFrame:
    """(by..., n, dw): near 2 without serial correlation, near 0 with strong positive one."""
    rows = residuals(df.select(*dict.fromkeys([*by, *order, *xs, y])), xs, y, by, fit_linear(df, xs, y, by))
    e = previous(rows.drop("_fit"), {"_prev": "resid"}, order, by, n_buckets)
    step = F.col("resid") - F.col("_prev")
    return e.groupBy(*by).agg(
        F.count("*").alias("n"), (F.sum(step * step) / F.sum(F.col("resid") * F.col("resid"))).alias("dw")
    )


_HAC_TYPE = StructType(
    [StructField(n, ArrayType(DoubleType())) for n in ("coef", "se_ols", "p_ols", "se", "t", "p")]
)


@F.pandas_udf(_HAC_TYPE)
def _sandwich(meat: pd.Series, fit: pd.DataFrame) -> pd.DataFrame:
    out = []
    for i in range(len(meat)):
        f = fit.iloc[i]
        coef = np.asarray(f["coef"], float)
        k = len(coef)
        # scores are centred, so the bread is block-diagonal; the last step restores the intercept
        bread = np.asarray(f["xtx_inv"], float).reshape(k, k).copy()
        bread[0, :] = bread[:, 0] = 0.0
        bread[0, 0] = 1.0 / f["rows"]
        back = np.eye(k)
        back[0, 1:] = -np.asarray(f["centre"], float)
        cov = back @ bread @ np.asarray(meat.iloc[i], float).reshape(k, k) @ bread @ back.T
        se = np.sqrt(np.diag(cov))
        t = coef / se
        out.append((coef, f["se"], f["p"], se, t, t_sf2(t, f["df_resid"])))
    return pd.DataFrame(out, columns=["coef", "se_ols", "p_ols", "se", "t", "p"])


_STRETCH = 1 << 40


def newey_west(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    order: Sequence[str],
    by: Sequence[str] = (),
    max_lags: int | None = None,
    chunk_rows: int | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Coefficients with plain and autocorrelation-robust errors (Bartlett kernel, L = ceil(n^(1/4)) of each series).

    With linear kernel weights the whole lag sum of a row is two moving sums (of u and of s*u), so
    the number of columns does not grow with the number of lags. A series' own lag is the width of one frame of fixed
    range over positions that are stretched by it.
    """
    size = len(xs) + 1
    fits = fit_linear(df, xs, y, by)
    longest = fits.agg(F.max("fit.rows")).first()[0] or 1
    reach = max_lags if max_lags is not None else math.ceil(longest**0.25)
    if chunk_rows is None:
        # as many chunks as tasks, each much longer than the copies at its edges
        chunk_rows = min(1 << 20, max(64 * reach, math.ceil(longest / parallelism(df.sparkSession))))
    chunk_rows = max(chunk_rows, reach)
    rows = _ordered_residuals(df, fits, xs, y, order, by, n_buckets)
    rows = rows.withColumn("_lags", F.ceil(F.pow("_fit.rows", F.lit(0.25))) if max_lags is None else F.lit(max_lags).cast("bigint"))
    placed = with_halo(rows, "_idx", before=reach, chunk_rows=chunk_rows)
    # position inside the chunk keeps the weights exact far into a long series
    pos = (F.col("_idx") - F.col("_chunk") * chunk_rows).cast("double")
    scores = {"_u0": F.col("resid")}
    for i, x in enumerate(xs):
        scores[f"_u{i + 1}"] = (F.col(x).cast("double") - F.col("_fit.centre")[i]) * F.col("resid")
    # the _lags rows before a row, and no other, are at most _STRETCH away
    stretched = (F.col("_idx") - F.col("_chunk") * chunk_rows) * F.floor(F.lit(_STRETCH) / F.col("_lags"))
    placed = placed.withColumns({"_pos": pos, "_place": stretched}).withColumns(scores)
    frame = Window.partitionBy(*by, "_chunk").orderBy("_place").rangeBetween(-_STRETCH, -1)
    moving, lags = {}, F.col("_lags")
    for i in range(size):
        a, b = F.sum(f"_u{i}").over(frame), F.sum(F.col("_pos") * F.col(f"_u{i}")).over(frame)
        moving[f"_q{i}"] = F.coalesce(a * (1 - F.col("_pos") / (lags + 1)) + b / (lags + 1), F.lit(0.0))
    lagsum = placed.withColumns(moving).filter(~F.col("_halo"))
    u, q = (lambda i: F.col(f"_u{i}")), (lambda i: F.col(f"_q{i}"))
    cells = {
        (i, j): F.sum(u(i) * u(j) + u(i) * q(j) + q(i) * u(j)) for i in range(size) for j in range(i, size)
    }
    meat = lagsum.groupBy(*by).agg(
        F.array(*[cells[min(i, j), max(i, j)] for i in range(size) for j in range(size)]).alias("meat"), F.max("_lags").cast("int").alias("max_lags")
    )
    joined = beside(meat, fits.select(*by, F.col("fit").alias("_fit")), by)
    solved = joined.withColumn("_h", _sandwich("meat", "_fit"))
    names = F.array(*[F.lit(x) for x in ["const", *xs]])
    cols = [f.name for f in _HAC_TYPE.fields]
    zipped = F.arrays_zip(names.alias("term"), *[F.col(f"_h.{c}").alias(c) for c in cols])
    return solved.select(*by, "max_lags", F.explode(zipped).alias("r")).select(
        *by, *[F.col("r").getField(c).alias(c) for c in ["term", *cols]], "max_lags"
    )


def differences(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (), n_buckets: int | None = None
) -> DataFrame:
    """First differences ``d_<c>``; the first row of each series is left out."""
    rows = df.select(*dict.fromkeys([*by, *order, *columns])).withColumn("_any", F.lit(True))
    prev = previous(rows, {"_seen": "_any", **{f"_p_{c}": c for c in columns}}, order, by, n_buckets)
    out = prev.filter(F.col("_seen")).withColumns({f"d_{c}": F.col(c) - F.col(f"_p_{c}") for c in columns})
    return out.drop("_any", "_seen", *[f"_p_{c}" for c in columns])


def difference_regression(df: DataFrame, x: str, y: str, order: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """The same regression on levels and on first differences."""
    levels = fit_linear(df, [x], y).withColumn("model", F.lit("levels"))
    changes = fit_linear(differences(df, [x, y], order, (), n_buckets), [f"d_{x}"], f"d_{y}").withColumn("model", F.lit("differences"))
    both = levels.unionByName(changes)
    return both.select(
        "model", "n", F.col("fit.coef")[1].alias("coef"), F.col("fit.se")[1].alias("se"),
        F.col("fit.p")[1].alias("p"), F.col("fit.r2").alias("r2"),
    )


# MacKinnon (1994) response surface for the constant-only unit-root statistic; fixed values.
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_TAU_SMALL = [2.1659, 1.4412, 0.038269]
_TAU_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]

_ADF_TYPE = StructType(
    [StructField("statistic", DoubleType()), StructField("p", DoubleType()), StructField("used_lag", LongType()), StructField("n_obs", LongType()), StructField("reason", StringType())]
)


def _adf_row(n: float, means: np.ndarray, sscp: np.ndarray, head: np.ndarray, lags: int) -> tuple:
    """Choose the lag order by AIC on the common sample, then refit on that order's own sample.

    The statistics may have room for more lags than the series' own ``lags``; a series that cannot be tested gets a reason.
    """
    none = (None, None, None, None)
    if lags < 0 or not n > 3:
        return (*none, "too short")
    size = len(means)  # level, d_1 .. d_L, d_0
    own = [*range(lags + 1), size - 1]
    s, means = sscp.reshape(size, size)[np.ix_(own, own)], means[own]
    if not s[0, 0] > 0 or not s[-1, -1] > 0:
        return (*none, "flat")

    def ols_t(count, mean, cells, order):
        keep = list(range(order + 1))
        sxx = cells[np.ix_(keep, keep)]
        sxy = cells[keep, -1]
        scale = np.sqrt(np.diag(sxx))
        dof = count - order - 2
        if dof <= 0 or not (scale > 0).all():
            return None
        inv = np.linalg.pinv(sxx / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
        b = inv @ sxy
        sse = float(cells[-1, -1] - b @ sxy)
        if not sse > 1e-12 * cells[-1, -1]:
            return None
        return b[0] / math.sqrt(sse / dof * inv[0, 0]), sse

    aics = {}
    for order in range(lags + 1):
        fit = ols_t(n, means, s, order)
        if fit:
            aics[order] = n * (math.log(2 * math.pi) + math.log(fit[1] / n) + 1) + 2 * (order + 2)
    if not aics:
        return (*none, "exact fit")
    best = min(aics, key=lambda q: (aics[q], q))
    extra = lags - best
    if extra > 0:
        # rows the common sample gave up: differences number best+1 .. lags of the series head
        d = np.diff(head)
        rows = []
        for t in range(best, lags):
            past = [d[t - l] if t - l >= 0 else 0.0 for l in range(1, lags + 1)]
            rows.append([head[t], *past, d[t]])
        block = np.asarray(rows)
        m2 = block.mean(axis=0)
        s2 = (block - m2).T @ (block - m2)
        total = n + extra
        gap = m2 - means
        s = s + s2 + np.outer(gap, gap) * n * extra / total
        means, n = (means * n + m2 * extra) / total, total
    fit = ols_t(n, means, s, best)
    if not fit:
        return (*none, "exact fit")
    stat = fit[0]
    if stat > _TAU_MAX:
        p = 1.0
    elif stat < _TAU_MIN:
        p = 0.0
    else:
        poly = _TAU_SMALL if stat <= _TAU_STAR else _TAU_LARGE
        z = float(np.polyval(poly[::-1], stat))
        p = 0.5 * math.erfc(-z / math.sqrt(2))
    return stat, p, best, int(n), None


@F.pandas_udf(_ADF_TYPE)
def _adf(n: pd.Series, means: pd.Series, sscp: pd.Series, head: pd.Series, lags: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None, None, None, "too short") if b is None or d is None or pd.isna(a)
        else _adf_row(float(a), np.asarray(b, float), np.asarray(c, float), np.asarray(d, float), int(e))
        for a, b, c, d, e in zip(n, means, sscp, head, lags)
    ]
    out = pd.DataFrame(rows, columns=["statistic", "p", "used_lag", "n_obs", "reason"])
    return out.astype({"used_lag": "Int64", "n_obs": "Int64"})


def adf(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    by: Sequence[str] = (),
    max_lag: int | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Unit-root test with a constant; lag order by AIC up to ceil(12 (n/100)^(1/4)), each series by its own length.

    One pass yields the Gram statistics of level and lagged differences plus the first values of the series; order choice and
    refit happen on that one row per series. Every series has a row: one that is too short, flat or fitted exactly
    has null results and a reason.
    """
    rows = df.select(*dict.fromkeys([*by, *order, value])).filter(F.col(value).isNotNull())
    n = F.col("_n")
    rule = F.ceil(12 * F.pow(n / 100, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    lags = F.least(rule, F.floor(n / 2) - 2).cast("int")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_lags", lags)
    max_lag = max(0, sizes.agg(F.max("_lags")).first()[0] or 0)
    placed = with_row_index(rows, order, by, n_buckets=n_buckets).withColumn("_x", F.col(value).cast("double"))
    shifted = lagged(placed, {f"_l{k}": ("_x", k) for k in range(1, max_lag + 2)}, by=by)
    shifted = shifted.join(sizes.drop("_n"), list(by)) if by else shifted.withColumn("_lags", sizes.select("_lags").scalar())
    level = lambda k: F.col("_x") if k == 0 else F.col(f"_l{k}")
    # beyond its own lags a series has zeros: its rows are complete as soon as its own lags are
    shifted = shifted.withColumns({f"_d{k}": F.when(F.lit(k) <= F.col("_lags"), level(k) - level(k + 1)).otherwise(F.lit(0.0) if k else None) for k in range(0, max_lag + 1)})
    xs = ["_l1", *[f"_d{k}" for k in range(1, max_lag + 1)]]
    stats = gram(shifted, xs, "_d0", by)
    first = F.when(F.col("_idx") <= F.col("_lags"), F.struct("_idx", "_x"))
    head = shifted.groupBy(*by).agg(F.sort_array(F.collect_list(first)).alias("_head"))
    head = head.withColumn("head", F.transform("_head", lambda h: h["_x"])).drop("_head")
    if by:
        both = sizes.join(stats, list(by), "left").join(head, list(by), "left")
    else:
        both = beside(beside(stats, head), sizes)
    out = both.withColumn("_a", _adf(F.col("n").cast("double"), "means", "sscp", "head", "_lags"))
    return out.select(*by, *[F.col(f"_a.{f.name}").alias(f.name) for f in _ADF_TYPE.fields])


def stationarity_report(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], n_buckets: int | None = None
) -> DataFrame:
    """Unit-root test of each column in levels and in first differences.

    The columns become series of one long table, so all of them share the passes of one test.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*order, F.explode(cells).alias("c")).select(*order, "c.series", "c.x")
    levels = adf(long, "x", order, ["series"], n_buckets=n_buckets).withColumn("form", F.lit("level"))
    changes = adf(differences(long, ["x"], order, ["series"], n_buckets), "d_x", order, ["series"], n_buckets=n_buckets)
    both = levels.unionByName(changes.withColumn("form", F.lit("difference")))
    return both.select("series", "form", "statistic", "p", "used_lag", "n_obs")


# ---- resampling ---------------------------------------------------------------------------

def poisson_weights(df: DataFrame, row_id: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """Each row once per replicate in which it is drawn: columns ``rep`` and ``w`` (w >= 1).

    The weight is a function of (row id, seed, replicate), so a recomputed task draws the same
    sample. One md5 serves four replicates, with 32 bits each.
    """
    blocks = (replicates + 3) // 4
    spread = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.withColumn("_h", hash_order(*row_id, F.col("_block"), seed=seed))
    draws = F.array(
        *[
            F.struct(
                (F.col("_block") * 4 + i).alias("rep"),
                F.substring("_h", 1 + 8 * i, 8).alias("u"),
            )
            for i in range(4)
        ]
    )
    flat = spread.withColumn("_r", F.explode(draws)).withColumns({"rep": F.col("_r.rep"), "_u": F.col("_r.u")})
    # in hexadecimal, where text of equal length sorts like the number
    steps = [f"{s:08x}" for s in POISSON_STEPS_32]
    drawn = flat.filter((F.col("_u") >= steps[0]) & (F.col("rep") < replicates))
    weight = F.lit(1)
    for s in steps[1:]:
        weight = weight + (F.col("_u") >= s).cast("int")
    return drawn.withColumn("w", weight).drop("_block", "_h", "_r", "_u")


def bootstrap_ridge(
    df: DataFrame, xs: Sequence[str], y: str, row_id: Sequence[str], replicates: int, alpha: float = 0.0, seed: int = 0
) -> DataFrame:
    """(rep, coef[]) of Poisson-bootstrap refits; predictors standardised on the full table.

    The draws are those of ``poisson_weights``, made as arrays; a block of rows becomes a matrix of draws, and each task sends one Gram row
    per replicate, whatever the number of table rows. Collinear predictors have the smallest of their solutions.
    """
    cols = [*xs, y]
    data = df.select(*row_id, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    base = gram(data, xs, y).select(F.struct("n", "means", "sscp")).scalar()
    size = len(cols)
    centred = data.withColumn("_b", base)
    # shift by the full-table mean and scale by its deviation: sums stay small and well conditioned
    z = {
        c: (F.col(c) - F.col("_b.means")[i])
        / (F.sqrt(F.col("_b.sscp")[i * size + i] / F.col("_b.n")) if i < size - 1 else F.lit(1.0))
        for i, c in enumerate(cols)
    }
    centred = centred.withColumns(z).drop("_b")
    # each row is about to be drawn ``replicates`` times: rows are spread evenly first, however the files are cut
    centred = centred.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)

    def weighted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the products, weighted by every replicate's draws: one matrix product per block of rows."""
        n_blocks = -(-replicates // 4)
        digests = Digests(n_blocks, seed)
        # a sum of products that stands twice in the matrix is made once
        left, right = np.triu_indices(size)
        total = np.zeros((4, 1 + size + len(left), n_blocks))
        for frame in frames:
            # ids of one length have their digests made together
            for _, part in frame.groupby(frame["_id"].str.encode("utf-8").str.len(), sort=False):
                ids, values = part["_id"].to_numpy(), part[cols].to_numpy(float)
                step = max(1, 240_000 // replicates)
                for at in range(0, len(part), step):
                    z = values[at : at + step]
                    products = np.hstack([np.ones((len(z), 1)), z, z[:, left] * z[:, right]]).T
                    for sums, counts in zip(total, digests.counts(ids[at : at + step])):
                        sums += products @ counts.astype(float)
        sums = total.transpose(2, 0, 1).reshape(4 * n_blocks, -1)[:replicates]
        both = np.empty((size, size), np.int64)
        both[left, right] = both[right, left] = np.arange(len(left)) + 1 + size
        yield pd.DataFrame({"rep": np.arange(replicates, dtype=np.int32), "sums": list(sums[:, [*range(1 + size), *both.ravel()]])})

    rows = centred.select(F.concat_ws("|", *[F.col(c).cast("string") for c in row_id]).alias("_id"), *cols)
    # a row per replicate and task, whatever the number of table rows
    flat = rows.mapInPandas(weighted, "rep int, sums array<double>").select("rep", F.posexplode("sums").alias("at", "x"))
    sums = flat.groupBy("rep", "at").agg(F.sum("x").alias("x")).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("a"))
    sums = sums.select("rep", F.col("a.x").alias("a")).filter(F.element_at("a", 1) > 0)
    parts = F.element_at("a", 1).alias("n"), F.slice("a", 2, size).alias("s1"), F.slice("a", 2 + size, size * size).alias("s2")
    return sums.select("rep", *parts).select("rep", _boot_solve("n", "s1", "s2", F.lit(float(alpha))).alias("coef"))


@F.pandas_udf(ArrayType(DoubleType()))
def _boot_solve(n: pd.Series, s1: pd.Series, s2: pd.Series, alpha: pd.Series) -> pd.Series:
    out = []
    for count, first, second, penalty in zip(n, s1, s2, alpha):
        m = np.asarray(first, float) / count
        size = len(m)
        s = np.asarray(second, float).reshape(size, size) - count * np.outer(m, m)
        p = size - 1
        out.append(np.linalg.lstsq(s[:p, :p] + penalty * np.eye(p), s[:p, p], rcond=1e-12)[0])
    return pd.Series(out)


def bootstrap_report(
    df: DataFrame, xs: Sequence[str], y: str, row_id: Sequence[str], replicates: int, alpha: float = 0.0, seed: int = 0
) -> DataFrame:
    """(term, coef_std, p_boot, ci_low, ci_high): sign-flip p and percentile interval per predictor."""
    point = ridge(df, xs, y, alpha).filter("term <> 'const'").select("term", "coef_std")
    reps = bootstrap_ridge(df, xs, y, row_id, replicates, alpha, seed)
    long = reps.select("rep", F.posexplode("coef").alias("pos", "boot"))
    long = long.withColumn("term", F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("pos") + 1))
    both = long.join(point, "term")
    flipped = F.avg((F.col("boot") * F.col("coef_std") <= 0).cast("double"))
    # one value per replicate: the percentile buffer is bounded by the replicate count
    return both.groupBy("term").agg(
        F.first("coef_std").alias("coef_std"),
        F.least(F.lit(1.0), 2 * flipped).alias("p_boot"),
        F.percentile("boot", F.lit(0.025)).alias("ci_low"),
        F.percentile("boot", F.lit(0.975)).alias("ci_high"),
        F.count("*").alias("replicates"),
    )


# ---- extrapolation ------------------------------------------------------------------------

def extrapolation_band(df: DataFrame, x: str, y: str, origin: float, target: float, buffer: float) -> DataFrame:
    """Straight-line and log-shaped extrapolation to ``target`` and the band spanning both."""
    lx = F.log(F.col(x) - F.lit(float(origin)))
    s = df.agg(
        F.count(y).alias("n"), F.max(x).alias("last_x"),
        F.regr_slope(F.col(y), F.col(x)).alias("lin_slope"), F.regr_intercept(F.col(y), F.col(x)).alias("lin_intercept"),
        F.regr_syy(F.col(y), F.col(x)).alias("_syy"), F.regr_r2(F.col(y), F.col(x)).alias("_r2"),
        F.regr_slope(F.col(y), lx).alias("log_slope"), F.regr_intercept(F.col(y), lx).alias("log_intercept"),
        F.regr_r2(F.col(y), lx).alias("_lr2"),
    )
    lin = F.col("lin_intercept") + F.col("lin_slope") * target
    log = F.col("log_intercept") + F.col("log_slope") * math.log(target - origin)
    out = s.withColumns({"linear_prediction": lin, "log_prediction": log})
    return out.withColumns(
        {
            "linear_resid_std": F.sqrt(F.col("_syy") * (1 - F.col("_r2")) / (F.col("n") - 2)),
            "log_resid_std": F.sqrt(F.col("_syy") * (1 - F.col("_lr2")) / (F.col("n") - 2)),
            "low": F.least("linear_prediction", "log_prediction") - buffer,
            "high": F.greatest("linear_prediction", "log_prediction") + buffer,
            "horizon": F.lit(float(target)) - F.col("last_x"),
        }
    ).drop("_syy", "_r2", "_lr2")


# ---- categorical predictors ---------------------------------------------------------------

def dummies(df: DataFrame, column: str, levels: Sequence, drop_first: bool = True, prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the given levels (sorted); the first is the reference unless kept."""
    levels = sorted(levels)
    used = levels[1:] if drop_first else levels
    names = {f"{prefix or column}_{level}": (F.col(column) == F.lit(level)).cast("double") for level in used}
    return df.withColumns(names), list(names)


def levels_of(df: DataFrame, column: str) -> list:
    """Distinct levels of a categorical predictor.

    Each becomes a column of the design, so a column with very many is one to encode; pass the levels to
    ``dummies`` where they are known.
    """
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def factor_regression(df: DataFrame, factor: str, y: str, xs: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """(term, coef, se, t, p) of y ~ 1 + dummies of a factor + xs, for any number of levels.

    The dummies' block of the normal equations is diagonal, so it is solved apart: the slopes of ``xs`` come from the cross
    products within levels, added up, and each level's constant from its own means. What is solved has the size of ``xs``;
    levels stay rows of a table and are never collected. The smallest level is the reference, whose row is ``const``. Rows
    with a null in the factor, a predictor or y are left out.
    """
    p = len(xs)
    size = p + 1
    levels = staged(gram(df.filter(F.col(factor).isNotNull()), xs, y, [factor]))
    pooled = levels.agg(
        F.sum("n").alias("n"), F.count("*").alias("levels"), F.min_by(F.struct("n", "means"), factor).alias("ref"), F.min(factor).alias("first"),
        F.array(*[F.lit(0.0)] * size).alias("means"), F.array(*[F.sum(F.col("sscp")[i]) for i in range(size * size)]).alias("sscp"),
    )
    # one row, written: its fit meets the levels as a table of known size
    one = staged(solve(pooled).select("n", "levels", "ref", "first", "fit"))
    slope = [F.col("fit.coef")[i + 1] for i in range(p)]
    inverse = [[F.col("fit.xtx_inv")[(i + 1) * size + j + 1] for j in range(p)] for i in range(p)]
    left = F.col("n") - F.col("levels") - p
    base = one.withColumns({"_df": F.when(left > 0, left).cast("double")}).withColumn("_s2", F.col("fit.sse") / F.col("_df"))
    base = base.withColumn("_level", F.col("ref.means")[p] - sum((b * F.col("ref.means")[i] for i, b in enumerate(slope)), F.lit(0.0)))

    def spread(away: list[Column], rows: Column) -> Column:
        return sum((away[i] * inverse[i][j] * away[j] for i in range(p) for j in range(p)), rows)

    facts = base.select("fit", "first", "ref", "_df", "_s2", "_level")
    key = F.pmod(F.hash("_n"), F.lit(1))
    mine = levels.select(F.col(factor).alias("_f"), F.col("n").alias("_n"), F.col("means").alias("_m")).withColumn("_one", key)
    met = mine.join(facts.withColumn("_one", F.pmod(F.hash("_df"), F.lit(1))), "_one")
    is_ref = F.col("_f") == F.col("first")
    own = F.col("_m")[p] - sum((b * F.col("_m")[i] for i, b in enumerate(slope)), F.lit(0.0))
    away = [F.col("_m")[i] - F.when(is_ref, 0.0).otherwise(F.col("ref.means")[i]) for i in range(p)]
    rows = 1.0 / F.col("_n") + F.when(is_ref, 0.0).otherwise(1.0 / F.col("ref.n"))
    terms = met.select(
        F.when(is_ref, "const").otherwise(F.concat(F.lit(f"{prefix or factor}_"), F.col("_f").cast("string"))).alias("term"),
        F.when(is_ref, F.col("_level")).otherwise(own - F.col("_level")).alias("coef"),
        F.sqrt(F.col("_s2") * spread(away, rows)).alias("se"), "_df",
    )
    if xs:
        cells = [F.struct(F.lit(x).alias("term"), slope[i].alias("coef"), F.sqrt(F.col("_s2") * inverse[i][i]).alias("se")) for i, x in enumerate(xs)]
        terms = terms.union(facts.select(F.explode(F.array(*cells)).alias("c"), "_df").select("c.*", "_df"))
    return terms.withColumn("t", F.col("coef") / F.col("se")).select("term", "coef", "se", "t", t_pvalue(F.col("t"), F.col("_df")).alias("p"))
