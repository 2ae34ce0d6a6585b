"""Hypothesis tests from one pass of grouped moments or value counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tails import chi2_pvalue, f_pvalue, normal_pvalue, normal_tail, t_pvalue
from ..session import staged
from .features import normal_score
from .moments import group_moments
from .order_stats import exact_median
from .scan import collapsed_buckets, mid_ranks, prefix_sums, with_row_index


# ---- two samples -------------------------------------------------------------------------

def student(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    """Pooled-variance t and its degrees of freedom."""
    df = n1 + n2 - 2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / df
    return (m1 - m2) / F.sqrt(pooled * (1 / n1 + 1 / n2)), df


def welch(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    """Unequal-variance t with Satterthwaite degrees of freedom."""
    a, b = v1 / n1, v2 / n2
    return (m1 - m2) / F.sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))


def two_sample(
    df: DataFrame, value: Column | str, arm: Column | str, a, b, by: Sequence[str] = ()
) -> DataFrame:
    """Moments of both arms in one aggregate, then Student, Welch and effect sizes side by side."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    g = F.col(arm) if isinstance(arm, str) else arm
    va, vb = F.when(g == F.lit(a), v), F.when(g == F.lit(b), v)
    row = df.groupBy(*by).agg(
        F.count(va).alias("n_a"), F.avg(va).alias("mean_a"), F.var_samp(va).alias("var_a"),
        F.count(vb).alias("n_b"), F.avg(vb).alias("mean_b"), F.var_samp(vb).alias("var_b"),
    )
    return _two_sample_row(row)


def two_sample_counted(df: DataFrame, value: str, times: str, arm: str, a, b) -> DataFrame:
    """``two_sample`` of a table that is already counted: ``times`` says how often a row's value occurs."""
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(times).alias("w"), F.col(arm).alias("g")).filter("v IS NOT NULL")
    w = {"a": F.when(F.col("g") == F.lit(a), F.col("w")), "b": F.when(F.col("g") == F.lit(b), F.col("w"))}
    means = rows.agg(*[x for k, c in w.items() for x in (F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{k}"), (F.sum(c * F.col("v")) / F.sum(c)).alias(f"mean_{k}"))])
    # centred before squaring, as the mean may be large against the spread
    centred = rows.withColumn("_m", means.select(F.struct("*")).scalar())
    n, gap = {k: F.max(f"_m.n_{k}") for k in w}, {k: F.col("v") - F.col(f"_m.mean_{k}") for k in w}
    parts = [(n[k].alias(f"n_{k}"), F.max(f"_m.mean_{k}").alias(f"mean_{k}"), F.when(n[k] > 1, F.sum(w[k] * gap[k] * gap[k]) / (n[k] - 1)).alias(f"var_{k}")) for k in w]
    return _two_sample_row(centred.agg(*parts[0], *parts[1]))


def _two_sample_row(row: DataFrame) -> DataFrame:
    """Student, Welch and effect sizes from the moments of both arms."""
    parts = [F.col(c) for c in ("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")]
    t, d = student(*parts)
    tw, dw = welch(*parts)
    pop = lambda var, n: var * (n - 1) / n
    d_scale = F.sqrt((pop(parts[2], parts[0]) + pop(parts[5], parts[3])) / 2)
    return row.withColumns(
        {
            "diff": F.col("mean_a") - F.col("mean_b"),
            "t": t, "df": d.cast("double"), "t_welch": tw, "df_welch": dw,
            "cohens_d": (F.col("mean_a") - F.col("mean_b")) / d_scale,
            "relative_effect": (F.col("mean_a") - F.col("mean_b")) / F.col("mean_b"),
        }
    ).withColumns({"p": t_pvalue(F.col("t"), F.col("df")), "p_welch": t_pvalue(F.col("t_welch"), F.col("df_welch"))})


def paired_t(df: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """t test on after - before; pairs with a missing side are left out."""
    gains = df.withColumn("_gain", F.col(after) - F.col(before))
    row = group_moments(gains, "_gain", by).select(*by, "n", "mean", "var")
    t = F.col("mean") / F.sqrt(F.col("var") / F.col("n"))
    return row.withColumns({"t": t, "df": (F.col("n") - 1).cast("double")}).withColumn(
        "p", t_pvalue(F.col("t"), F.col("df"))
    )


def difference_in_differences(df: DataFrame, before: str, after: str, arm: str, a, b, by=()) -> DataFrame:
    """Unequal-variance test on the gains of two arms."""
    return two_sample(df, F.col(after) - F.col(before), arm, a, b, by)


# ---- several groups ----------------------------------------------------------------------

def _with_group_total(moments: DataFrame, total: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals next to each group row: equi-join on ``by``, a scalar subquery when there is none."""
    if by:
        return moments.join(total, list(by))
    return moments.withColumn("_t", total.select(F.struct("*")).scalar()).select("*", "_t.*").drop("_t")


def _between_within(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of squares per ``by`` from the moments of the groups inside it, centred on the mean."""
    n, m = F.col("n"), F.col("mean")
    total = moments.groupBy(*by).agg((F.sum(n * m) / F.sum(n)).alias("grand"))
    centred = _with_group_total(moments, total, by).withColumn("_d", m - F.col("grand"))
    return centred.groupBy(*by).agg(
        F.count("*").alias("k"),
        F.sum(n).alias("n_total"),
        F.sum(n * F.col("_d") * F.col("_d")).alias("ss_between"),
        F.sum((n - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ss_within"),
        F.sum(n * n).alias("_sn2"),
    )


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance; ``eta2`` is the share of variance between groups."""
    return anova_from_moments(group_moments(df, value, [*by, group]).filter("n > 0"), by)


def anova_from_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = _between_within(moments, by)
    d1, d2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    f = (F.col("ss_between") / d1) / (F.col("ss_within") / d2)
    out = s.withColumns({"f": f, "df_between": d1.cast("double"), "df_within": d2.cast("double")})
    return out.withColumn("p", f_pvalue(F.col("f"), F.col("df_between"), F.col("df_within"))).select(
        *by, "k", "n_total", "ss_between", "ss_within", "f", "df_between", "df_within", "p"
    )


def welch_anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Heteroscedastic one-way test (Welch's F)."""
    m = group_moments(df, value, [*by, group]).filter("n > 1").withColumn("w", F.col("n") / F.col("var"))
    total = m.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("gm")
    )
    both = _with_group_total(m, total, by)
    k, w, sw = F.col("k"), F.col("w"), F.col("sw")
    s = both.groupBy(*by).agg(
        F.max("k").alias("k"),
        F.sum(w * (F.col("mean") - F.col("gm")) * (F.col("mean") - F.col("gm"))).alias("num"),
        F.sum((1 - w / sw) * (1 - w / sw) / (F.col("n") - 1)).alias("lam"),
    )
    f = (F.col("num") / (k - 1)) / (1 + 2 * (k - 2) * F.col("lam") / (k * k - 1))
    out = s.withColumns(
        {"f": f, "df_between": (k - 1).cast("double"), "df_within": (k * k - 1) / (3 * F.col("lam"))}
    )
    return out.withColumn("p", f_pvalue(F.col("f"), F.col("df_between"), F.col("df_within"))).drop("num", "lam")


def levene(df: DataFrame, value: str, group: str, n_buckets: int | None = None) -> DataFrame:
    """Equal-variance test on absolute deviations from the exact group median."""
    medians = exact_median(df, value, [group], n_buckets).select(group, "median")
    dev = df.select(group, value).join(medians, group).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    return anova(dev, "_dev", group)


def kruskal(df: DataFrame, value: str, group: str, n_buckets: int | None = None) -> DataFrame:
    """Rank test of several groups with tie correction."""
    ranks = mid_ranks(df.filter(F.col(group).isNotNull()), value, group, n_buckets)
    tie = ranks.withColumn("_t3", F.col("tie").cast("double") * F.col("tie") * F.col("cnt") - F.col("cnt"))
    per_group = tie.groupBy(group).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * F.col("mid_rank")).alias("rank_sum"),
        F.sum("_t3").alias("t3"),
    )
    s = per_group.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("r2"),
        F.sum("t3").alias("t3"),
    )
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("r2") - 3 * (n + 1)
    out = s.withColumn("h", h / (1 - F.col("t3") / (n * n * n - n)))
    return out.withColumn("p", chi2_pvalue(F.col("h"), F.col("k") - 1)).select("k", "n", "h", "p")


def pairwise_mann_whitney(
    df: DataFrame, value: str, group: str, groups: Sequence | None = None, n_buckets: int | None = None
) -> DataFrame:
    """Two-sided U test for every pair of groups, those named or all that occur.

    The table is collapsed to counts per (value, group). Each of these meets the other groups, so a pair
    is a key with its own running counts; no list of groups is held outside the plan's data.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    if groups is not None:
        rows = rows.filter(F.col(group).isin(list(groups)))
    counts = staged(rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_x")).agg(F.count("*").alias("_c")))
    # one array of group names; the result has a row for each two of them
    names = counts.agg(F.collect_set("_g")).scalar()
    each = counts.withColumn("_all", names).withColumn("_o", F.explode("_all")).filter(F.col("_o") != F.col("_g"))
    first = F.col("_g") < F.col("_o")
    sided = each.select(
        F.least("_g", "_o").alias("a"), F.greatest("_g", "_o").alias("b"), "_x",
        F.when(first, F.col("_c")).otherwise(0).alias("ca"), F.when(first, 0).otherwise(F.col("_c")).alias("cb"),
    )
    cells = sided.groupBy("a", "b", "_x").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    upto = prefix_sums(collapsed_buckets(cells, "_x", n_buckets), ["_x"], {"ub": F.col("cb")}, ["a", "b"])
    ca, cb = F.col("ca").cast("double"), F.col("cb").cast("double")
    tie = ca + cb
    flat = upto.groupBy("a", "b").agg(
        F.sum(ca).alias("n_a"), F.sum(cb).alias("n_b"), F.sum(ca * (F.col("ub") - cb / 2)).alias("u"),
        F.sum(tie * tie * tie - tie).alias("ties"),
    )
    n1, n2 = F.col("n_a"), F.col("n_b")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - n1 * n2 / 2) - 0.5) / sd
    return (
        flat.withColumn("z", F.greatest(z, F.lit(0.0)))
        .withColumn("p", normal_pvalue(F.col("z")))
        .select("a", "b", n1.cast("bigint").alias("n_a"), n2.cast("bigint").alias("n_b"), "u", "z", "p")
    )


def mann_whitney(df: DataFrame, value: str, group: str, a, b, n_buckets: int | None = None) -> DataFrame:
    """U of arm ``a`` against arm ``b``, tie- and continuity-corrected normal tail."""
    out = pairwise_mann_whitney(df, value, group, [a, b], n_buckets)
    if sorted([a, b])[0] == a:
        return out
    return out.select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"),
        (F.col("n_a") * F.col("n_b") - F.col("u")).alias("u"), "z", "p",
    )


# ---- all pairs and multiplicity ----------------------------------------------------------

def all_pairs(summary: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of the rows of a per-group summary: (a, b, <c>_a, <c>_b ...).

    Runs on one row per group. Each row lists the ordinals before its own and meets them in an
    equi-join, so no row is compared with rows it does not pair with.
    """
    # the window runs over one row per group, and the result has k(k-1)/2 rows by definition
    ranked = summary.select(key, *columns).withColumn("_n", F.row_number().over(Window.orderBy(key)))
    right = ranked.filter("_n > 1").withColumn("_m", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    right = right.select(F.col("_m"), F.col(key).alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    left = ranked.select(F.col("_n").alias("_m"), F.col(key).alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    return left.join(right, "_m").drop("_m")


def pairwise_t(df: DataFrame, value: str, group: str) -> DataFrame:
    """Pooled t test of every pair of groups; the table is read once, for the moments."""
    m = group_moments(df.filter(F.col(group).isNotNull()), value, [group])
    p = all_pairs(m, group, ["n", "mean", "var"])
    t, d = student(*[F.col(c) for c in ("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")])
    return p.withColumns({"t": t, "df": d.cast("double")}).withColumn("p", t_pvalue(F.col("t"), F.col("df")))


def adjust(pairs: DataFrame, p: str = "p", order: Sequence[str] = (), alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg columns for a table of p-values.

    ``order`` breaks ties of equal p so that the step-down order is fixed.
    """
    everyone = Window.partitionBy(*by)
    up = Window.partitionBy(*by).orderBy(F.col(p), *order)
    m = F.count("*").over(everyone)
    ranked = pairs.withColumns({"m": m, "rank": F.row_number().over(up)})
    holm_threshold = F.lit(alpha) / (F.col("m") - F.col("rank") + 1)
    ranked = ranked.withColumn("holm_threshold", holm_threshold)
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_end = (
        Window.partitionBy(*by).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranked.withColumns(
        {
            "p_bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("m")),
            "sig_bonferroni": F.col(p) < F.lit(alpha) / F.col("m"),
            "sig_holm": F.bool_and(F.col(p) < F.col("holm_threshold")).over(so_far),
            "p_bh": F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(from_end)),
        }
    ).withColumn("sig_bh", F.col("p_bh") < alpha)


def with_direction(pairs: DataFrame, medians: DataFrame, key: str, stat: str = "median") -> DataFrame:
    """Add 'A>B' / 'B>A' by the group statistic."""
    ma = medians.select(F.col(key).alias("a"), F.col(stat).alias("stat_a"))
    mb = medians.select(F.col(key).alias("b"), F.col(stat).alias("stat_b"))
    joined = pairs.join(ma, "a").join(mb, "b")
    return joined.withColumn(
        "direction",
        F.when(F.col("stat_a") > F.col("stat_b"), F.concat_ws(">", "a", "b")).otherwise(F.concat_ws(">", "b", "a")),
    )


# ---- clusters ----------------------------------------------------------------------------

def icc(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """Intra-class correlation from variance components, unbalanced cluster sizes allowed."""
    s = _between_within(group_moments(df, value, [cluster]).filter("n > 0"), [])
    k, n = F.col("k"), F.col("n_total")
    n0 = (n - F.col("_sn2") / n) / (k - 1)
    msb, msw = F.col("ss_between") / (k - 1), F.col("ss_within") / (n - k)
    out = s.withColumns({"n0": n0, "ms_between": msb, "ms_within": msw})
    ratio = (F.col("ms_between") - F.col("ms_within")) / (F.col("ms_between") + (F.col("n0") - 1) * F.col("ms_within"))
    return out.withColumn("icc", ratio).select("k", "n_total", "n0", "ms_between", "ms_within", "icc")


def cluster_means_test(df: DataFrame, value: str, cluster: str, arm: Column | str, a, b) -> DataFrame:
    """Row-level test next to the test on cluster means (the unit of assignment)."""
    g = F.col(arm) if isinstance(arm, str) else arm
    rows = df.withColumn("_arm", g)
    means = rows.groupBy(cluster, "_arm").agg(F.avg(value).alias("_mean"))
    naive = two_sample(rows, value, "_arm", a, b).withColumn("level", F.lit("row"))
    fixed = two_sample(means, "_mean", "_arm", a, b).withColumn("level", F.lit("cluster"))
    return naive.unionByName(fixed).select("level", "n_a", "n_b", "mean_a", "mean_b", "diff", "t", "df", "p")


# ---- normality and correlation ------------------------------------------------------------

def jarque_bera(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Moment-based normality test: any size, one pass."""
    s = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt")
    )
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return s.withColumn("jb", jb).withColumn("p", chi2_pvalue(F.col("jb"), 2))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation with the p of its t statistic."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return s.withColumn("t", t).withColumn("p", t_pvalue(F.col("t"), F.col("n") - 2))


def simple_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, r2 and the p of the slope from built-in regression aggregates."""
    s = df.groupBy(*by).agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        (F.regr_syy(F.col(y), F.col(x)) * (1 - F.regr_r2(F.col(y), F.col(x)))).alias("sse"),
        F.regr_sxx(F.col(y), F.col(x)).alias("_sxx"),
    )
    s = s.withColumn("resid_std", F.sqrt(F.col("sse") / (F.col("n") - 2)))
    s = s.withColumn("se", F.col("resid_std") / F.sqrt("_sxx")).withColumn("t", F.col("slope") / F.col("se"))
    return s.withColumn("p", t_pvalue(F.col("t"), F.col("n") - 2)).drop("_sxx")


# Royston (1995) polynomial coefficients for the Shapiro-Wilk weights and p-value; fixed values.
_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.544, -0.39978, 0.025054, -0.0006714]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]


def _polynomial(c: Sequence[float], x: Column) -> Column:
    out = F.lit(c[-1])
    for v in reversed(c[:-1]):
        out = out * x + F.lit(v)
    return out


def shapiro_wilk(df: DataFrame, value: str, group: str, n_buckets: int | None = None) -> DataFrame:
    """(group, n, w, p) of Royston's approximation, for groups of any size; null below 3 rows and for flat groups.

    The weights depend on the rank and n alone, so W is one aggregate over ranked rows: no group is
    gathered. The published p-value was fitted up to 5000 rows; above, the same formula is carried on.
    """
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_v").alias("_mean"))
    placed = with_row_index(rows, ["_v"], ["_g"], n_buckets=n_buckets).join(sizes, "_g")
    at = lambda i: normal_score((i - 0.375) / (F.col("n") + 0.25))
    x = F.col("_v") - F.col("_mean")
    m = at(F.col("_idx") + 1)
    pick = lambda i: F.max(F.when(F.col("_idx") == i, x))
    s = placed.groupBy("_g", "n").agg(
        F.sum(m * m).alias("ss"), F.sum(m * x).alias("mx"), F.sum(x * x).alias("xx"), pick(F.lit(0)).alias("x1"), pick(F.lit(1)).alias("x2"),
        pick(F.col("n") - 2).alias("y2"), pick(F.col("n") - 1).alias("y1"),
    )
    n, u = F.col("n").cast("double"), 1 / F.sqrt(F.col("n"))
    m1, m2 = at(F.col("n")), at(F.col("n") - 1)
    last = m1 / F.sqrt("ss") + _polynomial(_C1, u)
    second = m2 / F.sqrt("ss") + _polynomial(_C2, u)
    s = s.withColumns({"m1": m1, "m2": m2, "last": last, "second": second})
    ends = F.col("m1") * (F.col("y1") - F.col("x1"))
    near = F.col("m2") * (F.col("y2") - F.col("x2"))
    outer = F.col("last") * (F.col("y1") - F.col("x1"))
    long = (F.col("mx") - ends - near) / F.sqrt(
        (F.col("ss") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("last") ** 2 - 2 * F.col("second") ** 2)
    ) + outer + F.col("second") * (F.col("y2") - F.col("x2"))
    short = (F.col("mx") - ends) / F.sqrt((F.col("ss") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("last") ** 2)) + outer
    three = F.sqrt(F.lit(0.5)) * (F.col("y1") - F.col("x1"))
    top = F.when(F.col("n") == 3, three).when(F.col("n") > 5, long).otherwise(short)
    flat = (F.col("n") < 3) | (F.col("x1") == F.col("y1"))
    s = s.withColumn("w", F.when(~flat, F.least(F.lit(1.0), top * top / F.col("xx"))))
    log_n, tail = F.log(n), F.log1p(-F.col("w"))
    few = (-F.log(_polynomial(_G, n) - tail) - _polynomial(_C3, n)) / F.exp(_polynomial(_C4, n))
    many = (tail - _polynomial(_C5, log_n)) / F.exp(_polynomial(_C6, log_n))
    z = F.when(F.col("n") <= 11, few).otherwise(many)
    beyond = (F.col("n") <= 11) & (tail >= _polynomial(_G, n))
    exact = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    p = F.when(F.col("n") == 3, exact).when(beyond, F.lit(1e-99)).when(F.col("w") < 1, F.col("_tail")).otherwise(1.0)
    s = s.withColumn("_tail", normal_tail(F.when(F.col("w").isNotNull() & (F.col("n") > 3) & ~beyond & (F.col("w") < 1), z)))
    return s.select(F.col("_g").alias(group), "n", "w", F.when(F.col("w").isNotNull(), p).alias("p"))


def normality(df: DataFrame, value: str, group: str, n_buckets: int | None = None) -> DataFrame:
    """(group, n, w, w_p, jb, jb_p): Shapiro-Wilk and the moment test side by side, the same at every size."""
    rows = df.filter(F.col(group).isNotNull())
    jb = jarque_bera(rows, value, [group]).select(group, "jb", F.col("p").alias("jb_p"))
    w = shapiro_wilk(rows, value, group, n_buckets).select(group, "n", "w", F.col("p").alias("w_p"))
    return w.join(jb, group, "left")


def assumption_report(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """One row: are normality and equal variance tenable, and which omnibus test follows from that.

    Both omnibus tests are reported, so the effect of ignoring the assumptions is visible.
    """
    norm = shapiro_wilk(df, value, group).agg(F.min("p").alias("normality_min_p"))
    lev = levene(df, value, group).select(F.col("p").alias("levene_p"))
    para = anova(df, value, group).select(F.col("p").alias("anova_p"))
    rank = kruskal(df, value, group).select(F.col("p").alias("kruskal_p"))
    out = norm.select(
        "normality_min_p",
        lev.scalar().alias("levene_p"),
        para.scalar().alias("anova_p"),
        rank.scalar().alias("kruskal_p"),
    )
    bad_normal = F.coalesce(F.col("normality_min_p") < alpha, F.lit(False))
    bad_variance = F.col("levene_p") < alpha
    use_rank = bad_normal | bad_variance
    return out.withColumns(
        {
            "normality_violated": bad_normal,
            "equal_variance_violated": bad_variance,
            "test_used": F.when(use_rank, F.lit("kruskal-wallis")).otherwise(F.lit("anova")),
            "p": F.when(use_rank, F.col("kruskal_p")).otherwise(F.col("anova_p")),
        }
    )
