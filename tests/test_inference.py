"""Tests, tails and regressions against independent computations on small data."""

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrobora.functions import tails
from corrobora.operators import experiment, features, hypothesis, regression, survival
from corrobora.operators.moments import fit_linear


def test_tails_against_reference_library(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, df in [(2.0, 38), (0.1, 3), (12.0, 9), (5.5, 400.5), (1.1, 1)]:
        assert tails.t_sf2(t, df) == pytest.approx(2 * d.TDistribution(float(df)).cumulativeProbability(-t), rel=1e-9)
    assert float(tails.t_sf2(2.0, 38)) == pytest.approx(0.0526850709678, rel=1e-10)
    for f, a, b in [(3.2, 4, 50), (0.2, 1, 7), (9.0, 12, 1000)]:
        assert tails.f_sf(f, a, b) == pytest.approx(1 - d.FDistribution(float(a), float(b)).cumulativeProbability(f), rel=1e-8)
    for x, k in [(0.5, 1), (30.0, 4), (3.0, 10)]:
        assert tails.chi2_sf(x, k) == pytest.approx(1 - d.ChiSquaredDistribution(float(k)).cumulativeProbability(x), rel=1e-7)
    assert tails.normal_sf(12.0) == pytest.approx(1.7764821120776e-33, rel=1e-9)
    assert tails.t_sf2(40.0, 200) > 0  # far tails do not collapse to zero
    # beyond two million degrees the normal transform takes over without a jump
    assert tails.t_sf2(2.5, 1.99e6) == pytest.approx(float(tails.t_sf2(2.5, 2.01e6)), rel=1e-5)


def test_normal_score_matches_inverse(spark):
    from statistics import NormalDist

    ps = [1e-7, 1e-4, 0.02, 0.075, 0.3, 0.5, 0.77, 0.95, 0.9999, 1 - 1e-7]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", features.normal_score(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-9)


def test_shapiro_known_sample(spark):
    weights = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]
    rows = [("w", x) for x in weights] + [("flat", 1.0)] * 9 + [("two", 1.0), ("two", 2.0), ("three", 1.0), ("three", 2.0), ("three", 3.0)]
    rows += [("line", float(i)) for i in range(20)]
    out = {r.g: r for r in hypothesis.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    assert out["w"].w == pytest.approx(0.78881, abs=2e-5) and out["w"].p == pytest.approx(0.006704, abs=2e-5)
    assert out["flat"].w is None and out["two"].p is None and out["two"].n == 2
    assert out["three"].w == pytest.approx(1.0) and out["line"].w == pytest.approx(0.9604, abs=1e-3)


def groups(seed=0, n=300):
    rng = np.random.default_rng(seed)
    g = rng.choice(list("abc"), n, p=[0.6, 0.3, 0.1])
    x = np.round(rng.normal(size=n) + (g == "c") * 0.7, 1)
    return pd.DataFrame({"g": g, "x": x})


def test_mann_whitney_brute_force(spark):
    pdf = groups()
    out = hypothesis.pairwise_mann_whitney(spark.createDataFrame(pdf), "x", "g", ["a", "b", "c"], 8).toPandas()
    for _, r in out.iterrows():
        a, b = pdf[pdf.g == r.a].x.to_numpy(), pdf[pdf.g == r.b].x.to_numpy()
        u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
        assert r.u == u
        both = np.concatenate([a, b])
        _, ties = np.unique(both, return_counts=True)
        n = len(both)
        sd = math.sqrt(len(a) * len(b) / 12 * ((n + 1) - (ties**3 - ties).sum() / (n * (n - 1))))
        z = (abs(u - len(a) * len(b) / 2) - 0.5) / sd
        assert r.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    flipped = hypothesis.mann_whitney(spark.createDataFrame(pdf), "x", "g", "c", "a").first()
    row = out[(out.a == "a") & (out.b == "c")].iloc[0]
    assert flipped.u == row.n_a * row.n_b - row.u and flipped.p == pytest.approx(row.p)


def test_kruskal_and_levene(spark):
    pdf = groups(1)
    k = hypothesis.kruskal(spark.createDataFrame(pdf), "x", "g", 8).first()
    r = pdf.x.rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(r[pdf.g == g].sum() ** 2 / (pdf.g == g).sum() for g in "abc") - 3 * (n + 1)
    _, t = np.unique(pdf.x, return_counts=True)
    assert k.h == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)), rel=1e-10)
    lev = hypothesis.levene(spark.createDataFrame(pdf), "x", "g").first()
    dev = pdf.assign(d=(pdf.x - pdf.groupby("g").x.transform("median")).abs())
    m = dev.groupby("g").d.agg(["count", "mean", "var"])
    ssb = (m["count"] * (m["mean"] - dev.d.mean()) ** 2).sum()
    ssw = ((m["count"] - 1) * m["var"]).sum()
    assert lev.f == pytest.approx((ssb / 2) / (ssw / (n - 3)), rel=1e-9)


def test_holm_stops_at_first_failure(spark):
    p = spark.createDataFrame([("a", "b", 0.001), ("a", "c", 0.02), ("a", "d", 0.2), ("b", "c", 0.019)], "a string, b string, p double")
    out = {(r.a, r.b): r for r in hypothesis.adjust(p, order=["a", "b"]).collect()}
    assert [out[k].sig_holm for k in [("a", "b"), ("b", "c"), ("a", "c"), ("a", "d")]] == [True, False, False, False]
    assert out["a", "c"].p_bh == pytest.approx(0.02 * 4 / 3) and out["a", "b"].p_bonferroni == pytest.approx(0.004)


def test_normality_is_one_test_for_all_sizes(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["big"] * 9000 + ["small"] * 40, "x": np.concatenate([rng.normal(size=9000), rng.exponential(size=40)])})
    out = {r.g: r for r in hypothesis.normality(spark.createDataFrame(pdf), "x", "g", n_buckets=5).collect()}
    assert out["big"].w > 0.999 and out["big"].w_p > 0.01 and out["big"].jb_p > 0.01
    assert out["small"].w_p < 0.01


def test_pairwise_mann_whitney_has_no_list_of_groups(spark):
    rows = [(f"g{i:03d}", float((i * 7 + j * 3) % 11)) for i in range(105) for j in range(3)]
    df = spark.createDataFrame(rows + [(None, 1.0), ("g000", None)], "g string, x double")
    out = hypothesis.pairwise_mann_whitney(df, "x", "g").cache()
    assert out.count() == 105 * 104 // 2
    r = out.filter("a = 'g003' AND b = 'g104'").first()
    a, b = ([x for g, x in rows if g == k] for k in ("g003", "g104"))
    assert r.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(c, "t" if c % 2 else "k", float(10 + e + rng.normal())) for c, e in enumerate(rng.normal(size=20)) for _ in range(25)]
    df = spark.createDataFrame(rows, "c bigint, arm string, y double")
    pdf = df.toPandas()
    m = pdf.groupby("c").y.mean()
    msb = 25 * ((m - pdf.y.mean()) ** 2).sum() / 19
    msw = ((pdf.y - pdf.c.map(m)) ** 2).sum() / (20 * 24)
    got = hypothesis.icc(df, "y", "c").first()
    assert got.icc == pytest.approx((msb - msw) / (msb + 24 * msw), rel=1e-9) and got.n0 == pytest.approx(25)
    both = {r.level: r for r in hypothesis.cluster_means_test(df, "y", "c", "arm", "t", "k").collect()}
    assert both["cluster"].df == 18 and both["row"].df == 498 and both["row"].p < both["cluster"].p


def design(n=400, seed=7):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(size=n)
    x2 = 0.99 * x1 + 0.14 * rng.normal(size=n)
    e = np.zeros(n)
    for i in range(n):
        e[i] = 0.7 * (e[i - 1] if i else 0) + rng.normal()
    return pd.DataFrame({"t": np.arange(n), "x1": x1, "x2": x2 + 1e4, "y": 3 + 0.5 * x1 + e})


def ols_numpy(pdf, xs=("x1", "x2"), y="y"):
    x = np.column_stack([np.ones(len(pdf)), pdf[list(xs)]])
    xi = np.linalg.inv(x.T @ x)
    b = np.linalg.lstsq(x, pdf[y], rcond=None)[0]
    return x, xi, b, pdf[y].to_numpy() - x @ b


def test_ols_and_robust_errors(spark):
    pdf = design()
    df = spark.createDataFrame(pdf).repartition(5)
    x, _, b, e = ols_numpy(pdf)
    fit = fit_linear(df, ["x1", "x2"], "y").first().fit
    np.testing.assert_allclose(fit.coef, b, rtol=1e-6)
    assert fit.sse == pytest.approx(e @ e, rel=1e-9)
    u = x * e[:, None]
    lags = math.ceil(len(pdf) ** 0.25)
    s = u.T @ u
    for l in range(1, lags + 1):
        g = u[l:].T @ u[:-l]
        s += (1 - l / (lags + 1)) * (g + g.T)
    q, r = np.linalg.qr(x)
    xi = np.linalg.inv(r) @ np.linalg.inv(r).T
    se = np.sqrt(np.diag(xi @ s @ xi))
    out = regression.newey_west(df, ["x1", "x2"], "y", ["t"], chunk_rows=37).toPandas()
    np.testing.assert_allclose(out.se, se, rtol=1e-5)
    dw = regression.durbin_watson(df, ["x1", "x2"], "y", ["t"]).first().dw
    assert dw == pytest.approx((np.diff(e) ** 2).sum() / (e @ e), rel=1e-8)


def test_vif_ridge_cook(spark):
    pdf = design(seed=8)
    pdf["x2"] -= 1e4
    df = spark.createDataFrame(pdf)
    r2 = np.corrcoef(pdf.x1, pdf.x2)[0, 1] ** 2
    got = {r.term: r.vif for r in regression.vif(df, ["x1", "x2"]).collect()}
    assert got["x1"] == pytest.approx(1 / (1 - r2), rel=1e-8)
    z = (pdf[["x1", "x2"]] - pdf[["x1", "x2"]].mean()) / pdf[["x1", "x2"]].std(ddof=0)
    w = np.linalg.solve(z.T @ z + 5 * np.eye(2), z.T @ (pdf.y - pdf.y.mean()))
    rd = {r.term: r.coef_std for r in regression.ridge(df, ["x1", "x2"], "y", 5.0).collect()}
    assert [rd["x1"], rd["x2"]] == pytest.approx(list(w), rel=1e-9)
    x, xi, _, e = ols_numpy(pdf)
    h = np.einsum("ij,jk,ik->i", x, xi, x)
    d = e**2 / (3 * (e @ e) / (len(pdf) - 3)) * h / (1 - h) ** 2
    cd = regression.cooks_distance(df, ["x1", "x2"], "y").toPandas().sort_values("t").cooks_d
    np.testing.assert_allclose(cd, d, rtol=1e-6)


def adf_numpy(x, max_lag):
    """Textbook version: regress the difference on level, lags and a constant for every order."""
    d = np.diff(x)

    def run(order, skip):
        y = d[skip:]
        cols = [np.ones(len(y)), x[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, order + 1)]
        a = np.column_stack(cols)
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        n = len(y)
        se = math.sqrt(e @ e / (n - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        return b[1] / se, n * (math.log(2 * math.pi) + math.log(e @ e / n) + 1) + 2 * a.shape[1], n

    best = min(range(max_lag + 1), key=lambda q: run(q, max_lag)[1])
    stat, _, n = run(best, best)
    return stat, best, n


@pytest.mark.parametrize("kind", ["walk", "stationary"])
def test_adf(spark, kind):
    rng = np.random.default_rng(11)
    e = rng.normal(size=150)
    x = np.cumsum(e) if kind == "walk" else e + 0.4 * np.roll(e, 1) + 0.3 * np.roll(e, 2)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(150), "x": x})).repartition(4)
    got = regression.adf(df, "x", ["t"]).first()
    stat, lag, n = adf_numpy(x, math.ceil(12 * 1.5**0.25))
    assert (got.used_lag, got.n_obs) == (lag, n) and got.statistic == pytest.approx(stat, rel=1e-6)
    assert (got.p > 0.05) == (kind == "walk")


def test_adf_keeps_every_series(spark):
    rng = np.random.default_rng(3)
    walk, short = np.cumsum(rng.normal(size=150)), np.cumsum(rng.normal(size=60))
    rows = [("walk", i, float(v)) for i, v in enumerate(walk)] + [("short", i, float(v)) for i, v in enumerate(short)]
    rows += [("flat", i, 2.0) for i in range(50)] + [("line", i, float(i)) for i in range(50)]
    rows += [("three", i, float(i * i)) for i in range(3)] + [("six", i, float(i % 3) + 0.1 * i * i) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, t int, x double")
    out = {r.g: r for r in regression.adf(df, "x", ["t"], ["g"]).collect()}
    assert set(out) == {"walk", "short", "flat", "line", "three", "six"}
    for name, x in (("walk", walk), ("short", short)):
        lag_rule = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
        stat, lag, n = adf_numpy(x, lag_rule)
        r = out[name]
        assert r.statistic == pytest.approx(stat, rel=1e-6) and (r.used_lag, r.n_obs, r.reason) == (lag, n, None)
    assert out["flat"].statistic is None and out["flat"].reason == "flat"
    assert out["three"].reason == "too short" and out["three"].p is None
    assert out["line"].reason in ("flat", "exact fit")


def test_bootstrap_sums_use_the_fixed_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"id": np.arange(300), "x": x, "y": 2 * x + rng.normal(size=300)})
    df = spark.createDataFrame(pdf).repartition(3)
    got = {r.rep: r.coef[0] for r in regression.bootstrap_ridge(df, ["x"], "y", ["id"], 6, 1.0, seed=5).collect()}
    w = regression.poisson_weights(df, ["id"], 6, 5).toPandas()
    assert len(got) == 6
    for rep, part in w.groupby("rep"):
        z = (part.x - x.mean()) / x.std()
        mz, my = np.average(z, weights=part.w), np.average(part.y, weights=part.w)
        want = (part.w * (z - mz) * (part.y - my)).sum() / ((part.w * (z - mz) ** 2).sum() + 1.0)
        assert got[rep] == pytest.approx(want, rel=1e-9)


def test_bootstrap_weights_are_fixed_and_poisson(spark):
    df = spark.range(4000).withColumn("v", F.col("id") * 0.5)
    a = regression.poisson_weights(df, ["id"], 6, seed=1).groupBy("rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"))
    b = regression.poisson_weights(df.repartition(13), ["id"], 6, seed=1).groupBy("rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"))
    x, y = a.orderBy("rep").collect(), b.orderBy("rep").collect()
    assert [tuple(r) for r in x] == [tuple(r) for r in y] and len(x) == 6
    assert all(abs(r.n - 4000) < 300 for r in x)


def test_survival_brute_force(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"arm": rng.choice(["a", "b"], 250), "t": rng.integers(1, 40, 250), "e": rng.integers(0, 2, 250)})
    df = spark.createDataFrame(pdf)
    curve = survival.kaplan_meier(df, "t", "e", "arm", 8)
    got = {(r.arm, r.t): r.survival for r in curve.collect()}
    for arm in "ab":
        s, p = 1.0, pdf[pdf.arm == arm]
        for t in sorted(p.t.unique()):
            s *= 1 - ((p.t == t) & (p.e == 1)).sum() / (p.t >= t).sum()
            assert got[arm, t] == pytest.approx(s, abs=1e-12)
    o = e = v = 0.0
    for t in sorted(pdf.t.unique()):
        risk = pdf[pdf.t >= t]
        d, n, na = ((risk.t == t) & (risk.e == 1)).sum(), len(risk), (risk.arm == "a").sum()
        o += ((risk.t == t) & (risk.e == 1) & (risk.arm == "a")).sum()
        e += d * na / n
        v += d * na / n * (1 - na / n) * (n - d) / (n - 1) if n > 1 else 0
    lr = survival.logrank(df, "t", "e", "arm", "a", "b", 8).first()
    assert lr.chi2 == pytest.approx((o - e) ** 2 / v, rel=1e-10)


def test_all_events_at_once_gives_zero_survival(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "arm string, t int, e int")
    rows = survival.kaplan_meier(df, "t", "e", "arm").orderBy("t").collect()
    assert [r.survival for r in rows] == [pytest.approx(0.5), 0.0]
    assert survival.median_survival(survival.kaplan_meier(df, "t", "e", "arm"), "t", "arm").first().median_survival == 1


def test_power_and_decision(spark):
    row = spark.createDataFrame([(15, 150, 18, 150)], "conv_a bigint, n_a bigint, conv_b bigint, n_b bigint")
    out = experiment.power_report(experiment.wald_interval(experiment.chi2_2x2(experiment.with_rates(row))), 0.03).first()
    h = 2 * math.asin(math.sqrt(0.13)) - 2 * math.asin(math.sqrt(0.10))
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    power = lambda n: phi(h * math.sqrt(n / 2) - 1.959963984540054) + phi(-h * math.sqrt(n / 2) - 1.959963984540054)
    assert out.power == pytest.approx(power(150), rel=1e-9)
    assert power(out.n_required) >= 0.8 > power(out.n_required - 1)
    assert out.ci_low < 0 < out.ci_high


def test_bootstrap_draws_as_often_as_the_reference(spark):
    import __spark_entry__ as contract

    rows = [(i, 1, float(i % 7), (i % 5) / 10.0, 100.0 + 3 * (i % 7) + i % 11) for i in range(300)]
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_tax double, l_extendedprice double"
    root = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/lineitem.parquet")
    out = {r.term: r for r in contract.queries()["bootstrap_ci"](spark, root).collect()}
    assert set(out) == {"l_quantity", "l_tax"} and all(r.replicates == 3000 and r.ci_low < r.coef_std < r.ci_high for r in out.values())


def test_censoring_contrast_reads_its_rows_once(spark):
    from corrobora.operators import hypothesis

    rows = [("a", None if i % 50 == 0 else float(1e6 + i % 9), i % 2) for i in range(400)] + [("b", float(1e6 + i % 11), None if i % 40 == 0 else i % 3 // 2) for i in range(300)]
    plain = spark.createDataFrame(rows, "arm string, t double, e int")
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(t):
        read.add(1)
        return t

    out = {r.arm: r for r in survival.censoring_contrast(plain.withColumn("t", seen("t")), "t", "e", "arm", "a", "b").collect()}
    assert read.value == len(rows)
    pdf = plain.toPandas()
    p = hypothesis.two_sample(plain, "t", "arm", "a", "b").first()
    for arm, part in pdf.groupby("arm"):
        r = out[arm]
        assert (r.n, r.naive_median) == (len(part), part.t.median())
        assert r.censoring_rate == pytest.approx(1 - part.e.mean()) and r.naive_mean == pytest.approx(part.t.mean(), rel=1e-12)
        assert r.naive_t_p == pytest.approx(p.p, rel=1e-6)
    counts = plain.groupBy("arm", "t").agg(F.count("*").alias("n"))
    q = hypothesis.two_sample_counted(counts, "t", "n", "arm", "a", "b").first()
    assert all(q[c] == pytest.approx(p[c], rel=1e-6) for c in ("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b", "t", "df", "p", "t_welch", "df_welch", "p_welch", "cohens_d"))
