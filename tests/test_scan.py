"""Ordered primitives against single-machine brute force, under skew and any partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrobora.operators import order_stats, scan


def frame(n=600, seed=0):
    """A third of the rows share one timestamp, half belong to one series."""
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 200, n)
    t[: n // 3] = 77
    return pd.DataFrame(
        {"id": np.arange(n), "t": t, "s": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 5, n)), "x": rng.normal(size=n)}
    ).sample(frac=1, random_state=seed)


@pytest.mark.parametrize("partitions,buckets", [(1, 1), (3, 8), (7, 32)])
def test_row_index_and_lag(spark, partitions, buckets):
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(partitions)
    placed = scan.with_row_index(df, ["t", "id"], ["s"], n_buckets=buckets)
    got = scan.lagged(placed, {"p1": ("x", 1), "p5": ("x", 5)}, by=["s"], chunk_rows=16).toPandas()
    assert len(got) == len(pdf)
    want = pdf.sort_values(["s", "t", "id"]).copy()
    want["_idx"] = want.groupby("s").cumcount()
    want["p1"] = want.groupby("s").x.shift(1)
    want["p5"] = want.groupby("s").x.shift(5)
    got, want = got.set_index("id").sort_index(), want.set_index("id").sort_index()
    assert (got._idx == want._idx).all()
    for c in ("p1", "p5"):
        np.testing.assert_array_equal(got[c].to_numpy(float), want[c].to_numpy(float))


@pytest.mark.parametrize("buckets", [1, 8, 32])
def test_previous(spark, buckets):
    pdf = frame(seed=1)
    got = scan.previous(spark.createDataFrame(pdf), {"before": "x"}, ["t", "id"], ["s"], buckets).toPandas()
    want = pdf.sort_values(["s", "t", "id"]).copy()
    want["before"] = want.groupby("s").x.shift(1)
    a, b = got.set_index("id").sort_index().before, want.set_index("id").sort_index().before
    np.testing.assert_array_equal(a.to_numpy(float), b.to_numpy(float))


def test_hot_value_is_split(spark):
    pdf = frame(3000, 2)
    df = spark.createDataFrame(pdf)
    plain = scan.range_buckets(df, "t", 16).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    split = scan.range_buckets(df, "t", 16, then="id").groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert plain >= 1000 and split < 400


def test_prefix_sums_reverse_and_ties(spark):
    pdf = pd.DataFrame({"g": list("aabbbab"), "v": [1, 2, 2, 3, 3, 3, 9], "c": [1, 2, 3, 4, 5, 6, 7]})
    df = scan.range_buckets(spark.createDataFrame(pdf), "v", 4)
    fwd = scan.prefix_sums(df, ["v"], {"cum": F.col("c")}, ties="range").toPandas().set_index("c").cum.to_dict()
    assert fwd == {1: 1, 2: 6, 3: 6, 4: 21, 5: 21, 6: 21, 7: 28}
    back = scan.prefix_sums(df, ["v"], {"cum": F.col("c")}, ties="range", reverse=True).toPandas().set_index("c").cum.to_dict()
    assert back == {1: 28, 2: 27, 3: 27, 4: 22, 5: 22, 6: 22, 7: 7}


def test_mid_ranks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"v": rng.integers(0, 20, 200).astype(float), "g": rng.integers(0, 3, 200)})
    got = scan.mid_ranks(spark.createDataFrame(pdf), "v", "g", 8).toPandas()
    rank = pdf.assign(r=pdf.v.rank()).groupby("v").r.first()
    assert got.cnt.sum() == 200
    np.testing.assert_allclose(got.mid_rank, got.v.map(rank))


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_exact_quantiles(spark, buckets):
    pdf = frame(777, 4)
    probs = [0.0, 0.025, 0.31, 0.5, 0.975, 1.0]
    got = order_stats.exact_quantiles(spark.createDataFrame(pdf), "x", probs, ["s"], buckets).toPandas()
    assert len(got) == 6 * pdf.s.nunique()
    for _, r in got.iterrows():
        assert r["quantile"] == pytest.approx(np.quantile(pdf[pdf.s == r.s].x, r.prob), rel=1e-12, abs=1e-12)
    ties = order_stats.exact_quantiles(spark.createDataFrame(pdf), "t", [0.4], (), buckets).first()
    assert ties["quantile"] == np.quantile(pdf.t, 0.4)


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "id bigint, t bigint, x double")
    assert scan.with_row_index(empty, ["t", "id"]).count() == 0
    some = spark.createDataFrame([(1, None), (2, 4.0)], "id bigint, x double")
    assert order_stats.exact_median(some, "x").first()["median"] == 4.0


def test_quantiles_keep_the_null_group_and_split_a_hot_bucket(spark):
    from corrobora.operators.order_stats import exact_quantiles

    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": [None] * 900 + ["a"] * 100, "x": np.concatenate([np.round(rng.exponential(size=900), 3), rng.normal(size=100)])})
    df = spark.createDataFrame(pdf, "g string, x double").repartition(5)
    for n in (1, 8):
        out = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "x", [0.1, 0.5, 0.99], ["g"], n).collect()}
        assert len(out) == 6
        for g, part in (("a", pdf[pdf.g == "a"].x), (None, pdf[pdf.g.isna()].x)):
            for p in (0.1, 0.5, 0.99):
                assert out[g, p] == pytest.approx(np.quantile(part, p), abs=1e-12)
