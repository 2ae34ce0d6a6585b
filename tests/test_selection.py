"""Selection by counting: quantiles and positions, whatever the values and ties are."""

import datetime
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrobora.operators import order_stats, sampling


def test_sortable_bits(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf]
    values += [float(2.0**k) for k in range(-1074, 1024, 7)] + [float(np.nextafter(2.0**k, 0)) for k in range(-1060, 1024, 9)]
    values += list(rng.normal(0, 1, 200)) + [struct.unpack("d", rng.bytes(8))[0] for _ in range(300)]
    rows = spark.createDataFrame([(float(v),) for v in values if v == v], "v double")
    for r in rows.select("v", order_stats.sortable_bits(F.col("v")).alias("b")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits), r.v
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(order_stats.sortable_bits(F.col("v")).alias("b")).collect()
    assert odd[0].b == (2047 << 52) + 1 and odd[1].b is None


def test_quantiles_of_skewed_values(spark):
    """Nine rows in ten lie within a millionth of the range; ties, infinities and signs are values like others."""
    rng = np.random.default_rng(2)
    x = np.concatenate([1 + rng.random(9000) * 1e-6, rng.normal(0, 1e6, 900), np.repeat(-3.5, 100), [math.inf, -math.inf, 1e-320]])
    pdf = pd.DataFrame({"g": rng.integers(0, 3, len(x)), "x": x})
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = order_stats.exact_quantiles(spark.createDataFrame(pdf).repartition(7), "x", probs, ["g"]).toPandas()
    assert len(got) == 18
    for r in got.itertuples():
        mine = np.sort(pdf[pdf.g == r.g].x)
        low, high = (mine[f(r.prob * (len(mine) - 1))] for f in (math.floor, math.ceil))
        want = low if low == high else np.quantile(mine, r.prob)
        assert r.quantile == want or abs(r.quantile - want) <= 1e-12 * abs(want)
    assert order_stats.exact_quantiles(spark.createDataFrame(pdf[:0], "g long, x double"), "x", [0.5], ["g"]).collect() == []
    nan = spark.createDataFrame([(1.0,), (2.0,), (math.nan,), (None,)], "x double")
    assert order_stats.exact_median(nan, "x").first()["median"] == 2.0


def _sort_key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("kinds", ["a int, b string, c double", "a date, b timestamp, c string", "a decimal(12,2), b boolean, c bigint"])
def test_rows_at(spark, kinds):
    """Positions along a composite order against a plain sort, with ties in every column but the last."""
    rng = np.random.default_rng(3)
    made = {
        "int": lambda i: int(rng.integers(-2, 2)),
        "string": lambda i: "".join(rng.choice(list("aäz"), rng.integers(0, 9))) if i % 9 else None,
        "double": lambda i: float(rng.normal()),
        "date": lambda i: datetime.date(1969, 12, 30) + datetime.timedelta(int(rng.integers(0, 4))),
        "timestamp": lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=int(rng.integers(0, 3))),
        "decimal(12,2)": lambda i: __import__("decimal").Decimal(int(rng.integers(-300, 300))).scaleb(-2),
        "boolean": lambda i: bool(rng.integers(0, 2)),
        "bigint": lambda i: int(rng.integers(-(2**62), 2**62)),
    }
    types = [k.split(" ")[1] for k in kinds.split(", ")]
    rows = [tuple(made[t](i) for t in types) for i in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + kinds).repartition(5)
    order = ["a", "b", "c", "id"]
    ranked = sorted(range(len(rows)), key=lambda i: _sort_key((*[v.encode() if isinstance(v, str) else v for v in rows[i]], i)))
    wanted = [0, 1, 133, 200, 399, 400]
    numbers, found = order_stats.rows_at(df, order, wanted)
    assert set(found) == set(wanted) - {400}
    for p in found:
        before = {r.id for r in df.filter(order_stats.before_row(numbers, found[p])).select("id").collect()}
        assert before == set(ranked[:p])


def test_splits_need_no_sort(spark):
    """All rows tie in the first column; the plan that tags them has no sort, window or shuffle."""
    df = spark.range(1000).select(F.lit(5).alias("t"), F.md5(F.col("id").cast("string")).alias("name"), "id")
    out = sampling.chronological_split(df, ["t", "name"], 0.8)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 800, "test": 200}
    last = out.filter("split = 'train'").agg(F.max("name")).first()[0]
    assert last < out.filter("split = 'test'").agg(F.min("name")).first()[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange" not in plan
    parts = sampling.equal_parts(df, ["t", "name"], 7).groupBy("part").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("z"))
    found = parts.orderBy("part").collect()
    assert [r.n for r in found] == [sum(i * 7 // 1000 == p for i in range(1000)) for p in range(7)]
    assert all(x.z < y.a for x, y in zip(found, found[1:]))
    empty = sampling.positional_split(df.limit(0), ["id"], 3)
    assert empty.count() == 0 and empty.columns[-1] == "split"
    assert sampling.positional_split(df, ["id"], 5000).filter("split = 'test'").isEmpty()
    # rows that tie with the cut in the whole order are test
    tied = sampling.positional_split(spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "x int"), ["x"], 2)
    assert sorted((r.x, r.split) for r in tied.collect()) == [(1, "train"), (2, "test"), (2, "test"), (2, "test"), (3, "test")]


def test_lag_of_each_series(spark):
    """Two series of different length beside each other give what each gives alone."""
    from corrobora.operators.regression import newey_west

    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("long", 700), ("short", 40)):
        e = 0.0
        for i in range(n):
            e = 0.6 * e + rng.normal()
            x = rng.normal()
            rows.append((name, i, float(x), float(2 + 3 * x + e)))
    df = spark.createDataFrame(rows, "s string, i int, x double, y double")
    both = {(r.s, r.term): r for r in newey_west(df, ["x"], "y", ["i"], ["s"], chunk_rows=64).collect()}
    for name, lags in (("long", 6), ("short", 3)):
        for r in newey_west(df.filter(F.col("s") == name), ["x"], "y", ["i"]).collect():
            got = both[name, r.term]
            assert got.max_lags == r.max_lags == lags
            assert math.isclose(got.se, r.se, rel_tol=1e-9) and math.isclose(got.coef, r.coef, rel_tol=1e-9)


def test_factor_regression(spark):
    """Against least squares with a column per level; null levels are left out."""
    from corrobora.operators.regression import factor_regression

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(list("badc"), 200), "x": rng.normal(size=200), "z": rng.normal(size=200)})
    pdf["y"] = pdf.x * 2 - pdf.z + pdf.g.map({"a": 0, "b": 1, "c": 5, "d": -2}) + rng.normal(size=200)
    odd = spark.createDataFrame([(None, 1.0, 1.0, 9e9)], "g string, x double, z double, y double")
    out = {r.term: r for r in factor_regression(spark.createDataFrame(pdf).union(odd), "g", "y", ["x", "z"]).collect()}
    design = np.column_stack([np.ones(200), *[(pdf.g == v).astype(float) for v in "bcd"], pdf.x, pdf.z])
    beta, sse, _, _ = np.linalg.lstsq(design, pdf.y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / (200 - 6))
    for name, b, s in zip(["const", "g_b", "g_c", "g_d", "x", "z"], beta, se):
        assert math.isclose(out[name].coef, b, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(out[name].se, s, rel_tol=1e-9)
    assert len(out) == 6


def test_column_summary(spark):
    from corrobora.operators.audit import column_summary, integer_levels

    df = spark.createDataFrame([("b", 1, None), ("a", 1, None), ("b", 2, None), ("a", None, None)], "t string, n int, e double")
    got = {r.column: r[1:] for r in column_summary(df, ["t", "n", "e"]).collect()}
    assert got == {"t": ("string", 4, 0, 2, "a", 2), "n": ("int", 4, 1, 2, "1", 2), "e": ("double", 4, 4, 0, None, None)}
    assert [r[2:] for r in column_summary(df.limit(0), ["t"]).collect()] == [(0, 0, 0, None, None)]
    many = spark.range(20000).select((F.col("id") % 5000).alias("a"), (F.col("id") % 50).alias("b"), (F.col("id") % 51).alias("c"))
    levels = {r.column: (r.levels, r.categorical) for r in integer_levels(many).collect()}
    assert levels == {"a": (None, False), "b": (50, True), "c": (None, False)}
