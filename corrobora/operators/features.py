"""Feature preparation that learns from training rows only.

Every learner aggregates the training rows to a small table or a scalar row; applying it is a
column expression or an equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip, hash_unit
from .moments import attach_fit, fit_linear, predicted
from .order_stats import exact_quantiles


def standardise(df: DataFrame, train: DataFrame, columns: Sequence[str], ddof: int = 0, prefix: str = "std_") -> DataFrame:
    """(x - mean) / deviation with the statistics of ``train``; pass df itself to see the leaky variant."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = train.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[sd(c).alias(f"s_{c}") for c in columns])).scalar()
    rows = df.withColumn("_s", stats)
    scaled = {f"{prefix}{c}": (F.col(c) - F.col(f"_s.m_{c}")) / F.when(F.col(f"_s.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s.s_{c}")) for c in columns}
    return rows.withColumns(scaled).drop("_s")


def clip_to_train(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hold columns inside the range seen in training."""
    b = train.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])).scalar()
    rows = df.withColumn("_b", b)
    return rows.withColumns({c: clip(c, F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}")) for c in columns}).drop("_b")


def ordinal(column: Column | str, order: Sequence[str]) -> Column:
    """Position in the given order, 0 first; an unknown level is NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), c), F.lit(0)) - 1


def pool_rare(df: DataFrame, train: DataFrame, column: str, min_count: int = 10, out: str | None = None) -> DataFrame:
    """Category if frequent in training, 'infrequent' if seen there but rare, NULL if unseen."""
    counts = train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    joined = df.join(counts, column, "left")
    kept = F.when(F.col("_n") >= min_count, F.col(column)).when(F.col("_n").isNotNull(), F.lit("infrequent"))
    return joined.withColumn(out or f"{column}_pooled", kept).drop("_n")


def target_encode(df: DataFrame, category: str, target: str, row_id: Sequence[str], folds: int = 5, seed: int = 0) -> DataFrame:
    """``te_leaky``: mean over all rows of the category; ``te_oof``: mean over the other folds only.

    Both come from sums per (category, fold): the fold's own rows are subtracted from the total.
    """
    fold = F.floor(hash_unit(*row_id, seed=seed) * folds).cast("int")
    rows = df.withColumn("fold", fold)
    sums = rows.groupBy(category, "fold").agg(F.sum(F.col(target).cast("double")).alias("_s"), F.count(target).alias("_n"))
    # at most ``folds`` rows per category meet in this window
    w = Window.partitionBy(category)
    table = sums.select(
        category,
        "fold",
        (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("te_leaky"),
        ((F.sum("_s").over(w) - F.col("_s")) / F.nullif(F.sum("_n").over(w) - F.col("_n"), F.lit(0))).alias("te_oof"),
    )
    return rows.join(table, [category, "fold"], "left")


def training_quantiles(train: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles as numbers: what a fitted transformer keeps, one value per probability."""
    found = {r["prob"]: r["quantile"] for r in exact_quantiles(train, column, probs).select("prob", "quantile").collect()}
    return [found[float(p)] for p in probs] if found else []


def _position(df: DataFrame, column: str, knots: Sequence[float], out: str) -> DataFrame:
    """Number of (distinct, ascending) knots at or below the value, by binary search in the JVM."""
    source = df.withColumn("_x", F.col(column).cast("double"))
    cut = Bucketizer(splits=[-math.inf, *knots, math.inf], inputCol="_x", outputCol=out, handleInvalid="keep")
    placed = cut.transform(source).withColumn(out, F.when(F.col("_x").isNotNull(), F.col(out).cast("int")))
    return placed.drop("_x")


def quantile_bins(df: DataFrame, train: DataFrame, column: str, bins: int = 10, out: str | None = None) -> DataFrame:
    """Bin number by the training quantiles; values outside fall into the end bins.

    Equal quantiles (a value that fills whole bins) collapse to one cut, so the numbers stay dense.
    """
    cuts = sorted(set(training_quantiles(train, column, [i / bins for i in range(1, bins)])))
    name = out or f"{column}_bin"
    if not cuts:
        return df.withColumn(name, F.when(F.col(column).isNotNull(), F.lit(0)))
    return _position(df, column, cuts, name)


# Wichura (1988) rational approximation of the normal quantile; fixed values, constant term first.
_A = [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
      45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727]
_B = [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
      21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610]
_C = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
      1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
      0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
      0.0265321895065760930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_score(p: Column) -> Column:
    """Normal quantile of a probability column as plain arithmetic (no Python on the rows)."""
    q = p - 0.5
    central = F.lit(0.180625) - q * q
    inner = q * _poly(_A, central) / _poly(_B, central)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    near = _poly(_C, r - 1.6) / _poly(_D, r - 1.6)
    far = _poly(_E, r - 5.0) / _poly(_F, r - 5.0)
    tail = F.when(r <= 5, near).otherwise(far)
    return F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * tail)


def quantile_to_normal(df: DataFrame, train: DataFrame, column: str, n_quantiles: int = 100, out: str | None = None) -> DataFrame:
    """Map a column to normal scores through the interpolated training distribution.

    Knots are exact training quantiles; a value that spans several knots takes the middle of its
    span, and rows outside the training range sit at the clipped ends, p in [1e-7, 1 - 1e-7].
    """
    probs = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    spans: dict[float, list[float]] = {}
    for p, q in zip(probs, training_quantiles(train, column, probs)):
        spans.setdefault(q, []).append(p)
    knots = sorted(spans)
    table = F.array(
        *[F.struct(F.lit(k).alias("x"), F.lit(spans[k][0]).alias("first"), F.lit(spans[k][-1]).alias("last")) for k in knots]
    )
    rows = _position(df, column, knots, "_i")
    x = F.col(column).cast("double")
    left, right = F.try_element_at(table, F.col("_i")), F.try_element_at(table, F.col("_i") + 1)
    between = left["last"] + (x - left["x"]) / (right["x"] - left["x"]) * (right["first"] - left["last"])
    p = (
        F.when(x <= knots[0], F.lit(0.0)).when(x >= knots[-1], F.lit(1.0))
        .when(x == left["x"], (left["first"] + left["last"]) / 2).otherwise(between)
    )
    rows = rows.withColumn("_p", F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7)))
    return rows.withColumn(out or f"{column}_normal", F.when(x.isNotNull(), normal_score(F.col("_p")))).drop("_i", "_p")


def mutual_information(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, mi, rank): information of discrete features about the target, in nats.

    All features share one pass: each row contributes one count per (feature, value, class), and
    counts are combined before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    flat = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("_y"), F.explode(cells).alias("c"))
    joint = flat.groupBy(F.col("c.feature").alias("feature"), F.col("c.value").alias("value"), "_y").agg(F.count("*").alias("n"))
    by_value = Window.partitionBy("feature", "value")
    by_class = joint.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("total"))
    both = joint.withColumn("nx", F.sum("n").over(by_value)).join(by_class, ["feature", "_y"]).join(total, "feature")
    n, all_ = F.col("n"), F.col("total")
    mi = F.sum(n / all_ * F.log(n * all_ / (F.col("nx") * F.col("ny"))))
    table = both.groupBy("feature").agg(mi.alias("mi"))
    # equal counts summed in another order differ in the last digit: that is a tie, and ties go to the first name
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.round("mi", 12).desc(), "feature")))


def impute(df: DataFrame, train: DataFrame, column: str, how: str = "mean") -> DataFrame:
    """Fill missing values with the training mean or exact median."""
    if how == "mean":
        fill = train.agg(F.avg(column)).scalar()
    elif how == "median":
        fill = exact_quantiles(train, column, [0.5]).select("quantile").scalar()
    else:
        raise ValueError(how)
    return df.withColumn(column, F.coalesce(F.col(column), fill))


def impute_by_regression(df: DataFrame, column: str, predictors: Sequence[str], flag: str | None = None) -> DataFrame:
    """Missing indicator plus values predicted from the other columns, fitted on complete rows."""
    fits = fit_linear(df, predictors, column)
    rows = attach_fit(df, fits)
    guess = predicted(predictors, F.col("_fit.coef"))
    return rows.withColumns(
        {flag or f"missing_{column}": F.col(column).isNull().cast("int"), column: F.coalesce(F.col(column).cast("double"), guess)}
    ).drop("_fit")


def class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """n / (k * n_class) per row, so that classes weigh the same."""
    counts = df.groupBy(target).agg(F.count("*").alias("_c"))
    total = counts.agg(F.struct(F.sum("_c").alias("n"), F.count("*").alias("k"))).scalar()
    table = counts.withColumn("_t", total).select(target, (F.col("_t.n") / (F.col("_t.k") * F.col("_c"))).alias(out))
    return df.join(table, target, "left")
