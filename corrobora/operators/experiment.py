"""A/B tests: conversion tables, power, peeking, and the decision they support."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tails import chi2_pvalue, normal_tail
from ..functions.timezones import span_days


def conversion_table(df: DataFrame, variant: Column | str, converted: Column | str, a, b, by=()) -> DataFrame:
    """(conv_a, n_a, rate_a, conv_b, n_b, rate_b, effect): one aggregate for both variants."""
    g = F.col(variant) if isinstance(variant, str) else variant
    c = (F.col(converted) if isinstance(converted, str) else converted).cast("bigint")
    is_a, is_b = g == F.lit(a), g == F.lit(b)
    row = df.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(is_a, c)), F.lit(0)).alias("conv_a"), F.count_if(is_a).alias("n_a"),
        F.coalesce(F.sum(F.when(is_b, c)), F.lit(0)).alias("conv_b"), F.count_if(is_b).alias("n_b"),
    )
    return with_rates(row)


def with_rates(row: DataFrame) -> DataFrame:
    return row.withColumns(
        {"rate_a": F.col("conv_a") / F.col("n_a"), "rate_b": F.col("conv_b") / F.col("n_b")}
    ).withColumn("effect", F.col("rate_b") - F.col("rate_a"))


def chi2_2x2(row: DataFrame) -> DataFrame:
    """Add chi2 and p of the 2x2 table, without continuity correction."""
    a, b = F.col("conv_a").cast("double"), (F.col("n_a") - F.col("conv_a")).cast("double")
    c, d = F.col("conv_b").cast("double"), (F.col("n_b") - F.col("conv_b")).cast("double")
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    chi2 = F.when(margins > 0, n * (a * d - b * c) * (a * d - b * c) / margins)
    return row.withColumn("chi2", chi2).withColumn("p", chi2_pvalue(F.col("chi2"), 1))


def wald_interval(row: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Normal-approximation interval of rate_b - rate_a."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    se = F.sqrt(
        F.col("rate_a") * (1 - F.col("rate_a")) / F.col("n_a") + F.col("rate_b") * (1 - F.col("rate_b")) / F.col("n_b")
    )
    return row.withColumns({"ci_low": F.col("effect") - z * se, "ci_high": F.col("effect") + z * se})


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def power_report(row: DataFrame, lift: float, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Power to see ``lift`` over rate_a with n_a users per arm, and the size that reaches ``power``.

    The required size is the smallest integer whose two-sided power reaches the target; the tail
    on the far side is part of the power, so the closed form is checked upward by one.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    zp = NormalDist().inv_cdf(power)
    h = F.abs(cohens_h(F.col("rate_a") + lift, F.col("rate_a")))
    out = row.withColumn("cohens_h", h)

    def power_at(n: Column) -> Column:
        shift = F.col("cohens_h") * F.sqrt(n / 2)
        return normal_tail(z - shift) + normal_tail(z + shift)

    guess = F.ceil(2 * (F.lit(z + zp) / F.col("cohens_h")) * (F.lit(z + zp) / F.col("cohens_h")))
    out = out.withColumns({"power": power_at(F.col("n_a")), "_guess": guess})
    # the far tail can only lower the requirement, and only when the size is tiny
    out = out.withColumn("_less", power_at(F.col("_guess") - 1))
    return out.withColumn(
        "n_required", F.when(F.col("_less") >= power, F.col("_guess") - 1).otherwise(F.col("_guess")).cast("bigint")
    ).drop("_guess", "_less")


def peeking_profile(
    df: DataFrame, ts: str, variant: Column | str, converted: Column | str, a, b, by=()
) -> DataFrame:
    """Cumulative test by day: what an analyst who looks every evening would have seen.

    The table collapses to one row per day before anything is accumulated.
    """
    day = df.withColumn("day", F.to_date(ts))
    daily = conversion_table(day, variant, converted, a, b, [*by, "day"])
    walk = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = daily.select(*by, "day", *[F.sum(c).over(walk).alias(c) for c in ("conv_a", "n_a", "conv_b", "n_b")])
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("day"))
    return chi2_2x2(with_rates(cum.withColumn("day_no", nth)))


def peeking_summary(profile: DataFrame, early_days: int = 5, alpha: float = 0.05) -> DataFrame:
    """Early p against final p, and how many evenings would have crossed the line."""
    return profile.agg(
        F.max(F.when(F.col("day_no") == early_days, F.col("p"))).alias("p_early"),
        F.max_by("p", "day_no").alias("p_final"),
        F.count_if(F.col("p") < alpha).alias("days_significant"),
        F.count("*").alias("days"),
    )


def decision(
    df: DataFrame, ts: str, variant, converted, a, b, planned_days: float, lift: float, alpha: float = 0.05
) -> DataFrame:
    """Evidence row and the label it supports: launch_b, do_not_launch, extend_test or inconclusive."""
    g = F.col(variant) if isinstance(variant, str) else variant
    c = F.col(converted) if isinstance(converted, str) else converted
    base = df.select(F.col(ts), g.alias("_g"), c.cast("bigint").alias("_c"))
    is_a, is_b = F.col("_g") == F.lit(a), F.col("_g") == F.lit(b)
    row = base.agg(
        F.coalesce(F.sum(F.when(is_a, F.col("_c"))), F.lit(0)).alias("conv_a"), F.count_if(is_a).alias("n_a"),
        F.coalesce(F.sum(F.when(is_b, F.col("_c"))), F.lit(0)).alias("conv_b"), F.count_if(is_b).alias("n_b"),
        span_days(F.min(ts), F.max(ts)).alias("span_days"),
    )
    out = power_report(wald_interval(chi2_2x2(with_rates(row)), alpha), lift, alpha)
    covered = F.col("span_days") >= F.lit(planned_days - 1)
    sig = F.col("p") < alpha
    label = (
        F.when(~covered, F.lit("extend_test"))
        .when(sig & (F.col("effect") > 0), F.lit("launch_b"))
        .when(sig, F.lit("do_not_launch"))
        .when(F.col("power") < 0.8, F.lit("inconclusive"))
        .otherwise(F.lit("do_not_launch"))
    )
    return out.withColumns({"window_covered": covered, "decision": label})
