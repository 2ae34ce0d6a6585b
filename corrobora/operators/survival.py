"""Censored durations: Kaplan-Meier and log-rank from counts per distinct time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tails import chi2_pvalue
from ..session import staged
from .hypothesis import two_sample_counted
from .order_stats import exact_median
from .scan import collapsed_buckets, prefix_sums


def event_flag(status: Column | str, code) -> Column:
    """1 when the status code marks an observed event, 0 when the row is censored."""
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce((status == F.lit(code)).cast("int"), F.lit(0))


def life_table(df: DataFrame, time: str, event: str, arm: str, n_buckets: int | None = None) -> DataFrame:
    """(arm, time, events, censored, at_risk): rows still under observation just before each time."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(arm, time).agg(
        F.sum(F.col(event).cast("bigint")).alias("events"), F.count("*").alias("_n")
    )
    risk = prefix_sums(
        collapsed_buckets(counts, time, n_buckets), [time], {"at_risk": F.col("_n")}, by=[arm], reverse=True
    )
    return risk.withColumn("censored", F.col("_n") - F.col("events")).drop("_n")


def kaplan_meier(df: DataFrame, time: str, event: str, arm: str, n_buckets: int | None = None) -> DataFrame:
    """Survival curve per arm: life table plus ``survival``."""
    table = life_table(df, time, event, arm, n_buckets)
    finished = F.col("events") == F.col("at_risk")
    steps = table.withColumns(
        {
            "_log": F.when(finished, F.lit(0.0)).otherwise(F.log1p(-F.col("events") / F.col("at_risk"))),
            "_zero": finished.cast("int"),
        }
    )
    curve = prefix_sums(steps, [time], {"_cum": F.col("_log"), "_dead": F.col("_zero")}, by=[arm])
    return curve.withColumn("survival", F.when(F.col("_dead") > 0, F.lit(0.0)).otherwise(F.exp("_cum"))).select(
        arm, time, "events", "censored", "at_risk", "survival"
    )


def median_survival(curve: DataFrame, time: str, arm: str) -> DataFrame:
    """First time at which the curve is at or below one half; NULL when it never is."""
    half = F.col("survival") <= 0.5 + 1e-12
    return curve.groupBy(arm).agg(F.min(F.when(half, F.col(time))).alias("median_survival"))


def logrank(df: DataFrame, time: str, event: str, arm: str, a, b, n_buckets: int | None = None) -> DataFrame:
    """Two-sample log-rank test: observed and expected events of arm ``a``."""
    in_arm = F.col(arm) == F.lit(a)
    d = F.col(event).cast("bigint")
    counts = df.filter(F.col(arm).isin(a, b) & F.col(time).isNotNull()).groupBy(time).agg(
        F.sum(d).alias("d"), F.coalesce(F.sum(F.when(in_arm, d)), F.lit(0)).alias("d_a"),
        F.count("*").alias("c"), F.count_if(in_arm).alias("c_a"),
    )
    risk = prefix_sums(
        collapsed_buckets(counts, time, n_buckets), [time], {"n": F.col("c"), "n_a": F.col("c_a")}, reverse=True
    )
    n, na, dd = (F.col(c).cast("double") for c in ("n", "n_a", "d"))
    share = na / n
    variance = F.when(n > 1, dd * share * (1 - share) * (n - dd) / (n - 1)).otherwise(F.lit(0.0))
    s = risk.agg(
        F.sum("d_a").alias("observed_a"), F.sum(dd * share).alias("expected_a"), F.sum(variance).alias("variance"),
        F.sum("d").alias("events"),
    )
    gap = F.col("observed_a") - F.col("expected_a")
    return s.withColumn("chi2", gap * gap / F.col("variance")).withColumn("p", chi2_pvalue(F.col("chi2"), 1))


def censoring_contrast(df: DataFrame, time: str, event: str, arm: str, a, b) -> DataFrame:
    """What an analysis that ignores censoring reports: rates, naive medians, naive t test.

    The rows are read once, to be counted by arm, time and event; all figures come from the staged counts.
    """
    counts = staged(df.groupBy(arm, time, event).agg(F.count("*").alias("_n")))
    n, e, t = F.col("_n"), F.col(event).cast("double"), F.col(time).cast("double")
    known = lambda x: F.sum(F.when(x.isNotNull(), n))
    rate = counts.groupBy(arm).agg(
        F.sum(n).alias("n"), (1 - F.sum(n * e) / known(e)).alias("censoring_rate"), (F.sum(n * t) / known(t)).alias("naive_mean")
    )
    med = exact_median(counts, time, [arm], times="_n").select(arm, F.col("median").alias("naive_median"))
    naive = two_sample_counted(counts, time, "_n", arm, a, b).select("p")
    return rate.join(med, arm).withColumn("naive_t_p", naive.scalar())
