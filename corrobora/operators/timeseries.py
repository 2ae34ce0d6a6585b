"""Breaks, seasonality, forecasts and coverage-aware anomalies.

Raw rows are first collapsed to one row per period (map-side partial sums). Windows without a
series key run over that collapsed table only: its size is the number of calendar periods, not
the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip, safe_ratio
from ..functions.timezones import weekday0
from .scan import prefix_sums, range_buckets, with_row_index


def calendar(df: DataFrame, start: Column, end: Column, step: str = "1 day", out: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """All dates from the smallest ``start`` to the largest ``end`` (per ``by``), one row each."""
    bounds = df.groupBy(*by).agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    return bounds.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias(out))


def resample(df: DataFrame, ts: str, value: str, unit: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """(by..., period, total, n): sums per calendar period, empty periods in between count as 0."""
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}[unit]
    sums = df.groupBy(*by, F.date_trunc(unit, ts).cast("date").alias("period")).agg(
        F.sum(value).alias("total"), F.count(value).alias("n")
    )
    spine = calendar(sums, F.col("period"), F.col("period"), step, "period", by)
    return spine.join(sums, [*by, "period"], "left").fillna({"total": 0.0, "n": 0})


# ---- change point -------------------------------------------------------------------------

def break_scores(
    df: DataFrame, order: Sequence[str], value: str, min_size: int, by: Sequence[str] = (), n_buckets: int | None = None
) -> DataFrame:
    """Per admissible split position: means left and right of it and their distance."""
    rows = df.select(*dict.fromkeys([*by, *order, value])).filter(F.col(value).isNotNull())
    cells = range_buckets(rows, order[0], n_buckets, then=order[1] if len(order) > 1 else None)
    run = prefix_sums(cells, order, {"_n": F.lit(1), "_s": F.col(value).cast("double")}, by)
    total = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("_total"))
    if by:
        run = run.join(total, list(by))
    else:
        run = run.withColumn("_t", total.select(F.struct("*")).scalar()).select("*", "_t.*").drop("_t")
    # a row at position i opens the right segment: its left side is everything before it
    i = F.col("_n") - 1
    left_sum = F.col("_s") - F.col(value)
    left, right = left_sum / i, (F.col("_total") - left_sum) / (F.col("n") - i)
    out = run.withColumns({"break_idx": i.cast("bigint")}).filter(
        (F.col("break_idx") >= min_size) & (F.col("break_idx") < F.col("n") - min_size) & (F.col("break_idx") > 0)
    )
    return out.withColumns({"left_mean": left, "right_mean": right, "score": F.abs(right - left)}).drop(
        "_n", "_s", "_total", "_bucket"
    )


def change_point(
    df: DataFrame, order: Sequence[str], value: str, min_size: int = 60, by: Sequence[str] = (), n_buckets: int | None = None
) -> DataFrame:
    """Split with the largest mean shift; the first one wins a tie, the middle when none is admissible."""
    # a series without any shift has no break: the middle stands for it
    scored = break_scores(df, order, value, min_size, by, n_buckets).filter("score > 0")
    best = scored.groupBy(*by).agg(
        F.max_by(
            F.struct("break_idx", F.col(order[0]).alias("break_at"), "left_mean", "right_mean", "score"),
            F.struct(F.col("score"), -F.col("break_idx")),
        ).alias("_b")
    )
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    if by:
        joined = counts.join(best, list(by), "left")
    else:
        joined = counts.withColumn("_b", best.scalar())
    return joined.select(
        *by, "n", F.coalesce(F.col("_b.break_idx"), F.floor(F.col("n") / 2)).alias("break_idx"),
        F.col("_b.break_at").alias("break_at"), F.col("_b.left_mean").alias("left_mean"),
        F.col("_b.right_mean").alias("right_mean"), F.coalesce(F.col("_b.score"), F.lit(0.0)).alias("score"),
    )


def after_break(
    df: DataFrame, order: Sequence[str], value: str, min_size: int = 60, n_buckets: int | None = None
) -> DataFrame:
    """Rows from the break on."""
    at = change_point(df, order, value, min_size, (), n_buckets).select("break_idx").scalar()
    placed = with_row_index(df, order, n_buckets=n_buckets)
    return placed.filter(F.col("_idx") >= at).drop("_idx")


# ---- calendar effects ---------------------------------------------------------------------

def calendar_effects(df: DataFrame, date: str, value: str) -> DataFrame:
    """(kind, slot, effect): weekday means of the deviation from the level, then month means of the rest.

    At most 7 + 12 rows.
    """
    keyed = df.select(
        F.col(value).cast("double").alias("_v"), weekday0(date).alias("_dow"), F.month(date).alias("_mon")
    )
    # sums per weekday and month (84 cells at most) carry everything the two steps need
    cells = keyed.groupBy("_dow", "_mon").agg(F.sum("_v").alias("s"), F.count("_v").alias("n"))
    level = cells.agg(F.sum("s") / F.sum("n")).scalar()
    dow = cells.groupBy("_dow").agg((F.sum("s") / F.sum("n")).alias("_m")).select("_dow", (F.col("_m") - level).alias("e"))
    rest = cells.join(dow, "_dow").groupBy("_mon").agg(
        (F.sum(F.col("s") - F.col("n") * F.col("e")) / F.sum("n")).alias("_m")
    )
    mon = rest.select(F.lit("month").alias("kind"), F.col("_mon").alias("slot"), (F.col("_m") - level).alias("effect"))
    base = cells.agg((F.sum("s") / F.sum("n")).alias("effect")).select(
        F.lit("level").alias("kind"), F.lit(0).alias("slot"), "effect"
    )
    return base.unionByName(
        dow.select(F.lit("weekday").alias("kind"), F.col("_dow").alias("slot"), F.col("e").alias("effect"))
    ).unionByName(mon)


def calendar_forecast(df: DataFrame, date: str, value: str, horizon: int, last: Column | None = None) -> DataFrame:
    """(date, forecast): level + weekday + month effect for the days after the last one, never below 0."""
    effects = calendar_effects(df, date, value)
    level = effects.filter("kind = 'level'").select("effect").scalar()
    end = df.agg(F.max(date).cast("date").alias("_hi"))
    future = end.select(
        F.explode(F.sequence(F.date_add("_hi", 1), F.date_add("_hi", horizon), F.expr("INTERVAL 1 DAY"))).alias("date")
    )
    dow = effects.filter("kind = 'weekday'").select(F.col("slot").alias("_dow"), F.col("effect").alias("_de"))
    mon = effects.filter("kind = 'month'").select(F.col("slot").alias("_mon"), F.col("effect").alias("_me"))
    keyed = future.withColumns({"_dow": weekday0("date"), "_mon": F.month("date")})
    joined = keyed.join(dow, "_dow", "left").join(mon, "_mon", "left")
    return joined.select("date", F.round(clip(level + F.col("_de") + F.col("_me"), low=0.0), 2).alias("forecast"))


# ---- seasonal decomposition ---------------------------------------------------------------

def seasonal_decompose(df: DataFrame, order: str, value: str, period: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Additive decomposition of one row per period: trend (centred average, straight-line ends),
    seasonal (phase means centred on zero) and remainder."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value).cast("double")
    rows = df.withColumns(
        {"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))}
    )
    half = period // 2
    if period % 2:
        raw = F.avg(v).over(w.rowsBetween(-half, half))
    else:
        raw = (F.avg(v).over(w.rowsBetween(-half, half - 1)) + F.avg(v).over(w.rowsBetween(-half + 1, half))) / 2
    inside = (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half)
    rows = rows.withColumn("_raw", F.when(inside, raw))
    first, last = F.lit(half), F.col("_n") - half - 1
    head = inside & (F.col("_i") < F.least(first + period, last))
    tail = inside & (F.col("_i") >= F.greatest(first, last - period)) & (F.col("_i") < last)
    i = F.col("_i").cast("double")
    lines = rows.groupBy(*by).agg(
        F.regr_slope(F.when(head, F.col("_raw")), i).alias("_hs"),
        F.regr_intercept(F.when(head, F.col("_raw")), i).alias("_hi"),
        F.regr_slope(F.when(tail, F.col("_raw")), i).alias("_ts"),
        F.regr_intercept(F.when(tail, F.col("_raw")), i).alias("_ti"),
    )
    if by:
        rows = rows.join(lines, by)
    else:
        rows = rows.withColumn("_l", lines.select(F.struct("*")).scalar()).select("*", "_l.*").drop("_l")
    trend = (
        F.when(F.col("_i") < half, F.col("_hi") + F.col("_hs") * i)
        .when(F.col("_i") > last, F.col("_ti") + F.col("_ts") * i)
        .otherwise(F.col("_raw"))
    )
    rows = rows.withColumns({"trend": trend, "phase": (F.col("_i") % period).cast("int")})
    phase = rows.groupBy(*by, "phase").agg(F.avg(v - F.col("trend")).alias("_p"))
    # at most ``period`` rows per series meet in this window
    phase = phase.withColumn("seasonal", F.col("_p") - F.avg("_p").over(Window.partitionBy(*by))).drop("_p")
    out = rows.join(phase, [*by, "phase"])
    return out.withColumn("resid", v - F.col("trend") - F.col("seasonal")).drop(
        "_i", "_n", "_raw", "_hs", "_hi", "_ts", "_ti"
    )


def seasonal_summary(parts: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Peak and trough month and seasonal strength."""
    by = list(by)
    monthly = parts.groupBy(*by, F.month(order).alias("_month")).agg(F.avg("seasonal").alias("_s"))
    ends = monthly.groupBy(*by).agg(
        F.max_by("_month", F.struct("_s", -F.col("_month"))).alias("peak_month"),
        F.min_by("_month", F.struct("_s", "_month")).alias("trough_month"),
    )
    strength = parts.groupBy(*by).agg(
        (F.stddev_samp("seasonal") / F.stddev_samp(F.col(value).cast("double"))).alias("seasonal_strength")
    )
    if by:
        return ends.join(strength, by)
    return ends.withColumn("seasonal_strength", strength.scalar())


def seasonal_forecast(parts: DataFrame, order: str, steps: int) -> DataFrame:
    """(month, forecast): last trend value plus the seasonal effect of the month."""
    monthly = parts.groupBy(F.month(order).alias("_m")).agg(F.avg("seasonal").alias("_s"))
    end = parts.agg(F.max(order).cast("date").alias("_hi"), F.max_by("trend", order).alias("_trend"))
    future = end.select(
        "_trend",
        F.explode(F.sequence(F.add_months("_hi", 1), F.add_months("_hi", steps), F.expr("INTERVAL 1 MONTH"))).alias("month"),
    )
    joined = future.withColumn("_m", F.month("month")).join(monthly, "_m")
    return joined.select("month", (F.col("_trend") + F.col("_s")).alias("forecast"))


# ---- anomalies ----------------------------------------------------------------------------

def daily_profile(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., day, n, daily_sum, daily_mean)."""
    return df.groupBy(*by, F.to_date(ts).alias("day")).agg(
        F.count(value).alias("n"), F.sum(value).alias("daily_sum"), F.avg(value).alias("daily_mean")
    )


def flag_outlying(daily: DataFrame, column: str, sigmas: float, out: str) -> DataFrame:
    """Boolean ``out``: farther than ``sigmas`` sample deviations from the mean of the column."""
    s = daily.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    return daily.withColumn("_s", s).withColumn(
        out, F.abs(F.col(column) - F.col("_s.m")) > sigmas * F.col("_s.s")
    ).drop("_s")


def anomalous_days(df: DataFrame, ts: str, value: str, sigmas: float = 1.5) -> DataFrame:
    """Days whose mean is out of line: means, unlike sums, do not react to missing hours."""
    return flag_outlying(daily_profile(df, ts, value), "daily_mean", sigmas, "anomalous")


def aggregation_audit(df: DataFrame, ts: str, value: str, sigmas: float = 1.5) -> DataFrame:
    """Per day type: coverage, sums and means, and how many days each aggregate would flag."""
    daily = daily_profile(df, ts, value)
    both = flag_outlying(flag_outlying(daily, "daily_sum", sigmas, "by_sum"), "daily_mean", sigmas, "by_mean")
    kind = F.when(weekday0("day") >= 5, F.lit("weekend")).otherwise(F.lit("weekday"))
    return both.groupBy(kind.alias("day_type")).agg(
        F.count("*").alias("days"), F.avg("n").alias("rows_per_day"), F.avg("daily_sum").alias("avg_sum"),
        F.avg("daily_mean").alias("avg_mean"), F.count_if("by_sum").alias("flagged_by_sum"),
        F.count_if("by_mean").alias("flagged_by_mean"), F.count_if(F.col("by_sum") & ~F.col("by_mean")).alias("false_alarms"),
    )


def mape(pairs: DataFrame, actual: str, forecast: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute percentage error; a zero actual is divided by one."""
    gap = F.abs(F.col(actual) - F.col(forecast))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), (100 * F.avg(safe_ratio(gap, F.abs(F.col(actual))))).alias("mape"),
        F.count_if(F.col(forecast).isNull() | F.col(actual).isNull()).alias("unmatched"),
    )


def growth(df: DataFrame, period: Column, value: Column | str, first, second, by: Sequence[Column | str] = ()) -> DataFrame:
    """(by..., first_total, second_total, growth) between two periods, in one pass."""
    v = F.col(value) if isinstance(value, str) else value
    a, b = F.sum(F.when(period == F.lit(first), v)), F.sum(F.when(period == F.lit(second), v))
    return df.groupBy(*by).agg(a.alias("first_total"), b.alias("second_total")).withColumn(
        "growth", (F.col("second_total") - F.col("first_total")) / F.col("first_total")
    )
