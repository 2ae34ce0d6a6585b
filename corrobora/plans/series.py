"""Time-series queries on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as T
from ..sources.readers import table
from .inference import rounded
from .registry import query


def daily_orders(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("sales"))


DAILY = "dl AS MATERIALIZED (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS sales FROM orders GROUP BY 1)"
BREAK = f"""{DAILY}, ix AS MATERIALIZED (SELECT date, sales, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, sum(sales) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - sales AS ls, sum(sales) OVER () AS tot FROM dl),
sc AS (SELECT *, ls / i AS lm, (tot - ls) / (n - i) AS rm, abs((tot - ls) / (n - i) - ls / i) AS score FROM ix WHERE i >= 120 AND i < n - 120),
bk AS MATERIALIZED (SELECT * FROM sc ORDER BY score DESC, i LIMIT 1)"""


@query(
    "change_point",
    f"WITH {BREAK} SELECT n, i AS break_idx, date AS break_at, round(lm, 2) AS left_mean, round(rm, 2) AS right_mean, round(score, 2) AS score FROM bk",
)
def change_point(spark, d):
    out = T.change_point(daily_orders(spark, d), ["date"], "sales", min_size=120, n_buckets=1)
    return rounded(out, "left_mean", "right_mean", "score", digits=2)


@query(
    "change_point_by_series",
    """WITH u AS (SELECT event_type, ts::DATE AS date, avg(value) AS v FROM events GROUP BY ALL),
    ix AS (SELECT event_type, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, sum(v) OVER w - v AS ls, sum(v) OVER (PARTITION BY event_type) AS tot FROM u WINDOW w AS (PARTITION BY event_type ORDER BY date)),
    sc AS (SELECT *, abs((tot - ls) / (n - i) - ls / i) AS score FROM ix WHERE i >= 5 AND i < n - 5)
    SELECT event_type, n, i AS break_idx, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, i) = 1""",
)
def change_point_by_series(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    out = T.change_point(daily, ["date"], "v", min_size=5, by=["event_type"], n_buckets=1)
    return rounded(out.select("event_type", "n", "break_idx", "score"), "score")


EFFECTS = """po AS MATERIALIZED (SELECT date, sales, (isodow(date) - 1)::INT AS dow, month(date)::INT AS mon FROM {src}),
lv AS (SELECT avg(sales) AS level FROM po),
dw AS (SELECT dow, avg(sales - level) AS e FROM po, lv GROUP BY dow),
mo AS (SELECT mon, avg(sales - level - e) AS e FROM po JOIN dw USING (dow), lv GROUP BY mon)"""


@query(
    "dow_month_effects",
    f"WITH {DAILY}, {EFFECTS.format(src='dl')} SELECT 'level' AS kind, 0 AS slot, round(level, 2) AS effect FROM lv UNION ALL SELECT 'weekday', dow, round(e, 2) FROM dw UNION ALL SELECT 'month', mon, round(e, 2) FROM mo",
)
def dow_month_effects(spark, d):
    return rounded(T.calendar_effects(daily_orders(spark, d), "date", "sales"), "effect", digits=2)


@query(
    "dow_month_forecast",
    f"""WITH {BREAK}, aft AS (SELECT ix.date, ix.sales FROM ix, bk WHERE ix.i >= bk.i), {EFFECTS.format(src='aft')},
    fu AS (SELECT unnest(range(1, 31)) AS k, (SELECT max(date) FROM dl) AS hi), fd AS (SELECT (hi + k::INT)::DATE AS date FROM fu)
    SELECT date, round(greatest(level + dw.e + mo.e, 0), 2) AS forecast FROM fd LEFT JOIN dw ON dw.dow = isodow(date) - 1 LEFT JOIN mo ON mo.mon = month(date), lv""",
)
def dow_month_forecast(spark, d):
    """Forecast of the days after the last one from the segment after the structural break."""
    daily = daily_orders(spark, d)
    return T.calendar_forecast(T.after_break(daily, ["date"], "sales", 120, n_buckets=1), "date", "sales", 30)


@query(
    "mape",
    f"""WITH {DAILY}, tr AS (SELECT * FROM dl WHERE date < DATE '2001-01-01'), {EFFECTS.format(src='tr')},
    fu AS (SELECT unnest(range(1, 31)) AS k, (SELECT max(date) FROM tr) AS hi), fd AS (SELECT (hi + k::INT)::DATE AS date FROM fu),
    fc AS (SELECT date, round(greatest(level + dw.e + mo.e, 0), 2) AS forecast FROM fd LEFT JOIN dw ON dw.dow = isodow(date) - 1 LEFT JOIN mo ON mo.mon = month(date), lv),
    j AS (SELECT date, sales, forecast FROM (SELECT * FROM dl WHERE date > (SELECT max(date) FROM tr)) FULL JOIN fc USING (date))
    SELECT count(*) AS n, round(100 * avg(abs(sales - forecast) / CASE WHEN sales = 0 THEN 1 ELSE abs(sales) END), 4) AS mape, count(*) FILTER (WHERE forecast IS NULL OR sales IS NULL) AS unmatched FROM j""",
)
def mape(spark, d):
    """A forecast of 30 days against all days after its training data; days without a partner are counted."""
    daily = daily_orders(spark, d)
    known = daily.filter("date < DATE '2001-01-01'")
    forecast = T.calendar_forecast(known, "date", "sales", 30)
    later = daily.filter(F.col("date") > known.agg(F.max("date")).scalar())
    return rounded(T.mape(later.join(forecast, "date", "full"), "sales", "forecast"), "mape", digits=4)


@query(
    "monthly_resample",
    """WITH m AS (SELECT date_trunc('month', ts)::DATE AS period, sum(value) AS total, count(value) AS n FROM events GROUP BY 1),
    s AS (SELECT unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), INTERVAL 1 MONTH))::DATE AS period)
    SELECT period, round(coalesce(total, 0.0), 2) AS total, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (period)""",
)
def monthly_resample(spark, d):
    return rounded(T.resample(table(spark, d, "events"), "ts", "value", "month"), "total", digits=2)


MONTHLY = "mt AS MATERIALIZED (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) / 1e6 AS revenue FROM orders GROUP BY 1)"
DECOMP = f"""{MONTHLY}, b AS (SELECT month, revenue, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n,
  (avg(revenue) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(revenue) OVER (ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 AS ma FROM mt),
r AS MATERIALIZED (SELECT *, CASE WHEN i >= 6 AND i < n - 6 THEN ma END AS raw FROM b),
ln AS (SELECT regr_slope(raw, i) FILTER (WHERE i >= 6 AND i < least(18, n - 7)) AS hs, regr_intercept(raw, i) FILTER (WHERE i >= 6 AND i < least(18, n - 7)) AS hi,
  regr_slope(raw, i) FILTER (WHERE i >= greatest(6, n - 19) AND i < n - 7) AS te, regr_intercept(raw, i) FILTER (WHERE i >= greatest(6, n - 19) AND i < n - 7) AS ti FROM r),
tr AS (SELECT month, revenue, i, CASE WHEN i < 6 THEN hi + hs * i WHEN i > n - 7 THEN ti + te * i ELSE raw END AS trend FROM r, ln),
ph AS (SELECT i % 12 AS phase, avg(revenue - trend) AS p FROM tr GROUP BY 1),
dc AS MATERIALIZED (SELECT month, revenue, trend, (i % 12)::INT AS phase, p - (SELECT avg(p) FROM ph) AS seasonal FROM tr JOIN ph ON phase = i % 12)"""


def monthly_revenue(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg((F.sum("o_totalprice") / 1e6).alias("revenue"))


def decomposition(spark, d):
    return T.seasonal_decompose(monthly_revenue(spark, d), "month", "revenue", 12)


@query(
    "seasonal_decompose",
    f"WITH {DECOMP} SELECT month, round(revenue, 6) AS revenue, round(trend, 6) AS trend, phase, round(seasonal, 6) AS seasonal, round(revenue - trend - seasonal, 6) AS resid FROM dc",
)
def seasonal_decompose(spark, d):
    return rounded(decomposition(spark, d), "revenue", "trend", "seasonal", "resid")


@query(
    "seasonal_summary",
    f"""WITH {DECOMP}, a AS (SELECT month(month)::INT AS m, avg(seasonal) AS s FROM dc GROUP BY 1)
    SELECT arg_max(m, s) AS peak_month, arg_min(m, s) AS trough_month, round((SELECT stddev_samp(seasonal) / stddev_samp(revenue) FROM dc), 6) AS seasonal_strength FROM a""",
)
def seasonal_summary(spark, d):
    return rounded(T.seasonal_summary(decomposition(spark, d), "month", "revenue"), "seasonal_strength")


@query(
    "seasonal_forecast",
    f"""WITH {DECOMP}, a AS (SELECT month(month) AS m, avg(seasonal) AS s FROM dc GROUP BY 1), l AS (SELECT max(month) AS hi, arg_max(trend, month) AS tr FROM dc),
    f AS (SELECT (hi + to_months(k::INT))::DATE AS month, tr FROM l, (SELECT unnest([1, 2, 3]) AS k))
    SELECT f.month, round(tr + s, 6) AS forecast FROM f JOIN a ON a.m = month(f.month)""",
)
def seasonal_forecast(spark, d):
    return rounded(T.seasonal_forecast(decomposition(spark, d), "month", 3), "forecast")


DAYS = "dy AS MATERIALIZED (SELECT ts::DATE AS day, count(value) AS n, sum(value) AS daily_sum, avg(value) AS daily_mean FROM events GROUP BY 1)"


@query(
    "daily_anomaly",
    f"""WITH {DAYS} SELECT day, n, round(daily_sum, 2) AS daily_sum, round(daily_mean, 6) AS daily_mean,
    abs(daily_mean - (SELECT avg(daily_mean) FROM dy)) > 1.5 * (SELECT stddev_samp(daily_mean) FROM dy) AS anomalous FROM dy""",
)
def daily_anomaly(spark, d):
    out = T.anomalous_days(table(spark, d, "events"), "ts", "value", 1.5)
    return rounded(rounded(out, "daily_mean"), "daily_sum", digits=2)


@query(
    "aggregation_audit",
    f"""WITH {DAYS}, f AS (SELECT *, abs(daily_sum - (SELECT avg(daily_sum) FROM dy)) > 1.5 * (SELECT stddev_samp(daily_sum) FROM dy) AS bs,
       abs(daily_mean - (SELECT avg(daily_mean) FROM dy)) > 1.5 * (SELECT stddev_samp(daily_mean) FROM dy) AS bm FROM dy)
    SELECT CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS days, round(avg(n), 6) AS rows_per_day, round(avg(daily_sum), 4) AS avg_sum, round(avg(daily_mean), 6) AS avg_mean,
      count(*) FILTER (WHERE bs) AS flagged_by_sum, count(*) FILTER (WHERE bm) AS flagged_by_mean, count(*) FILTER (WHERE bs AND NOT bm) AS false_alarms FROM f GROUP BY 1""",
)
def aggregation_audit(spark, d):
    out = T.aggregation_audit(table(spark, d, "events"), "ts", "value", 1.5)
    return rounded(rounded(out, "rows_per_day", "avg_mean"), "avg_sum", digits=4)


@query(
    "period_growth",
    """SELECT year(o_orderdate)::INT AS year, round(sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = 1), 2) AS first_total, round(sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = 2), 2) AS second_total,
    round((sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = 2) - sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = 1)) / sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = 1), 6) AS growth
    FROM orders GROUP BY 1""",
)
def period_growth(spark, d):
    """Growth from the first to the second quarter of every year."""
    out = T.growth(table(spark, d, "orders"), F.quarter("o_orderdate"), "o_totalprice", 1, 2, [F.year("o_orderdate").alias("year")])
    return rounded(rounded(out, "first_total", "second_total", digits=2), "growth")


@query(
    "calendar_spine",
    """WITH b AS (SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events), s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM b)
    SELECT date, date IN (SELECT ts::DATE FROM events) AS present FROM s""",
)
def calendar_spine(spark, d):
    e = table(spark, d, "events")
    days = e.select(F.to_date("ts").alias("date")).distinct().withColumn("present", F.lit(True))
    spine = T.calendar(e, F.to_date("ts"), F.to_date("ts")).join(days, "date", "left")
    return spine.withColumn("present", F.coalesce("present", F.lit(False)))
