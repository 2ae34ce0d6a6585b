"""The streams over the events table: rows reach them as they arrived, some late, some twice."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..session import staged
from ..sources.readers import table
from ..streaming import streams as S
from .inference import rounded
from .registry import query

#: Days are reported a week after they end; every span of ten days is one micro-batch.
LATENESS, SPAN = timedelta(days=7), timedelta(days=10)

# In time: within 20 hours. One event in twenty arrives 28 days late. One in ten arrives again three days on, and one
# in forty once more after 40 days, when its day has long been reported.
LOG = """first AS (SELECT *, ts + CASE WHEN event_id % 20 = 7 THEN INTERVAL 28 DAY ELSE to_hours(event_id % 21) END AS arrived FROM events),
lg AS MATERIALIZED (SELECT * FROM first UNION ALL SELECT * REPLACE (arrived + INTERVAL 3 DAY AS arrived) FROM first WHERE event_id % 10 = 7
  UNION ALL SELECT * REPLACE (arrived + INTERVAL 40 DAY AS arrived) FROM first WHERE event_id % 40 = 1),
mark AS (SELECT max(ts) - INTERVAL 7 DAY AS final FROM events),
one AS MATERIALIZED (SELECT event_id, any_value(ts) AS ts, any_value(user_id) AS user_id, any_value(value) AS value, min(arrived) AS arrived FROM lg GROUP BY event_id)"""


def arrival_log(spark, d):
    """event_id, ts, user_id, value, arrived of every arrival of every event."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % 21).cast("int"))
    days = lambda n: F.make_dt_interval(F.lit(n))
    first = e.select("event_id", "ts", "user_id", "value", (F.col("ts") + F.when(F.col("event_id") % 20 == 7, days(28)).otherwise(hours)).alias("arrived"))
    again = first.filter(F.col("event_id") % 10 == 7).withColumn("arrived", F.col("arrived") + days(3))
    once_more = first.filter(F.col("event_id") % 40 == 1).withColumn("arrived", F.col("arrived") + days(40))
    return staged(first.union(again).union(once_more))


def firsts(rows):
    return S.first_wins_stream(rows, "event_id", "ts", "7 days")


def daily(rows):
    return S.daily_profile_stream(firsts(rows), "ts", "value", None)


def late(rows):
    return S.late_arrivals_stream(rows, "event_id", "ts", "arrived", LATENESS, buckets=4)


@query(
    "stream_daily",
    f"""WITH {LOG} SELECT ts::DATE AS day, count(value) AS n, round(sum(value), 4) AS daily_sum, round(avg(value), 6) AS daily_mean FROM one, mark
    WHERE arrived < ts::DATE + INTERVAL 8 DAY AND ts::DATE + INTERVAL 1 DAY <= final GROUP BY 1""",
)
def stream_daily(spark, d):
    (out,) = S.replay(arrival_log(spark, d), "arrived", SPAN, [daily])
    return rounded(rounded(out, "daily_sum", digits=4), "daily_mean")


@query(
    "stream_first_wins",
    f"""WITH {LOG} SELECT event_id, ts, user_id, value FROM one, mark WHERE arrived < ts + INTERVAL 7 DAY OR ts > final""",
)
def stream_first_wins(spark, d):
    (out,) = S.replay(arrival_log(spark, d), "arrived", SPAN, [firsts])
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "value")


@query(
    "stream_corrections",
    f"""WITH {LOG}, t AS (SELECT ts::DATE AS day, value, arrived >= ts::DATE + INTERVAL 8 DAY AS late FROM one)
    SELECT day, count(value) FILTER (WHERE NOT late) AS reported_n, count(value) FILTER (WHERE late) AS late_n, count(value) AS corrected_n,
      round(coalesce(sum(value) FILTER (WHERE NOT late), 0), 4) AS reported_sum, round(sum(value), 4) AS corrected_sum
    FROM t, mark WHERE day + INTERVAL 1 DAY <= final GROUP BY day""",
)
def stream_corrections(spark, d):
    """What a day was reported as, what came later, and both together."""
    reported, missed = S.replay(arrival_log(spark, d), "arrived", SPAN, [daily, late])
    more = missed.groupBy(F.to_date("ts").alias("day")).agg(F.count("value").alias("late_n"), F.sum("value").alias("late_sum"))
    both = reported.join(more, "day", "left").na.fill({"late_n": 0, "late_sum": 0.0})
    out = both.select(
        "day", F.col("n").alias("reported_n"), "late_n", (F.col("n") + F.col("late_n")).alias("corrected_n"),
        F.col("daily_sum").alias("reported_sum"), (F.col("daily_sum") + F.col("late_sum")).alias("corrected_sum"),
    )
    return rounded(out, "reported_sum", "corrected_sum", digits=4)
