"""Merging, joining, auditing and sampling on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import timezones as Z
from ..operators import audit, merge, order_stats, sampling
from ..operators.moments import spread
from ..sources.readers import table
from .registry import query

DOMAIN = ["Q1", "Q2", "Q3", "Q4"]


@query(
    "quarterly_revenue_left",
    """
    WITH q AS (
      SELECT 'Q' || quarter(o_orderdate) AS period, sum(o_totalprice) AS total,
             count(*) FILTER (WHERE n_name IS NULL) AS orphan_rows
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      GROUP BY 1),
    d AS (SELECT unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS period),
    f AS (SELECT period, coalesce(total, 0.0) AS total, coalesce(orphan_rows, 0) AS orphan_rows FROM d LEFT JOIN q USING (period))
    SELECT period, round(total, 2) AS total, orphan_rows, round(total / avg(total) OVER (), 6) AS share_of_mean,
           total / avg(total) OVER () < 0.9 AS underperforming
    FROM f
    """,
)
def quarterly_revenue_left(spark, d):
    """Revenue per quarter with left joins; quarters 10 % below the mean are flagged."""
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    # a row per customer and quarter crosses the join, however many orders there are
    quarter = F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("quarter")
    sums = table(spark, d, "orders").groupBy("o_custkey", quarter).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("rows"))
    joined = sums.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = audit.left_report(joined, F.col("quarter"), F.col("total"), DOMAIN, 0.9, F.col("n_name").isNull(), F.col("rows"))
    return out.select("period", F.round("total", 2).alias("total"), "orphan_rows", F.round("share_of_mean", 6).alias("share_of_mean"), "underperforming")


@query(
    "join_loss_audit",
    """
    WITH k AS (SELECT DISTINCT doc_id AS kid FROM labels)
    SELECT count(*) AS rows_left, count(kid) AS rows_inner, count(*) - count(kid) AS rows_lost,
           sum(n_chars)::BIGINT AS measure_left, coalesce(sum(n_chars) FILTER (WHERE kid IS NOT NULL), 0)::BIGINT AS measure_inner,
           (sum(n_chars) - coalesce(sum(n_chars) FILTER (WHERE kid IS NOT NULL), 0))::BIGINT AS measure_lost,
           round(1 - coalesce(sum(n_chars) FILTER (WHERE kid IS NOT NULL), 0) / sum(n_chars), 6) AS share_lost
    FROM documents LEFT JOIN k ON doc_id = kid
    """,
)
def join_loss_audit(spark, d):
    out = audit.join_loss_audit(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "n_chars")
    return out.withColumn("share_lost", F.round("share_lost", 6))


@query("orphan_keys", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return audit.orphans(docs, table(spark, d, "labels"), "doc_id")


SOURCES = """
    q1 AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 20 = 1),
    q2 AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 3 = 1),
    q3 AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 3 = 2 OR o_orderkey % 20 = 0)
"""
MERGE_COLUMNS = ["transaction_id", "customer_id", "amount", "timestamp_utc", "discount_code"]


def drifted_sources(spark, d):
    """Three sources made from the orders table: other names, text money, blanks, other time zones."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    wall = F.col("o_orderdate") + F.make_dt_interval(mins=(key % 1440).cast("int"))
    base = o.select(
        key.alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"),
        wall.alias("wall"), F.col("o_orderpriority").alias("priority"), key.alias("line_no"),
    )
    q1 = base.filter((key % 3 == 0) | (key % 20 == 1)).drop("priority").withColumnRenamed("wall", "transaction_date")
    q2 = base.filter(key % 3 == 1).drop("priority").withColumnsRenamed({"wall": "txn_date", "customer_id": "client"})
    q3 = base.filter((key % 3 == 2) | (key % 20 == 0)).withColumnRenamed("wall", "date")
    q3 = q3.withColumns(
        {
            "amount": F.concat(F.lit("$"), F.col("amount").cast("decimal(18,2)").cast("string")),
            "discount_code": F.when(F.col("priority") == "1-URGENT", F.lit("RUSH")).otherwise(F.lit("  ")),
        }
    ).drop("priority")
    return [
        (q1, merge.SourceSpec("Q1", "UTC", {"transaction_date": "timestamp"})),
        (q2, merge.SourceSpec("Q2", "US/Eastern", {"txn_date": "timestamp", "client": "customer_id"})),
        (q3, merge.SourceSpec("Q3", "US/Pacific", {"date": "timestamp"}, ["amount"], ["discount_code"])),
    ]


def merged_orders(spark, d):
    return merge.merge_sources(drifted_sources(spark, d), MERGE_COLUMNS, "transaction_id", "line_no")


def _utc_sql(wall: str, zone: str) -> str:
    """Wall time to UTC in SQL, gap rows to the end of the gap, doubled hour to NULL.

    The checking engine resolves a doubled hour to the later instant, the library to the earlier.
    """
    if zone == "UTC":
        return wall
    utc = f"(timezone('{zone}', {wall}) AT TIME ZONE 'UTC')"
    back = f"timezone('{zone}', timezone('{zone}', {wall}))"
    gap_end = f"(timezone('{zone}', date_trunc('hour', {back})) AT TIME ZONE 'UTC')"
    again = f"timezone('{zone}', timezone('{zone}', {wall}) - INTERVAL 1 HOUR)"
    return f"CASE WHEN {again} = {wall} THEN NULL WHEN {back} <> {wall} THEN {gap_end} ELSE {utc} END"


MERGED_SQL = f"""
    WITH {SOURCES},
    w1 AS (SELECT *, o_orderdate + to_minutes(o_orderkey % 1440) AS wall FROM q1),
    w2 AS (SELECT *, o_orderdate + to_minutes(o_orderkey % 1440) AS wall FROM q2),
    w3 AS (SELECT *, o_orderdate + to_minutes(o_orderkey % 1440) AS wall FROM q3),
    u AS (
      SELECT 0 AS rk, o_orderkey, o_custkey, o_totalprice, {_utc_sql('wall', 'UTC')} AS utc, NULL AS code, 'Q1' AS source, 'UTC' AS source_tz FROM w1
      UNION ALL SELECT 1, o_orderkey, o_custkey, o_totalprice, {_utc_sql('wall', 'US/Eastern')}, NULL, 'Q2', 'US/Eastern' FROM w2
      UNION ALL SELECT 2, o_orderkey, o_custkey, o_totalprice, {_utc_sql('wall', 'US/Pacific')},
                CASE WHEN o_orderpriority = '1-URGENT' THEN 'RUSH' END, 'Q3', 'US/Pacific' FROM w3),
    merged AS (
      SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount,
             strftime(utc, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp_utc, code AS discount_code, source, source_tz
      FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY rk) = 1)
"""


@query("etl_merge", MERGED_SQL + " SELECT * FROM merged")
def etl_merge(spark, d):
    """Three drifting sources in one canonical table, first source wins, instants in UTC."""
    return merged_orders(spark, d)


@query(
    "localize_utc",
    f"""
    WITH w AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS wall FROM orders)
    SELECT o_orderkey, strftime(wall, '%Y-%m-%d %H:%M') AS wall,
           strftime({_utc_sql('wall', 'US/Eastern')}, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc,
           strftime((timezone('US/Eastern', wall) - CASE WHEN timezone('US/Eastern', timezone('US/Eastern', wall) - INTERVAL 1 HOUR) = wall
             THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc_engine_rule
    FROM w
    """,
)
def localize_utc(spark, d):
    o = table(spark, d, "orders")
    wall = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = o.select("o_orderkey", wall.alias("w"))
    return rows.select(
        "o_orderkey", F.date_format("w", "yyyy-MM-dd HH:mm").alias("wall"),
        Z.iso_utc(Z.wall_to_utc("w", "US/Eastern")).alias("utc"),
        Z.iso_utc(Z.wall_to_utc("w", "US/Eastern", gap="offset", fold="earlier")).alias("utc_engine_rule"),
    )


@query(
    "mixed_format_dates",
    """
    WITH t AS (
      SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'US' ELSE 'EU' END AS source, o_orderdate::DATE AS truth,
             CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS txt
      FROM orders),
    p AS (
      SELECT *, CASE WHEN source = 'US' THEN try_strptime(txt, '%m/%d/%Y') ELSE try_strptime(txt, '%d/%m/%Y') END::DATE AS good,
             try_strptime(txt, '%m/%d/%Y')::DATE AS naive FROM t)
    SELECT source, count(*) AS rows, count(*) FILTER (WHERE good = truth) AS parsed_right,
           count(*) FILTER (WHERE naive IS NULL) AS naive_lost, count(*) FILTER (WHERE naive <> truth) AS naive_wrong
    FROM p GROUP BY source
    """,
)
def mixed_format_dates(spark, d):
    o = table(spark, d, "orders")
    us = F.col("o_custkey") % 2 == 0
    rows = o.select(
        F.when(us, F.lit("US")).otherwise(F.lit("EU")).alias("source"),
        F.to_date("o_orderdate").alias("truth"),
        F.when(us, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("txt"),
    )
    parsed = rows.withColumns(
        {
            "good": S.parse_by_source("txt", "source", {"US": "MM/dd/yyyy", "EU": "dd/MM/yyyy"}),
            "naive": S.naive_parse("txt", "MM/dd/yyyy"),
        }
    )
    return parsed.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if(F.col("good") == F.col("truth")).alias("parsed_right"),
        F.count_if(F.col("naive").isNull()).alias("naive_lost"), F.count_if(F.col("naive") != F.col("truth")).alias("naive_wrong"),
    )


@query(
    "set_ops",
    """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders),
         b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT (SELECT count(*) FROM a) AS keys_a, (SELECT count(*) FROM b) AS keys_b,
           (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS in_both,
           (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a,
           (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b,
           (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) = 0 AND (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) = 0 AS equal
    """,
)
def set_ops(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return merge.key_overlap(a, b, "k")


@query(
    "group_profile",
    """
    SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(sum(c_acctbal), 2) AS total,
           round(stddev_samp(c_acctbal), 6) AS sd1, round(stddev_pop(c_acctbal), 6) AS sd0,
           round(sqrt(var_pop(c_acctbal) * count(*) / (count(*) - 2)), 6) AS sd2, min(c_acctbal) AS lo, max(c_acctbal) AS hi,
           count(DISTINCT c_nationkey) AS nations, round(avg((c_acctbal < 0)::INT), 6) AS negative_rate,
           arg_max(c_name, (c_acctbal, c_custkey)) AS richest, bool_or(c_acctbal < 0) AS any_negative, bool_and(c_acctbal < 0) AS all_negative
    FROM customer GROUP BY c_mktsegment
    """,
)
def group_profile(spark, d):
    c = table(spark, d, "customer")
    v = F.col("c_acctbal")
    return c.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 2).alias("total"),
        F.round(spread(v, 1), 6).alias("sd1"), F.round(spread(v, 0), 6).alias("sd0"), F.round(spread(v, 2), 6).alias("sd2"),
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_distinct("c_nationkey").alias("nations"),
        F.round(F.avg((v < 0).cast("int")), 6).alias("negative_rate"),
        F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("richest"),
        F.bool_or(v < 0).alias("any_negative"), F.bool_and(v < 0).alias("all_negative"),
    )


@query(
    "exact_quantiles",
    """
    WITH q AS (SELECT l_returnflag, unnest([0.025, 0.5, 0.975]) AS prob,
                      unnest(quantile_cont(l_extendedprice, [0.025, 0.5, 0.975])) AS quantile, count(*) AS n FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, prob::DOUBLE AS prob, round(quantile, 4) AS quantile, n FROM q
    """,
)
def exact_quantiles(spark, d):
    out = order_stats.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.025, 0.5, 0.975], ["l_returnflag"])
    return out.select("l_returnflag", "prob", F.round("quantile", 4).alias("quantile"), "n")


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, avg(({c} IS NULL)::INT)::DOUBLE AS missing_rate, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std_sample, round(stddev_pop({c}), 4) AS std_population, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def column_profile(spark, d):
    out = audit.profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).drop("distinct_sketch")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std_sample", "std_population")})


@query(
    "simpson_check",
    """
    WITH j AS (SELECT lang AS stratum, toxic, quality FROM documents JOIN labels USING (doc_id)),
    t AS (SELECT coalesce(stratum, '(all)') AS stratum, grouping(stratum) AS g,
                 count(*) FILTER (WHERE toxic = 1) AS n_a, count(*) FILTER (WHERE toxic = 0) AS n_b,
                 avg(quality) FILTER (WHERE toxic = 1) AS rate_a, avg(quality) FILTER (WHERE toxic = 0) AS rate_b
          FROM j GROUP BY ROLLUP (stratum)),
    v AS (SELECT bool_and(rate_a - rate_b > 0) FILTER (WHERE g = 0) AS up, bool_and(rate_a - rate_b < 0) FILTER (WHERE g = 0) AS down,
                 max(rate_a - rate_b) FILTER (WHERE g = 1) AS overall FROM t)
    SELECT stratum, n_a, n_b, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b, round(rate_a - rate_b, 6) AS gap,
           (up AND overall < 0) OR (down AND overall > 0) AS reversal FROM t, v
    """,
)
def simpson_check(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    out = audit.simpson_check(rows, "lang", "toxic", "quality", 1, 0)
    return out.withColumns({c: F.round(c, 6) for c in ("rate_a", "rate_b", "gap")})


@query(
    "rates_pivot",
    """
    SELECT lang, round(avg(quality) FILTER (WHERE toxic = 0), 6) AS toxic_0, round(avg(quality) FILTER (WHERE toxic = 1), 6) AS toxic_1
    FROM documents JOIN labels USING (doc_id) GROUP BY lang
    """,
)
def rates_pivot(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    out = audit.rates_pivot(rows, "lang", "toxic", "quality", [0, 1])
    return out.select("lang", F.round("0", 6).alias("toxic_0"), F.round("1", 6).alias("toxic_1"))


@query(
    "delta_features",
    """
    SELECT event_id, user_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0), 6) AS delta_value FROM events
    """,
)
def delta_features(spark, d):
    out = merge.step_changes(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], ["value"])
    return out.select("event_id", "user_id", F.round("delta_value", 6).alias("delta_value"))


@query(
    "keep_last",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def keep_last(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return merge.keep_last(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "keep_first",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
)
def keep_first(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return merge.keep_first(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "longitudinal_check",
    """
    WITH p AS (SELECT user_id, ts, count(*) AS n FROM events GROUP BY ALL),
    k AS (SELECT user_id, sum(n) AS rows, count(*) AS steps FROM p GROUP BY user_id)
    SELECT count(*) AS keys, sum(rows)::BIGINT AS rows, count(*) FILTER (WHERE rows > 1) AS repeated_keys, sum(rows - steps)::BIGINT AS true_duplicates,
           count(*) FILTER (WHERE rows > 1) > 0 AND sum(rows - steps) < sum(rows) - count(*) AS longitudinal FROM k
    """,
)
def longitudinal_check(spark, d):
    return audit.longitudinal_check(table(spark, d, "events"), "user_id", "ts")


# ---- samples and splits -------------------------------------------------------------------

UNIT = "(('0x' || substr(md5({id}::VARCHAR || '|{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def unit(id_: str, seed: int) -> str:
    return UNIT.format(id=id_, seed=seed)


@query("random_sample", "SELECT event_id, user_id, value FROM events ORDER BY md5(event_id::VARCHAR || '|7'), event_id LIMIT 100")
def random_sample(spark, d):
    return sampling.random_sample(table(spark, d, "events").select("event_id", "user_id", "value"), ["event_id"], 100, seed=7)


@query(
    "stratified_sample",
    "SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR || '|42'), event_id) <= 20",
)
def stratified_sample(spark, d):
    return sampling.stratified_sample(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", ["event_id"], 20, seed=42)


@query(
    "hash_split",
    f"SELECT CASE WHEN {unit('event_id', 3)} < 0.8 THEN 'train' ELSE 'test' END AS split, count(*) AS n, round(avg((event_type = 'purchase')::INT), 6) AS rate FROM events GROUP BY 1",
)
def hash_split(spark, d):
    rows = sampling.hash_split(table(spark, d, "events"), ["event_id"], 0.8, seed=3)
    out = sampling.split_report(rows, "split", (F.col("event_type") == "purchase").cast("int"))
    return out.withColumn("rate", F.round("rate", 6))


@query(
    "group_split",
    f"""
    WITH s AS (SELECT user_id, CASE WHEN {unit('user_id', 5)} < 0.8 THEN 'train' ELSE 'test' END AS split FROM events)
    SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users,
           (SELECT count(*) FROM (SELECT user_id FROM s GROUP BY user_id HAVING count(DISTINCT split) > 1)) AS users_on_both_sides FROM s GROUP BY split
    """,
)
def group_split(spark, d):
    rows = sampling.hash_split(table(spark, d, "events").select("user_id"), ["user_id"], 0.8, seed=5)
    per_user = rows.groupBy("user_id", "split").agg(F.count("*").alias("n"))
    both = per_user.groupBy("user_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1)).scalar()
    return per_user.groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("users")).withColumn("users_on_both_sides", both)


@query(
    "stratified_split",
    f"""
    WITH u AS (SELECT event_type, {unit('event_id', 11)} AS u FROM events),
    c AS (SELECT event_type, quantile_cont(u, 0.8) AS cut FROM u GROUP BY event_type)
    SELECT event_type, CASE WHEN u <= cut THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM u JOIN c USING (event_type) GROUP BY ALL
    """,
)
def stratified_split(spark, d):
    rows = sampling.stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], 0.8, seed=11)
    return rows.groupBy("event_type", "split").agg(F.count("*").alias("n"))


@query(
    "chronological_split",
    """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS n,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
           round(avg((event_type = 'purchase')::INT), 6) AS rate FROM r GROUP BY 1
    """,
)
def chronological_split(spark, d):
    rows = sampling.chronological_split(table(spark, d, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"])
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
        F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("rate"),
    )


@query(
    "positional_split",
    """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)
    SELECT CASE WHEN i < 3000 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1
    """,
)
def positional_split(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = sampling.positional_split(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3000)
    return out.groupBy("split").agg(F.count("*").alias("n"))


# ---- audits -------------------------------------------------------------------------------

@query(
    "source_contradiction",
    """
    WITH g AS (SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, sum(l_extendedprice) AS left_total FROM lineitem GROUP BY 1),
    n AS (SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, sum(l_extendedprice * (1 - l_discount)) AS right_total FROM lineitem GROUP BY 1),
    b AS (SELECT coalesce(g.period, n.period) AS period, left_total, right_total, left_total - right_total AS gap FROM g FULL JOIN n ON g.period = n.period),
    l AS (SELECT *, left_total / lag(left_total) OVER w - 1 AS lg, right_total / lag(right_total) OVER w - 1 AS rg, gap / lag(gap) OVER w - 1 AS gg FROM b WINDOW w AS (ORDER BY period))
    SELECT period, round(left_total, 2) AS left_total, round(right_total, 2) AS right_total, round(lg, 6) AS left_growth, round(rg, 6) AS right_growth,
           round(gap, 2) AS gap, round(gg, 6) AS gap_growth, coalesce(sign(lg) * sign(rg) < 0, false) AS contradiction FROM l
    """,
)
def source_contradiction(spark, d):
    li = table(spark, d, "lineitem")
    period = F.concat(F.year("l_shipdate"), F.lit("-Q"), F.quarter("l_shipdate")).alias("period")
    gross = li.select(period, F.col("l_extendedprice").alias("gross"))
    net = li.select(period, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    out = audit.source_contradiction(gross, net, "period", "gross", "net")
    return out.withColumns(
        {**{c: F.round(c, 2) for c in ("left_total", "right_total", "gap")}, **{c: F.round(c, 6) for c in ("left_growth", "right_growth", "gap_growth")}}
    )


@query(
    "leak_columns",
    """
    WITH t AS (
      SELECT (event_type = 'purchase')::INT AS y, CASE WHEN event_type = 'purchase' THEN value END AS purchase_value,
             CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_ref, json_extract_string(props, '$.k')::INT AS k FROM events),
    nulls AS (SELECT y, 'purchase_value' AS "column", (purchase_value IS NULL)::INT AS gone FROM t
              UNION ALL SELECT y, 'user_ref', (user_ref IS NULL)::INT FROM t UNION ALL SELECT y, 'k', (k IS NULL)::INT FROM t),
    r AS (SELECT "column", avg(gone) FILTER (WHERE y = 0)::DOUBLE AS r0, avg(gone) FILTER (WHERE y = 1)::DOUBLE AS r1 FROM nulls GROUP BY 1)
    SELECT "column", round(r0, 6) AS null_rate_0, round(r1, 6) AS null_rate_1, coalesce((r0 = 1 AND r1 < 0.99) OR (r1 = 1 AND r0 < 0.99), false) AS leaky FROM r
    """,
)
def leak_columns(spark, d):
    e = table(spark, d, "events")
    bought = F.col("event_type") == "purchase"
    rows = e.select(
        bought.cast("int").alias("y"), F.when(bought, F.col("value")).alias("purchase_value"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_ref"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    out = audit.leak_columns(rows, "y", ["purchase_value", "user_ref", "k"])
    return out.withColumns({c: F.round(c, 6) for c in ("null_rate_0", "null_rate_1")})


_MISSING = "(SELECT *, CASE WHEN l_quantity > 35 AND l_orderkey % 4 <> 0 THEN NULL ELSE l_tax END AS tax_seen FROM lineitem)"


def tax_with_gaps(spark, d):
    """lineitem with l_tax missing mostly on large quantities."""
    li = table(spark, d, "lineitem")
    hidden = (F.col("l_quantity") > 35) & (F.col("l_orderkey") % 4 != 0)
    return li.withColumn("tax_seen", F.when(~hidden, F.col("l_tax")))


@query(
    "missing_driver",
    f"""
    WITH c AS (
      SELECT 'l_quantity' AS feature, corr((tax_seen IS NULL)::INT, l_quantity) AS corr FROM {_MISSING}
      UNION ALL SELECT 'l_extendedprice', corr((tax_seen IS NULL)::INT, l_extendedprice) FROM {_MISSING}
      UNION ALL SELECT 'l_discount', corr((tax_seen IS NULL)::INT, l_discount) FROM {_MISSING})
    SELECT feature, round(corr, 6) AS corr, row_number() OVER (ORDER BY abs(corr) DESC, feature) = 1 AS driver FROM c
    """,
)
def missing_driver(spark, d):
    out = audit.missing_driver(tax_with_gaps(spark, d), "tax_seen", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("corr", F.round("corr", 6))


@query(
    "missing_rates",
    f"SELECT 'tax_seen' AS \"column\", round(avg((tax_seen IS NULL)::INT), 6) AS missing_rate FROM {_MISSING} UNION ALL SELECT 'l_discount', round(avg((l_discount IS NULL)::INT), 6) FROM {_MISSING}",
)
def missing_rates(spark, d):
    return audit.missing_rates(tax_with_gaps(spark, d), ["tax_seen", "l_discount"]).withColumn("missing_rate", F.round("missing_rate", 6))


@query(
    "cohort_profile",
    """
    WITH c AS (SELECT year(o_orderdate)::BIGINT AS cohort, count(*) AS n FROM orders GROUP BY 1)
    SELECT cohort, n, round((SELECT regr_slope(n, cohort) FROM c), 4) AS slope, round(n / sum(n) OVER (), 6) AS share FROM c
    """,
)
def cohort_profile(spark, d):
    out = audit.cohort_profile(table(spark, d, "orders"), F.year("o_orderdate").cast("bigint"))
    return out.select("cohort", "n", F.round("slope", 4).alias("slope"), F.round("share", 6).alias("share"))


@query(
    "drift",
    """
    WITH r AS (SELECT (o_orderstatus = 'F')::INT AS y, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / count(*) OVER () AS pos FROM orders),
    t AS (SELECT least(floor(pos * 5), 4)::INT AS part, count(*) AS n, avg(y) AS rate FROM r GROUP BY 1)
    SELECT part, n, round(rate, 6) AS rate, round((SELECT arg_max(rate, part) - arg_min(rate, part) FROM t), 6) AS shift FROM t
    """,
)
def drift(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    placed = sampling.equal_parts(o, ["o_orderdate", "o_orderkey"], 5)
    out = audit.drift_of_parts(placed, "y", F.col("part"))
    return out.withColumns({"rate": F.round("rate", 6), "shift": F.round("shift", 6)})


@query(
    "class_balance",
    """
    WITH c AS (SELECT quality AS class, count(*) AS n FROM labels GROUP BY 1)
    SELECT class, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / sum(n) OVER (), 6) AS majority_accuracy FROM c
    """,
)
def class_balance(spark, d):
    out = audit.class_balance(table(spark, d, "labels"), "quality")
    return out.withColumns({"share": F.round("share", 6), "majority_accuracy": F.round("majority_accuracy", 6)})


@query(
    "outliers_by_class",
    """
    WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events),
    f AS (SELECT event_type AS class, abs((value - m) / s) > 3 AS o FROM events, s),
    t AS (SELECT class, count(*) AS n, count(*) FILTER (WHERE o) AS outliers, avg(o::INT) AS outlier_rate FROM f GROUP BY 1)
    SELECT class, n, outliers, round(outlier_rate, 6) AS outlier_rate, round(outlier_rate / (SELECT sum(outliers) / sum(n) FROM t), 6) AS ratio FROM t
    """,
)
def outliers_by_class(spark, d):
    out = audit.outliers_by_class(table(spark, d, "events"), ["value"], "event_type")
    return out.withColumns({"outlier_rate": F.round("outlier_rate", 6), "ratio": F.round("ratio", 6)})


@query(
    "drop_outliers_of_class",
    """
    WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
    SELECT event_type, count(*) AS n, round(max(value), 4) AS max_value FROM events, s
    WHERE NOT (event_type = 'error' AND abs((value - m) / s) > 3) GROUP BY event_type
    """,
)
def drop_outliers_of_class(spark, d):
    kept = audit.drop_outliers_of_class(table(spark, d, "events").select("event_type", "value"), ["value"], "event_type", "error")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("max_value"))


@query(
    "int_categoricals",
    """
    SELECT 'p_size' AS "column", count(DISTINCT p_size) <= 50 AS categorical FROM part
    UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey) <= 50 FROM part
    """,
)
def int_categoricals(spark, d):
    return audit.integer_categoricals(table(spark, d, "part"), max_levels=50).select("column", "categorical")


_SUMMARY = ("c_mktsegment", "c_nationkey", "c_name")


@query(
    "table_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS type, (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM customer WHERE {c} IS NULL) AS missing,
        (SELECT count(DISTINCT {c}) FROM customer) AS distinct_values, top_value, top_rows
        FROM (SELECT {c}::VARCHAR AS top_value, count(*) AS top_rows FROM customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""
        for c, kind in zip(_SUMMARY, ("string", "int", "string"))
    ),
)
def table_profile(spark, d):
    return audit.column_summary(table(spark, d, "customer"), _SUMMARY)


@query(
    "integer_levels",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= 50 THEN count(DISTINCT {c}) END AS levels, count(DISTINCT {c}) <= 50 AS categorical FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    ),
)
def integer_levels(spark, d):
    return audit.integer_levels(table(spark, d, "lineitem"), max_levels=50)


@query(
    "rare_categories",
    """
    WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
    SELECT b::INT AS below, count(*) FILTER (WHERE n < b) AS categories, coalesce(sum(n) FILTER (WHERE n < b), 0)::BIGINT AS rows,
           count(*) AS all_categories, sum(n)::BIGINT AS all_rows FROM c, (SELECT unnest([50, 100]) AS b) GROUP BY b
    """,
)
def rare_categories(spark, d):
    return audit.rare_categories(table(spark, d, "part"), "p_name", [50, 100])


@query(
    "ood_range",
    """
    WITH t AS (SELECT *, year(o_orderdate) < 2000 AS tr FROM orders), b AS (SELECT min(o_totalprice) FILTER (WHERE tr) AS a, max(o_totalprice) FILTER (WHERE tr) AS b,
      min(o_totalprice) FILTER (WHERE NOT tr) AS c, max(o_totalprice) FILTER (WHERE NOT tr) AS d,
      min(o_orderkey) FILTER (WHERE tr) AS a2, max(o_orderkey) FILTER (WHERE tr) AS b2, min(o_orderkey) FILTER (WHERE NOT tr) AS c2, max(o_orderkey) FILTER (WHERE NOT tr) AS d2 FROM t)
    SELECT 'o_totalprice' AS "column", a::DOUBLE AS train_min, b::DOUBLE AS train_max, c::DOUBLE AS test_min, d::DOUBLE AS test_max,
      (SELECT count(*) FROM t WHERE NOT tr AND (o_totalprice < a OR o_totalprice > b)) AS out_of_range, (SELECT count(*) FROM t WHERE NOT tr) AS test_rows FROM b
    UNION ALL SELECT 'o_orderkey', a2::DOUBLE, b2::DOUBLE, c2::DOUBLE, d2::DOUBLE,
      (SELECT count(*) FROM t WHERE NOT tr AND (o_orderkey < a2 OR o_orderkey > b2)), (SELECT count(*) FROM t WHERE NOT tr) FROM b
    """,
)
def ood_range(spark, d):
    return audit.range_check(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], F.year("o_orderdate") < 2000)
