"""Output checks and run-log analytics on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import expectations as E
from ..operators import runlogs as L
from ..session import staged
from ..sources.readers import table
from ..sources.sinks import keyed_map, markdown_lines, report_json
from .inference import rounded
from .registry import query
from .relational import MERGE_COLUMNS, MERGED_SQL, merged_orders


_COLS = [*MERGE_COLUMNS, "source", "source_tz"]


def merge_report(spark, d):
    """All checks of the merged transactions in one report."""
    merged = staged(merged_orders(spark, d))  # checks look at a written output
    orders = table(spark, d, "orders")
    keys = orders.select(F.col("o_orderkey").alias("transaction_id"))
    expected = keys.distinct().agg(F.count("*"))
    total = orders.agg(F.sum("o_totalprice"))
    checks = (
        E.Expectations(merged)
        .columns(_COLS)
        .row_count(expected)
        .unique("transaction_id")
        .positive("amount")
        .not_null("timestamp_utc")
        .utc_text("timestamp_utc")
        .null_where("discount_code", F.col("source").isin("Q1", "Q2"), "Q1,Q2")
        .has_keys(keys, "transaction_id")
        .between("amount", 0, 10_000_000)
        .domain("source", ["Q1", "Q2", "Q3"])
        .not_constant("source")
        .close("total_amount", F.sum("amount"), total, 1.0)
        .band("urgent_share", F.avg(F.col("discount_code").isNotNull().cast("int")), 0.0, 0.5)
    )
    return checks.report()


CHECKS_SQL = (
    MERGED_SQL
    + f""", co AS (SELECT string_agg(column_name, ',' ORDER BY column_index) AS names FROM (SELECT unnest(json_keys(to_json(m))) AS column_name, generate_subscripts(json_keys(to_json(m)), 1) AS column_index FROM (SELECT * FROM merged LIMIT 1) m)),
    c AS (SELECT count(*) AS n, count(*) - count(DISTINCT transaction_id) AS dup, count(*) FILTER (WHERE amount IS NULL OR amount <= 0) AS pos, count(*) FILTER (WHERE timestamp_utc IS NULL) AS nn,
      count(*) FILTER (WHERE NOT coalesce(timestamp_utc LIKE '%+00:00', false)) AS utc, count(*) FILTER (WHERE source IN ('Q1', 'Q2') AND discount_code IS NOT NULL) AS nw,
      (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT transaction_id FROM merged)) AS miss, count(*) FILTER (WHERE NOT amount BETWEEN 0 AND 10000000) AS btw,
      count(*) FILTER (WHERE source NOT IN ('Q1', 'Q2', 'Q3')) AS dom, (SELECT count(DISTINCT o_orderkey) FROM orders) AS want, min(source) AS lo, max(source) AS hi,
      sum(amount) AS total, (SELECT sum(o_totalprice) FROM orders) AS want_total, avg((discount_code IS NOT NULL)::INT) AS urgent FROM merged),
    checks AS (
    SELECT 1 AS seq, 'columns' AS "check", names = '{",".join(_COLS)}' AS ok, names AS detail FROM co
    UNION ALL SELECT 2, 'row_count', n = want, n::VARCHAR FROM c UNION ALL SELECT 3, 'unique:transaction_id', dup = 0, dup::VARCHAR FROM c
    UNION ALL SELECT 4, 'positive:amount', pos = 0, pos::VARCHAR FROM c UNION ALL SELECT 5, 'not_null:timestamp_utc', nn = 0, nn::VARCHAR FROM c
    UNION ALL SELECT 6, 'utc:timestamp_utc', utc = 0, utc::VARCHAR FROM c UNION ALL SELECT 7, 'null_where:discount_code:Q1,Q2', nw = 0, nw::VARCHAR FROM c
    UNION ALL SELECT 8, 'has_keys:transaction_id', miss = 0, miss::VARCHAR FROM c UNION ALL SELECT 9, 'between:amount', btw = 0, btw::VARCHAR FROM c
    UNION ALL SELECT 10, 'domain:source', dom = 0, dom::VARCHAR FROM c UNION ALL SELECT 11, 'not_constant:source', lo <> hi, lo FROM c
    UNION ALL SELECT 12, 'close:total_amount', abs(total - want_total) <= 1.0, NULL FROM c UNION ALL SELECT 13, 'band:urgent_share', urgent BETWEEN 0.0 AND 0.5, NULL FROM c)"""
)


@query("expectations", CHECKS_SQL + " SELECT * FROM checks")
def expectations(spark, d):
    out = merge_report(spark, d)
    # the last two details are sums of floating point numbers; their verdict is compared
    return out.withColumn("detail", F.when(F.col("seq") < 12, F.col("detail")))


@query(
    "expectation_verdict",
    CHECKS_SQL + """ SELECT count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, bool_and(ok)::INT AS reward,
    arg_min("check" || ': ' || detail, seq) FILTER (WHERE NOT ok) AS reason FROM checks""",
)
def expectation_verdict(spark, d):
    return E.verdict(merge_report(spark, d))


@query(
    "check_kinds",
    """WITH n AS (SELECT count(*) FILTER (WHERE NOT coalesce(starts_with(p_name, 'a'), false)) AS pre, count(*) FILTER (WHERE p_type IS NOT NULL AND TRY_CAST(p_type AS DOUBLE) IS NULL) AS num,
      count(*) FILTER (WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) AS hits, count(*) AS n, sum(p_size) AS size, (SELECT count(*) * 20 FROM part) AS base,
      count(*) FILTER (WHERE NOT coalesce(starts_with(upper(trim(p_brand)), 'BRAND#'), false)) AS brand FROM part)
    SELECT 1 AS seq, 'prefix:p_name' AS "check", pre = 0 AS ok, pre::VARCHAR AS detail FROM n
    UNION ALL SELECT 2, 'numeric:p_type', num = 0, num::VARCHAR FROM n
    UNION ALL SELECT 3, 'recall:p_brand', hits >= 1 AND n BETWEEN 1 AND 150, hits || '/' || n FROM n
    UNION ALL SELECT 4, 'ratio:size', size <= 1.5 * base, NULL FROM n
    UNION ALL SELECT 5, 'prefix:brand', brand = 0, brand::VARCHAR FROM n""",
)
def check_kinds(spark, d):
    """Prefix, strict numbers, recall of known items and a ratio to a recomputed baseline, passed and failed alike."""
    part = table(spark, d, "part").withColumn("brand", S.normal_text("p_brand"))
    checks = (
        E.Expectations(part)
        .prefix("p_name", "a")
        .numeric("p_type")
        .recall("p_brand", ["Brand#1", "Brand#2", "Brand#3"], 1, (1, 150))
        .at_most_ratio("size", F.sum("p_size"), part.agg(F.count("*") * 20), 1.5)
        .prefix("brand", "BRAND#")
    )
    return checks.report().withColumn("detail", F.when(F.col("seq") != 4, F.col("detail")))


@query(
    "keyword_check",
    """SELECT p_partkey, regexp_matches(lower(p_name), 'a|e') AND NOT regexp_matches(lower(p_name), 'red|1') AS ok,
       coalesce(regexp_matches(lower(p_name), 'a|e'), false)::INT AS accepted FROM part""",
)
def keyword_check(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    out = E.keyword_check(part, "p_name", ["A", "e"], ["red", "1"])
    return out.select("p_partkey", "ok", S.indicator(S.contains_any("p_name", ["a", "E"])).alias("accepted"))


@query(
    "json_report_checks",
    """SELECT event_id, [x FOR x IN ['k', 'w'] IF NOT list_contains(json_keys(props), x)] AS missing_keys, try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NULL AS k_bad FROM events""",
)
def json_report_checks(spark, d):
    out = E.json_report_checks(table(spark, d, "events").select("event_id", "props"), "props", ["k", "w"], ["k"])
    return out.select("event_id", "missing_keys", (F.size("not_numeric") > 0).alias("k_bad"))


@query(
    "interval_checks",
    """WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM events GROUP BY 1),
    i AS (SELECT user_id, m - 40 - 1.96 * s / sqrt(n) AS low, m - 30 + 1.96 * s / sqrt(n) AS high FROM s)
    SELECT user_id, low < high AND high - low >= 12 AS ok, low <= 0 AND high >= 0 AS contains_zero FROM i""",
)
def interval_checks(spark, d):
    """Interval reports written per user as JSON text and checked like any submitted report."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), (1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("h"))
    docs = s.select("user_id", F.to_json(F.struct(F.array(F.col("m") - 40 - F.col("h"), F.col("m") - 30 + F.col("h")).alias("interval"), F.col("m").alias("estimate"))).alias("doc"))
    return E.json_report_checks(docs, "doc", ["interval", "estimate"], ["estimate"], "interval", 12.0).select("user_id", "ok", "contains_zero")


@query(
    "direction_checks",
    """WITH m AS (SELECT o_orderpriority[1:1] AS g, avg(o_totalprice) AS m FROM orders GROUP BY 1), s AS (SELECT CASE WHEN a.m > b.m THEN a.g || '>' || b.g ELSE b.g || '>' || a.g END AS p FROM m a JOIN m b ON a.g < b.g),
    l AS (SELECT list(p) AS l FROM s)
    SELECT list_filter(['1>2', '2>1', '3>4', '4>3'], lambda x: NOT list_contains(l, x)) AS missing, list_filter(['5>1'], lambda x: list_contains(l, x)) AS forbidden_found FROM l""",
)
def direction_checks(spark, d):
    from ..operators.hypothesis import all_pairs

    m = table(spark, d, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("g")).agg(F.avg("o_totalprice").alias("m"))
    said = all_pairs(m, "g", ["m"]).select(F.when(F.col("m_a") > F.col("m_b"), F.concat_ws(" > ", "a", "b")).otherwise(F.concat_ws(" < ", "a", "b")).alias("txt"))
    return E.direction_check(said, "txt", ["1>2", "2>1", "3>4", "4>3"], ["5>1"]).select("missing", "forbidden_found")


# ---- run logs -----------------------------------------------------------------------------

MARKERS = [("short", ["the "]), ("question", ["?"]), ("code", ["def ", "{"])]


def trials(spark, d):
    """Conversations as trial logs: task = conv_id mod 12, reward 1 when the last answer is long."""
    c = table(spark, d, "conversations")
    last = L.last_message(c, ["conv_id"], "turn", "role", "text", "assistant", 400)
    size = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by(F.length("text"), "turn").alias("chars"))
    known = c.select("conv_id").distinct()
    rows = known.join(size, "conv_id", "left").select(
        F.concat(F.lit("task"), F.col("conv_id") % 12).alias("task"), F.col("conv_id").alias("trial"),
        F.when(F.col("conv_id") % 5 != 0, (F.col("chars") > 150).cast("double")).alias("reward"),
    )
    return rows, last


TRIALS = """sz AS (SELECT conv_id, arg_max(length(text), turn) AS chars FROM conversations WHERE role = 'assistant' GROUP BY 1),
tr AS MATERIALIZED (SELECT 'task' || (k.conv_id % 12) AS task, k.conv_id AS trial, coalesce(CASE WHEN k.conv_id % 5 <> 0 THEN (chars > 150)::INT::DOUBLE END, 0.0) AS reward FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sz USING (conv_id)),
nt AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY trial) AS nth FROM tr),
rt AS MATERIALIZED (SELECT task, count(*) AS trials, avg(reward) AS pass_at_1, max((nth <= 3 AND reward >= 1)::INT) AS pass_at_k FROM nt GROUP BY task)"""


def rates(spark, d):
    rows, _ = trials(spark, d)
    return L.pass_rates(L.with_missing_trials(rows.filter("reward IS NOT NULL"), rows))


@query(
    "pass_at_k",
    f"WITH {TRIALS} SELECT task, trials, round(pass_at_1, 6) AS pass_at_1, pass_at_k, round(1 - pow(1 - pass_at_1, 3), 6) AS estimate, row_number() OVER (ORDER BY pass_at_1, task)::INT AS difficulty FROM rt",
)
def pass_at_k(spark, d):
    out = L.by_difficulty(rates(spark, d)).withColumn("estimate", L.pass_at_k_estimate("pass_at_1", 3))
    return rounded(out.select("task", "trials", "pass_at_1", "pass_at_k", "estimate", "difficulty"), "pass_at_1", "estimate")


@query("pass_at_k_macro", f"WITH {TRIALS} SELECT count(*) AS tasks, round(avg(pass_at_1), 6) AS pass_at_1, round(avg(pass_at_k), 6) AS pass_at_k FROM rt")
def pass_at_k_macro(spark, d):
    return rounded(L.macro_average(rates(spark, d)), "pass_at_1", "pass_at_k")


@query(
    "pass_table_markdown",
    f"""WITH {TRIALS} SELECT 0::BIGINT AS line, '| task | trials | pass_at_k |' AS text UNION ALL SELECT 1, '|---|---|---|'
    UNION ALL SELECT 1 + row_number() OVER (ORDER BY task), '| ' || task || ' | ' || trials || ' | ' || pass_at_k || ' |' FROM rt""",
)
def pass_table_markdown(spark, d):
    return markdown_lines(rates(spark, d), ["task", "trials", "pass_at_k"], ["task"])


@query(
    "last_message",
    """WITH m AS (SELECT conv_id, arg_max(text, turn) AS t, count(*) AS messages FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY 1)
    SELECT conv_id, CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '...' ELSE t END AS message, messages FROM m""",
)
def last_message(spark, d):
    return trials(spark, d)[1]


@query(
    "failure_reasons",
    """WITH m AS (SELECT conv_id, turn, text, list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the '))[1] AS line FROM conversations)
    SELECT conv_id, turn, CASE WHEN line IS NULL THEN NULL WHEN regexp_extract(trim(line), 'the (.+)$', 1) <> '' THEN regexp_extract(trim(line), 'the (.+)$', 1) ELSE trim(line) END AS reason FROM m""",
)
def failure_reasons(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", L.failure_reason("text", marker="the ").alias("reason"))


@query(
    "failure_rules",
    """SELECT role, CASE WHEN contains(lower(text), 'the ') THEN 'short' WHEN contains(text, '?') THEN 'question' WHEN contains(lower(text), 'def ') OR contains(text, '{') THEN 'code' ELSE 'other' END AS kind, count(*) AS n
    FROM conversations GROUP BY ALL""",
)
def failure_rules(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role", L.classify("text", MARKERS, "other").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "keyword_hits",
    """SELECT doc_id, [k FOR k IN ['the', 'License', 'password', 'http'] IF contains(lower(text), lower(k))] AS found FROM documents""",
)
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", S.matched_keywords("text", ["the", "License", "password", "http"]).alias("found"))


def trajectories(spark, d):
    """Events as nested trajectories: 64 consecutive events make one document, so none grows with the table."""
    e = table(spark, d, "events")
    calls = F.when(F.col("event_type") == "click", F.array(F.struct(F.col("event_id").cast("string").alias("tool_call_id"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("function_name"))))
    step = F.struct(
        F.col("event_id").alias("step_id"), F.when(F.col("event_type") == "error", F.lit("user")).otherwise(F.lit("agent")).alias("source"),
        F.col("event_type").alias("message"), calls.alias("tool_calls"),
    )
    return e.groupBy(F.floor(F.col("event_id") / 64).alias("doc")).agg(F.array_sort(F.collect_list(step)).alias("steps"))


@query(
    "nested_steps",
    """SELECT event_id // 64 AS doc, count(*)::INT AS steps, (count(*) FILTER (WHERE event_type <> 'error'))::INT AS agent_steps, (count(*) FILTER (WHERE event_type = 'click'))::INT AS tool_calls,
    arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error') AS last_said FROM events GROUP BY ALL""",
)
def nested_steps(spark, d):
    t = trajectories(spark, d)
    counts = L.step_counts(t.withColumn("last_said", L.last_message_of("steps", "agent")), ["doc", "last_said"])
    return counts


@query(
    "tool_usage",
    """WITH c AS (SELECT 'f' || json_extract_string(props, '$.k') AS f, event_id // 64 AS doc FROM events WHERE event_type = 'click')
    SELECT f AS function_name, count(*) AS calls, count(DISTINCT doc) AS trajectories FROM c GROUP BY 1""",
)
def tool_usage(spark, d):
    return L.tool_usage(trajectories(spark, d), ["doc"])


@query(
    "usage_totals",
    """SELECT 'task' || (user_id % 12) AS task, count(*) AS trials, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens, round(sum(value), 2) AS cost, round(sum(epoch_us(ts) - epoch_us(ts::DATE)) / 1e6, 0) AS seconds
    FROM events GROUP BY 1""",
)
def usage_totals(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("task"), F.col("user_id") % 12).alias("task"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"),
        F.col("value").alias("cost"), F.date_trunc("day", "ts").alias("started"), F.col("ts").alias("finished"),
    )
    return L.usage(rows).withColumns({"cost": F.round("cost", 2), "seconds": F.round("seconds", 0)})


@query(
    "reward_distribution",
    f"""WITH {TRIALS} SELECT 'job' || (trial // 60) AS job, reward, count(*) AS trials FROM tr GROUP BY ALL""",
)
def reward_distribution(spark, d):
    rows, _ = trials(spark, d)
    scored = L.with_missing_trials(rows.filter("reward IS NOT NULL"), rows)
    # a job document lists at most 60 trials
    job = F.concat(F.lit("job"), F.floor(F.col("trial") / 60))
    lists = scored.groupBy(job.alias("job"), "reward").agg(F.collect_list(F.col("trial").cast("string")).alias("names"))
    jobs = lists.groupBy("job").agg(F.map_from_entries(F.collect_list(F.struct("reward", "names"))).alias("reward"))
    return L.reward_distribution(jobs)


@query(
    "report_document",
    """SELECT '{"medians":{' || string_agg('"' || o_orderpriority || '":' || n, ',' ORDER BY o_orderpriority) || '},"rows":' || sum(n)::BIGINT || '}' AS report
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""",
)
def report_document(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return report_json(counts.agg(keyed_map("o_orderpriority", "n").alias("medians"), F.sum("n").alias("rows")))


@query(
    "strict_numbers",
    """SELECT count(*) AS rows, count(try_cast(regexp_replace(t, '[$]', '') AS DOUBLE)) AS parsed, round(sum(try_cast(regexp_replace(t, '[$]', '') AS DOUBLE)), 2) AS total FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE '$' || o_totalprice END AS t FROM orders)""",
)
def strict_numbers(spark, d):
    o = table(spark, d, "orders")
    t = F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    v = S.currency(t)
    return o.agg(F.count("*").alias("rows"), F.count(v).alias("parsed"), F.round(F.sum(v), 2).alias("total"))


