"""Cleaning, merging, audits, features, checks, logs, sources and streams on small fixtures."""

import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrobora.functions import scalars as S
from corrobora.functions import timezones as Z
from corrobora.operators import audit, expectations, features, merge, metrics, models, runlogs, sampling, timeseries
from corrobora.session import shared_dir
from corrobora.sources import readers, sinks
from corrobora.streaming import streams


def test_wall_clock_rules(spark):
    walls = {
        "2024-03-10 01:59:59": "2024-03-10 06:59:59",  # last second before the gap
        "2024-03-10 02:00:00": "2024-03-10 07:00:00",  # inside the gap: end of the gap
        "2024-03-10 02:30:00": "2024-03-10 07:00:00",
        "2024-03-10 03:00:00": "2024-03-10 07:00:00",
        "2024-03-10 03:30:00": "2024-03-10 07:30:00",
        "2024-11-03 00:59:59": "2024-11-03 04:59:59",
        "2024-11-03 01:30:00": None,  # happens twice
        "2024-11-03 02:00:00": "2024-11-03 07:00:00",
        "2024-07-01 12:00:00": "2024-07-01 16:00:00",
    }
    df = spark.createDataFrame([(w,) for w in walls], "w string").withColumn("n", F.col("w").cast("timestamp_ntz"))
    for r in df.select("w", Z.wall_to_utc("n", "US/Eastern").cast("string").alias("u")).collect():
        assert r.u == walls[r.w], r.w
    engine = df.select("w", Z.wall_to_utc("n", "US/Eastern", "offset", "earlier").cast("string").alias("u")).collect()
    assert {r.w: r.u for r in engine}["2024-03-10 02:30:00"] == "2024-03-10 07:30:00"
    assert {r.w: r.u for r in engine}["2024-11-03 01:30:00"] == "2024-11-03 05:30:00"


def test_text_helpers(spark):
    df = spark.createDataFrame([("$1,234.50", " x ", "A > B", "one\nreason=bad date\nreason=two"), ("n/a", "  ", "B<A", "none"), (None, None, "A=B", None)], "m string, b string, p string, t string")
    rows = df.select(
        S.currency("m").alias("m"), S.blank_to_null("b").alias("b"), S.ordered_pair("p").alias("p"),
        runlogs.failure_reason("t").alias("r"), S.matched_keywords("t", ["DATE", "zzz"]).alias("k"), S.truncate("t", 3).alias("s"),
    ).collect()
    assert [r.m for r in rows] == [1234.5, None, None]
    assert [r.b for r in rows] == ["x", None, None]
    assert [r.p for r in rows] == ["A>B", "A>B", None]
    assert [r.r for r in rows] == ["bad date", None, None]
    assert rows[0].k == ["DATE"] and rows[0].s == "one..." and rows[1].s == "non..."


def test_merge_first_source_wins(spark):
    a = spark.createDataFrame([(1, 5.0, "2024-01-01 00:00:00", 1), (2, 6.0, "2024-01-02 00:00:00", 2), (2, 7.0, "2024-01-02 00:00:00", 3)], "id int, amount double, at string, row int")
    b = spark.createDataFrame([(2, "$9.99", "2024-03-10 02:30:00", "", 1), (3, "$1.00", "2024-06-01 00:00:00", "SAVE", 2)], "id int, amount string, when string, code string, row int")
    out = merge.merge_sources(
        [
            (a, merge.SourceSpec("A", timestamp="at")),
            (b, merge.SourceSpec("B", "US/Eastern", {"when": "at"}, ["amount"], ["code"], "at", "yyyy-MM-dd HH:mm:ss")),
        ],
        ["id", "amount", "timestamp_utc", "code"], "id", "row",
    )
    rows = {r.id: r for r in out.collect()}
    assert rows[2].amount == 6.0 and rows[2].source == "A" and rows[2].code is None
    assert rows[3].timestamp_utc == "2024-06-01T04:00:00+00:00" and rows[3].code == "SAVE" and len(rows) == 3


def test_step_changes_keeps_keyless_rows(spark):
    df = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 4.0), ("q", 1, 9.0), (None, 1, 3.0)], "k string, v int, x double")
    got = {(r.k, r.v): r.delta_x for r in merge.step_changes(df, "k", ["v"], ["x"]).collect()}
    assert got == {("p", 1): 0.0, ("p", 2): 3.0, ("q", 1): 0.0, (None, 1): 0.0}


def test_join_loss_and_left_report(spark):
    fact = spark.createDataFrame([(1, "Q1", 10.0), (9, "Q1", 5.0), (None, "Q2", 1.0), (1, "Q4", 20.0)], "k int, q string, m double")
    dim = spark.createDataFrame([(1,), (1,)], "k int")
    r = audit.join_loss_audit(fact, dim, "k", "m").first()
    assert (r.rows_left, r.rows_inner, r.measure_left, r.measure_lost) == (4, 2, 36.0, 6.0)
    assert {x.m for x in audit.orphans(fact, dim, "k").collect()} == {5.0, 1.0}
    rep = {x.period: x for x in audit.left_report(fact, F.col("q"), F.col("m"), ["Q1", "Q2", "Q3", "Q4"]).collect()}
    assert rep["Q3"].total == 0 and rep["Q3"].underperforming and not rep["Q4"].underperforming and rep["Q1"].total == 15


def test_leak_and_outlier_audits(spark):
    rows = [(i, i % 10 == 0, "x" if i % 10 == 0 and i != 50 else None, 1.0 if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, y boolean, after string, noise double").withColumn("y", F.col("y").cast("int"))
    out = {r["column"]: r.leaky for r in audit.leak_columns(df, "y", ["after", "noise"]).collect()}
    assert out == {"after": True, "noise": False}
    v = spark.createDataFrame([(0, float(i % 5)) for i in range(300)] + [(0, 90.0), (1, 95.0)], "c int, v double")
    kept = audit.drop_outliers_of_class(v, ["v"], "c", 0)
    assert kept.filter("v > 50").collect()[0].c == 1 and kept.count() == 301


def test_longitudinal(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "k string, s int")
    r = audit.longitudinal_check(df, "k", "s").first()
    assert (r.keys, r.rows, r.repeated_keys, r.true_duplicates, r.longitudinal) == (2, 4, 2, 1, True)


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a = sampling.stratified_split(df, "y", ["id"], 0.8, seed=1)
    b = sampling.stratified_split(df.repartition(9), "y", ["id"], 0.8, seed=1)
    counts = {(r.y, r.split): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}
    assert a.exceptAll(b).count() == 0
    c = {r.split: r["count"] for r in sampling.chronological_split(df, ["id"], 0.8).groupBy("split").count().collect()}
    assert c == {"train": 800, "test": 200}
    s = sampling.stratified_sample(df, "y", ["id"], 7, seed=2)
    assert {r.y: r["count"] for r in s.groupBy("y").count().collect()} == {0: 7, 1: 7}


def test_quantile_to_normal_and_bins(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(size=300), np.zeros(100)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = features.quantile_to_normal(df, df, "x", 50, "z").toPandas().sort_values("x")
    refs = np.linspace(0, 1, 50)
    knots = np.quantile(x, refs)
    p = 0.5 * (np.interp(got.x, knots, refs) - np.interp(-got.x, -knots[::-1], -refs[::-1]))
    p = np.where(got.x <= knots[0], 0, np.where(got.x >= knots[-1], 1, p))
    z = [NormalDist().inv_cdf(min(max(v, 1e-7), 1 - 1e-7)) for v in p]
    np.testing.assert_allclose(got.z, z, atol=1e-8)
    bins = features.quantile_bins(df, df, "x", 4, "b").groupBy("b").count().toPandas()
    assert bins["count"].sum() == 400 and set(bins.b) <= {0, 1, 2, 3}


def test_target_encoding_excludes_own_fold(spark):
    df = spark.range(60).withColumns({"c": (F.col("id") % 3).cast("string"), "y": (F.col("id") % 2).cast("int")})
    out = features.target_encode(df, "c", "y", ["id"], 4, seed=3).toPandas()
    for _, r in out.iterrows():
        other = out[(out.c == r.c) & (out.fold != r.fold)]
        assert r.te_oof == pytest.approx(other.y.mean()) and r.te_leaky == pytest.approx(out[out.c == r.c].y.mean())


def test_ordinal_and_pool_rare(spark):
    df = spark.createDataFrame([("low",), ("high",), ("?",)], "e string")
    assert [r[0] for r in df.select(features.ordinal("e", ["low", "high"])).collect()] == [0, 1, None]
    train = spark.createDataFrame([("a",)] * 12 + [("b",)] * 2, "c string")
    test = spark.createDataFrame([("a",), ("b",), ("new",)], "c string")
    assert {r.c: r.c_pooled for r in features.pool_rare(test, train, "c", 10).collect()} == {"a": "a", "b": "infrequent", "new": None}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)
    c = metrics.classification(df.withColumn("p", F.lit(1)), "y", "p").first()
    assert c.recall == 1 and c.accuracy == 0.5 and c.constant_prediction


def test_logistic_matches_penalised_likelihood(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1] - 1)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    model = models.logistic(df, "y", ["a", "b"], tol=1e-10).stages[-1]
    w = np.zeros(3)
    d = np.column_stack([np.ones(400), x])
    for _ in range(50):  # Newton steps on the summed loss with unit penalty on the slopes
        p = 1 / (1 + np.exp(-d @ w))
        pen = np.diag([0.0, 1.0, 1.0])
        w -= np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + pen, d.T @ (p - y) + pen @ w)
    np.testing.assert_allclose([model.intercept, *model.coefficients], w, atol=1e-4)


def test_tree_models_run(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "c": rng.choice(["u", "v"], 300)})
    pdf["y"] = ((pdf.a > 0) ^ (pdf.c == "u")).astype(int)
    df = spark.createDataFrame(pdf)
    m = models.random_forest(df, "y", ["a"], ["c"], trees=10, depth=4)
    assert metrics.roc_auc(models.predictions(m, df, ["y"]), "y", "score").first().auc > 0.95
    top = models.importances(m, df).filter("rank = 1").first()
    assert top.feature == "a" or top.feature.startswith("c_hot")
    g = models.boosted_trees(df, "y", ["a"], ["c"], rounds=3)
    assert metrics.classification(models.predictions(g, df, ["y"]), "y", "prediction").first().accuracy > 0.9


def test_change_point_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=140), rng.normal(size=110) + 2])
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(250), "x": x})).repartition(6)
    score = [abs(x[i:].mean() - x[:i].mean()) for i in range(30, 220)]
    for n in (1, 8):
        r = timeseries.change_point(df, ["t"], "x", 30, n_buckets=n).first()
        assert r.break_idx == 30 + int(np.argmax(score)) and r.score == pytest.approx(max(score))
    flat = timeseries.change_point(spark.range(20).select("id", F.lit(4.0).alias("x")), ["id"], "x", 3).first()
    assert flat.break_idx == 10 and flat.score == 0 and flat.break_at is None
    short = timeseries.change_point(df.limit(20), ["t"], "x", 30).first()
    assert short.break_idx == 10 and short.score == 0
    assert timeseries.after_break(df, ["t"], "x", 30).count() == 250 - (30 + int(np.argmax(score)))


def test_decomposition_brute_force(spark):
    n = 40
    i = np.arange(n)
    x = 5 + 0.3 * i + np.sin(2 * np.pi * i / 12) + np.random.default_rng(7).normal(size=n) * 0.1
    dates = pd.date_range("2020-01-01", periods=n, freq="MS").date
    out = timeseries.seasonal_decompose(spark.createDataFrame(pd.DataFrame({"m": dates, "x": x})), "m", "x", 12).toPandas().sort_values("m")
    w = np.r_[0.5, np.ones(11), 0.5] / 12
    raw = np.convolve(x, w, "valid")
    trend = np.full(n, np.nan)
    trend[6 : n - 6] = raw
    k = np.polyfit(i[6:18], trend[6:18], 1)
    trend[:6] = np.polyval(k, i[:6])
    k = np.polyfit(i[n - 19 : n - 7], trend[n - 19 : n - 7], 1)
    trend[n - 6 :] = np.polyval(k, i[n - 6 :])
    phase = np.array([(x - trend)[p::12].mean() for p in range(12)])
    np.testing.assert_allclose(out.trend, trend, rtol=1e-9)
    np.testing.assert_allclose(out.seasonal, (phase - phase.mean())[i % 12], atol=1e-9)


def test_resample_fills_gap_months(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5), 1.0), (dt.date(2024, 4, 1), 2.0)], "d date, v double")
    rows = {str(r.period): (r.total, r.n) for r in timeseries.resample(df, "d", "v").collect()}
    assert rows == {"2024-01-01": (1.0, 1), "2024-02-01": (0.0, 0), "2024-03-01": (0.0, 0), "2024-04-01": (2.0, 1)}


def test_expectations_find_each_fault(spark):
    df = spark.createDataFrame([(1, 5.0, "2024-01-01T00:00:00+00:00"), (1, -1.0, "2024-01-01T00:00:00-05:00"), (3, None, "bad")], "id int, amount double, ts string")
    need = spark.createDataFrame([(1,), (2,)], "id int")
    rep = (
        expectations.Expectations(df).columns(["id", "amount", "ts"]).row_count(3).unique("id").positive("amount").utc_text("ts")
        .has_keys(need, "id").domain("id", [1, 3]).not_constant("id").recall("id", [1, 3, 8], 2, (2, 5)).numeric("ts").prefix("ts", "2024")
        .close("sum", F.sum("amount"), 4.0, 0.1).at_most_ratio("max", F.max("amount"), df.agg(F.lit(2.0)), 1.3).report()
    )
    got = {r.check: (r.ok, r.detail) for r in rep.collect()}
    assert got["columns"][0] and got["row_count"] == (True, "3") and got["unique:id"] == (False, "1")
    assert got["positive:amount"] == (False, "2") and got["utc:ts"] == (False, "2") and got["has_keys:id"] == (False, "1")
    assert got["domain:id"][0] and got["not_constant:id"][0] and got["recall:id"] == (True, "3/3")
    assert got["numeric:ts"] == (False, "3") and got["prefix:ts"] == (False, "1") and got["close:sum"][0] and not got["ratio:max"][0]
    v = expectations.verdict(rep).first()
    assert v.reward == 0 and v.reason == "unique:id: 1"


def test_report_documents(spark):
    docs = spark.createDataFrame(
        [(1, json.dumps({"v": 1.5, "ci": [-2, 60]})), (2, json.dumps({"v": "x", "ci": [5, 4]})), (3, "not json")], "i int, t string"
    )
    rows = {r.i: r for r in expectations.json_report_checks(docs, "t", ["v", "ci"], ["v"], "ci", 50).collect()}
    assert rows[1].ok and rows[1].contains_zero and not rows[2].ok and rows[2].not_numeric == ["v"] and rows[3].missing_keys == ["v", "ci"]
    words = spark.createDataFrame([("We used Mann-Whitney",), ("t-test and Mann-Whitney",), ("none",)], "t string")
    assert [r.ok for r in expectations.keyword_check(words, "t", ["mann-whitney"], ["t-test"]).collect()] == [True, False, False]


def test_log_tree(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    for task, rewards in {"easy": ["1", "1.0", "1"], "hard": ["0", None, "junk", "1"]}.items():
        for i, r in enumerate(rewards, 1):
            put(f"{task}/trial{i}/config.json", "{}")
            if r is not None:
                put(f"{task}/trial{i}/verifier/reward.txt", r + "\n")
    steps = [{"step_id": 1, "source": "user", "message": "go"}, {"step_id": 2, "source": "agent", "message": "done", "tool_calls": [{"tool_call_id": "1", "function_name": "run"}, {"tool_call_id": "2", "function_name": "run"}]}, {"step_id": 3, "source": "agent", "message": ""}]
    put("easy/trial1/agent/trajectory.json", json.dumps({"session_id": "s", "steps": steps}, indent=1))
    root = str(tmp_path)
    all_ = runlogs.with_missing_trials(readers.read_rewards(spark, root), readers.read_trials(spark, root))
    rates = {r.task: r for r in runlogs.pass_rates(all_).collect()}
    assert rates["easy"].pass_at_1 == 1 and rates["hard"].pass_at_1 == 0.25 and rates["hard"].pass_at_k == 0 and rates["hard"].trials == 4
    t = readers.read_trajectories(spark, root)
    c = runlogs.step_counts(t, ["task"]).first()
    assert (c.steps, c.agent_steps, c.tool_calls) == (3, 2, 2)
    assert t.select(runlogs.last_message_of("steps", "agent")).first()[0] == "done"
    assert runlogs.tool_usage(t, ["task", "trial"]).first().calls == 2
    md = sinks.markdown_lines(runlogs.pass_rates(all_), ["task", "trials"], ["task"]).orderBy("line").collect()
    assert [r.text for r in md] == ["| task | trials |", "|---|---|", "| easy | 3 |", "| hard | 4 |"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", dt.date(2024, 2, 1)), (2, None, None)], "i int, s string, d date")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out"), "i int, s string, d date")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_report(df.select(F.struct("i", "s").alias("r"), F.array("i").alias("l")), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 2


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i), float(i % 7), f"k{i // 2}") for i in range(24 * 6)]
    spark.createDataFrame(rows, "id int, ts timestamp, v double, k string").coalesce(1).write.parquet(str(src))
    live = spark.readStream.schema("id int, ts timestamp, v double, k string").parquet(str(src))
    streams.run_available(streams.daily_profile_stream(live, "ts", "v", "1 hour"), out)
    got = {r.day: (r.n, r.daily_sum) for r in spark.read.parquet(out).collect()}
    want = {r.day: (r.n, r.daily_sum) for r in timeseries.daily_profile(spark.read.parquet(str(src)), "ts", "v").collect()}
    assert len(got) >= 4 and all(want[d] == v for d, v in got.items())
    first = streams.first_wins_stream(live, "k", "ts", "2 hours")
    streams.run_available(first, out + "2")
    assert spark.read.parquet(out + "2").select("k").distinct().count() == spark.read.parquet(out + "2").count() == 72
    assert shared_dir(spark)
    late = streams.late_rows(spark.read.parquet(str(src)), spark.createDataFrame([(dt.date(2024, 1, 2),)], "day date"), "ts", "k")
    assert late.count() == 12 and {r.id % 2 for r in late.collect()} == {0}
    live_late = streams.late_rows(live, spark.createDataFrame([(dt.date(2024, 1, 2),)], "day date"), "ts", "id", "2 days")
    streams.run_available(live_late, out + "3")
    assert spark.read.parquet(out + "3").count() == 24


def test_conversion_stream_feeds_peeking(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=i), "A" if i % 2 else "B", int(i % 5 == 0)) for i in range(72)]
    spark.createDataFrame(rows, "ts timestamp, v string, c int").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("ts timestamp, v string, c int").parquet(str(tmp_path / "in"))
    daily = streams.conversion_stream(live, "ts", F.col("v"), F.col("c"), "A", "B")
    q = daily.writeStream.format("memory").queryName("daily_conv").outputMode("complete").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("daily_conv").agg(F.sum("n_a") + F.sum("n_b")).first()[0] == 72


def test_storage_is_shared_or_refused(spark):
    from corrobora import session

    class Cluster:
        conf = {"spark.master": "spark://a:7077"}

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())
    with pytest.raises(ValueError):
        Cluster.conf = {"spark.master": "local-cluster[3,2,1024]"}
        session.shared_dir(Cluster())
    df = session.staged(spark.range(50).repartition(4))
    assert df.count() == 50 and os.listdir(session._staging_dir(spark))
    session.drop_staged(spark)
    assert not os.path.exists(session._staging_dir(spark))


def test_pass_rates_with_a_hot_task(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise(F.lit("a")).alias("task"), F.col("id").alias("trial"), (F.col("id") == 4).cast("double").alias("reward"))
    out = {r.task: r for r in runlogs.pass_rates(rows, 3).collect()}
    assert out["a"].trials == 4500 and out["a"].pass_at_k == 0 and out["b"].trials == 500
    assert {r.task: r.pass_at_k for r in runlogs.pass_rates(rows, 4).collect()} == {"a": 1, "b": 0}


def test_hot_key_history_is_spread(spark):
    """One key holds 90 % of the rows: no (key, bucket) cell may hold more than a small part of them."""
    from corrobora.operators import scan

    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise(F.lit("a")).alias("k"), (F.col("id") / 3).alias("x"))
    cells = scan.range_buckets(df, "id", 16).groupBy("k", "_bucket").count()
    assert cells.agg(F.max("count")).first()[0] < 400
    out = merge.step_changes(df, "k", ["id"], ["x"])
    assert out.count() == 4000 and out.filter("k = 'a' AND delta_x = 0").count() == 1


def test_tree_fit_does_not_depend_on_partitioning(spark):
    df = spark.range(300).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), (F.sin("id") > 0.2).cast("int").alias("y"))
    fits = [models.random_forest(x, "y", ["a", "b"], trees=5, depth=3, row_id=["id"]) for x in (df, df.repartition(5), df.orderBy(F.desc("id")))]
    weights = [tuple(round(float(v), 9) for v in m.stages[-1].featureImportances.toArray()) for m in fits]
    assert len(set(weights)) == 1


def test_replayed_streams(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=2 * i), float(i), base + dt.timedelta(hours=2 * i + 1)) for i in range(12 * 20)]
    rows += [(i, t, v, a + dt.timedelta(hours=5)) for i, t, v, a in rows if i % 7 == 0]  # again, in time
    rows += [(i, t, v, a + dt.timedelta(days=9)) for i, t, v, a in rows[:240] if i % 11 == 0]  # again, when the day is reported
    rows += [(1000 + i, base + dt.timedelta(days=i, hours=3), 0.5, base + dt.timedelta(days=i + 8)) for i in range(12)]  # late for the first time
    rows += [(1000, base, 9.0, base + dt.timedelta(days=19)), (None, base, 1.0, base), (2000, None, 1.0, base)]
    log = spark.createDataFrame(rows, "id bigint, ts timestamp, v double, arrived timestamp")
    late = lambda s: streams.late_arrivals_stream(s, "id", "ts", "arrived", dt.timedelta(days=2), buckets=3)
    first = lambda s: streams.first_wins_stream(s.filter("id IS NOT NULL AND ts IS NOT NULL"), "id", "ts", "2 days")
    got, kept = (f.collect() for f in streams.replay(log, "arrived", dt.timedelta(days=5), [late, first]))
    assert sorted((r.id, r.v) for r in got) == [(1000 + i, 0.5) for i in range(12)]
    assert sorted(r.id for r in kept if r.id < 1000) == list(range(240))
    none = streams.replay(log.limit(0), "arrived", dt.timedelta(days=2), [late, first])
    assert [f.count() for f in none] == [0, 0] and none[0].schema == log.schema


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    """A run that dies leaves the sink as it was; the next one under its name neither loses nor repeats rows."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = dt.datetime(2024, 1, 1)
    part = lambda a, b: spark.createDataFrame([(i, base + dt.timedelta(minutes=i)) for i in range(a, b)], "id bigint, ts timestamp")
    part(0, 50).write.mode("append").parquet(src)
    live = spark.readStream.schema("id bigint, ts timestamp").parquet(src)
    name = os.path.basename(str(tmp_path))
    streams.run_available(streams.first_wins_stream(live, "id", "ts"), out, name=name)
    part(40, 90).write.mode("append").parquet(src)
    broken = live.withColumn("id", F.when(F.col("id") == 60, F.raise_error("lost").cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        streams.run_available(streams.first_wins_stream(broken, "id", "ts"), out, name=name)
    assert spark.read.parquet(out).count() == 50
    streams.run_available(streams.first_wins_stream(live, "id", "ts"), out, name=name)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(90))
