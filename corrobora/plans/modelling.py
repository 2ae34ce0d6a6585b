"""Regression, diagnostics and resampling on the standard tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features as P
from ..operators import regression as G
from ..sources.readers import table
from . import sqlkit as K
from .inference import rounded
from .registry import query
from .relational import _MISSING, tax_with_gaps

XS = ["l_quantity", "l_discount", "l_tax"]
Y = "l_extendedprice"


def _coef_query(ctes, fit, xs, names=None, digits=4, const=True, se_digits=4):
    rows = K.term_rows(fit, xs, names, const)
    return K.with_ctes(
        [*ctes, f"tr AS MATERIALIZED (SELECT *, coef / se AS t FROM ({rows}))"],
        f"SELECT term, round(coef, {digits}) AS coef, round(se, {se_digits}) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p FROM tr",
    )


def coef_rounded(df, digits=4, se_digits=4):
    out = df.withColumns({"coef": F.round("coef", digits), "se": F.round("se", se_digits), "t": F.round("t", 4), "p": F.round("p", 6)})
    return out


@query("ols_report", _coef_query(K.ols_ctes("f", "lineitem", XS, Y), "f", XS))
def ols_report(spark, d):
    return coef_rounded(G.ols(table(spark, d, "lineitem"), XS, Y))


@query(
    "ols_by_group",
    K.with_ctes(
        [*K.ols_ctes("f", "lineitem", XS, Y, ["l_returnflag"]),
         f"tr AS MATERIALIZED (SELECT *, coef / se AS t FROM ({K.term_rows('f', XS, extra='l_returnflag, ')}))"],
        f"SELECT l_returnflag, term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p FROM tr",
    ),
)
def ols_by_group(spark, d):
    return coef_rounded(G.ols(table(spark, d, "lineitem"), XS, Y, ["l_returnflag"]))


@query(
    "fit_summary",
    K.with_ctes(
        K.ols_ctes("f", "lineitem", XS, Y),
        f"""SELECT n::BIGINT AS n, 3 AS predictors, round(1 - sse / syy, 8) AS r2, round(1 - (sse / syy) * (n - 1) / (n - 4), 8) AS adj_r2, (n - 4)::DOUBLE AS df_resid,
        round(((1 - sse / syy) / 3) / ((sse / syy) / (n - 4)), 6) AS f, round({K.f_p('((1 - sse / syy) / 3) / ((sse / syy) / (n - 4))', '3', 'n - 4')}, 6) AS f_p,
        round((1 - sse / syy) - (1 - (sse / syy) * (n - 1) / (n - 4)), 8) AS overfit_gap FROM f""",
    ),
)
def fit_summary(spark, d):
    out = G.fit_summary(table(spark, d, "lineitem"), XS, Y).select("n", "predictors", "r2", "adj_r2", "df_resid", "f", "f_p", "overfit_gap")
    return rounded(rounded(out, "r2", "adj_r2", "overfit_gap", digits=8), "f", "f_p")


_ANCOVA = "(SELECT l_extendedprice AS y, (l_returnflag = 'A')::INT AS is_a, l_quantity AS baseline FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query("ancova", _coef_query(K.ols_ctes("f", _ANCOVA, ["is_a", "baseline"], "y"), "f", ["is_a", "baseline"]))
def ancova(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    rows = li.select(F.col(Y).alias("y"), (F.col("l_returnflag") == "A").cast("int").alias("is_a"), F.col("l_quantity").alias("baseline"))
    return coef_rounded(G.ols(rows, ["is_a", "baseline"], "y"))


_AMOUNT = "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS amount, l_discount FROM lineitem)"


def with_amount(spark, d):
    return table(spark, d, "lineitem").withColumn("amount", F.col(Y) * (1 - F.col("l_discount")))


@query(
    "naive_vs_controlled",
    K.with_ctes(
        [*K.ols_ctes("f", _AMOUNT, ["l_discount"], "amount"), *K.ols_ctes("g", _AMOUNT, ["l_discount", "l_extendedprice"], "amount"),
         f"tr AS MATERIALIZED (SELECT *, coef / se AS t FROM (SELECT 'naive' AS model, * FROM ({K.term_rows('f', ['l_discount'], const=False)}) UNION ALL SELECT 'controlled', * FROM ({K.term_rows('g', ['l_discount', 'l_extendedprice'], const=False)}) WHERE term = 'l_discount'))"],
        f"SELECT model, term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p FROM tr",
    ),
)
def naive_vs_controlled(spark, d):
    return coef_rounded(G.naive_vs_controlled(with_amount(spark, d), "l_discount", ["l_extendedprice"], "amount"))


@query(
    "partial_corr",
    f"""WITH c AS (SELECT count(*) AS n, corr(amount, l_discount) AS xy, corr(l_discount, l_extendedprice) AS xz, corr(amount, l_extendedprice) AS yz FROM {_AMOUNT})
    SELECT n, round(xy, 6) AS marginal, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""",
)
def partial_corr(spark, d):
    return rounded(G.partial_correlation(with_amount(spark, d), "l_discount", "amount", ["l_extendedprice"]), "marginal", "partial")


_TWIN = "(SELECT l_orderkey, l_linenumber, l_quantity, l_quantity + (l_orderkey % 7) / 10.0::DOUBLE AS twin, l_tax, ln(l_extendedprice) AS log_y FROM lineitem)"
TWIN = ["l_quantity", "twin", "l_tax"]


def twins(spark, d):
    """Predictors of which two measure nearly the same, and a log response."""
    li = table(spark, d, "lineitem")
    twin = F.col("l_quantity") + (F.col("l_orderkey") % 7) / F.lit(10.0)
    return li.select("l_orderkey", "l_linenumber", "l_quantity", twin.alias("twin"), "l_tax", F.log(Y).alias("log_y"))


@query("log_ols", _coef_query(K.ols_ctes("f", _TWIN, TWIN, "log_y"), "f", TWIN, digits=6, se_digits=6))
def log_ols(spark, d):
    return coef_rounded(G.ols(twins(spark, d), TWIN, "log_y"), 6, 6)


@query(
    "vif",
    K.with_ctes(
        [K.gram_cte("g", _TWIN, TWIN, "log_y"), *K.sweep_ctes("f", "g", 3)],
        "SELECT t.term, round(t.vif, 4) AS vif FROM (SELECT 'l_quantity' AS term, g.a0_0 * f.v0_0 AS vif FROM g, f UNION ALL SELECT 'twin', g.a1_1 * f.v1_1 FROM g, f UNION ALL SELECT 'l_tax', g.a2_2 * f.v2_2 FROM g, f) t",
    ),
)
def vif(spark, d):
    return rounded(G.vif(twins(spark, d), TWIN), "vif", digits=4)


_RIDGE = K.sweep_ctes("f", "g", 3, diag_add=[f"5.0 * a{i}_{i} / n" for i in range(3)])


@query(
    "ridge",
    K.with_ctes(
        [K.gram_cte("g", _TWIN, TWIN, "log_y"), *_RIDGE],
        """SELECT 'const' AS term, round(b0, 8) AS coef, NULL::DOUBLE AS coef_std FROM f
        UNION ALL SELECT 'l_quantity', round(b1, 8), round(b1 * sqrt(g.a0_0 / g.n), 8) FROM f, g
        UNION ALL SELECT 'twin', round(b2, 8), round(b2 * sqrt(g.a1_1 / g.n), 8) FROM f, g
        UNION ALL SELECT 'l_tax', round(b3, 8), round(b3 * sqrt(g.a2_2 / g.n), 8) FROM f, g""",
    ),
)
def ridge(spark, d):
    return rounded(G.ridge(twins(spark, d), TWIN, "log_y", alpha=5.0), "coef", "coef_std", digits=8)


_RESID = "(SELECT l_quantity, l_discount, l_tax, pow(l_extendedprice - (b0 + b1 * l_quantity + b2 * l_discount + b3 * l_tax), 2) AS e2 FROM lineitem, f)"


@query(
    "breusch_pagan",
    K.with_ctes(
        [*K.ols_ctes("f", "lineitem", XS, Y), *K.ols_ctes("h", _RESID, XS, "e2"), "s AS MATERIALIZED (SELECT n, n * (1 - sse / syy) AS lm, ((1 - sse / syy) / 3) / ((sse / syy) / (n - 4)) AS f FROM h)"],
        f"SELECT n::BIGINT AS n, round(lm, 6) AS lm, round(f, 6) AS f, round({K.f_p('f', '3', 'n - 4')}, 6) AS f_p, round({K.chi2_p('lm', '3')}, 6) AS p FROM s",
    ),
)
def breusch_pagan(spark, d):
    return rounded(G.breusch_pagan(table(spark, d, "lineitem"), XS, Y), "lm", "f", "f_p", "p")


_X2 = ["l_quantity", "l_discount"]
_COOK = f"""(SELECT l.* FROM lineitem l, f WHERE
   pow(l_extendedprice - (b0 + b1 * l_quantity + b2 * l_discount), 2) / (3 * sse / (n - 3))
   * (1 / n + v0_0 * pow(l_quantity - m0, 2) + 2 * v0_1 * (l_quantity - m0) * (l_discount - m1) + v1_1 * pow(l_discount - m1, 2))
   / pow(1 - (1 / n + v0_0 * pow(l_quantity - m0, 2) + 2 * v0_1 * (l_quantity - m0) * (l_discount - m1) + v1_1 * pow(l_discount - m1, 2)), 2) <= 4 / n)"""


@query(
    "cooks",
    K.with_ctes(
        [*K.ols_ctes("f", "lineitem", _X2, Y), *K.ols_ctes("h", _COOK, _X2, Y),
         f"tr AS MATERIALIZED (SELECT *, coef / se AS t FROM (SELECT 'all' AS model, * FROM ({K.term_rows('f', _X2, extra='n::BIGINT AS n, ')}) UNION ALL SELECT 'without_influential', * FROM ({K.term_rows('h', _X2, extra='n::BIGINT AS n, ')})))"],
        f"SELECT model, n, term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p FROM tr",
    ),
)
def cooks(spark, d):
    return coef_rounded(G.influence_refit(table(spark, d, "lineitem"), _X2, Y))


# ---- ordered data -------------------------------------------------------------------------

_EV = "(SELECT ts, event_id, value, json_extract_string(props, '$.k')::DOUBLE AS k, date_part('hour', ts)::DOUBLE AS hour FROM events)"
EX = ["k", "hour"]


def event_series(spark, d):
    e = table(spark, d, "events")
    return e.select("ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"))


_E = f"e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, k, hour, value - (b0 + b1 * k + b2 * hour) AS e FROM {_EV}, f)"


@query(
    "durbin_watson",
    K.with_ctes(
        [*K.ols_ctes("f", _EV, EX, "value"), _E, "p AS (SELECT e, lag(e) OVER (ORDER BY i) AS pe FROM e)"],
        "SELECT count(*) AS n, round(sum(pow(e - pe, 2)) / sum(e * e), 8) AS dw FROM p",
    ),
)
def durbin_watson(spark, d):
    return rounded(G.durbin_watson(event_series(spark, d), EX, "value", ["ts", "event_id"]), "dw", digits=8)


def _hac_sql() -> str:
    u = ["e", "k * e", "hour * e"]
    uu = "u AS MATERIALIZED (SELECT i, " + ", ".join(f"{x} AS u{j}" for j, x in enumerate(u)) + " FROM e)"
    lag = "lg AS (SELECT ceil(pow(count(*), 0.25))::BIGINT AS l FROM e)"
    cells = [f"sum((1 - abs(a.i - b.i) / (l + 1.0)) * a.u{x} * b.u{y}) AS s{x}{y}" for x in range(3) for y in range(3)]
    pairs = "mt AS MATERIALIZED (SELECT " + ", ".join(cells) + ", max(l) AS l FROM (SELECT i, u0, u1, u2, l, unnest(range(-l, l + 1)) AS o FROM u, lg) a JOIN u b ON b.i = a.i + o)"
    # bread: inverse of X'X with intercept, from the centred inverse
    v = lambda i, j: f"v{min(i, j)}_{max(i, j)}"
    first = [f"-(v0_{j} * m0 + {v(1, j)} * m1)" for j in range(2)]
    bread = {(0, 0): K.inv0(2), (0, 1): first[0], (0, 2): first[1]}
    for i in range(2):
        for j in range(2):
            bread[i + 1, j + 1] = v(i, j)
    get = lambda i, j: bread.get((i, j)) or bread[j, i]
    br = "br AS MATERIALIZED (SELECT n, b0, b1, b2, " + ", ".join(f"{get(i, j)} AS q{i}{j}" for i in range(3) for j in range(3)) + " FROM f)"
    var = lambda t: " + ".join(f"q{t}{i} * s{i}{j} * q{j}{t}" for i in range(3) for j in range(3))
    rows = " UNION ALL ".join(f"SELECT '{name}' AS term, b{t} AS coef, sqrt({var(t)}) AS se, n - 3 AS df, l FROM br, mt" for t, name in enumerate(["const", *EX]))
    return K.with_ctes(
        [*K.ols_ctes("f", _EV, EX, "value"), _E, uu, lag, pairs, br, f"tr AS MATERIALIZED (SELECT *, coef / se AS t FROM ({rows}))"],
        f"SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p, l::INT AS max_lags FROM tr",
    )


@query("newey_west", _hac_sql())
def newey_west(spark, d):
    out = G.newey_west(event_series(spark, d), EX, "value", ["ts", "event_id"])
    return coef_rounded(out.select("term", "coef", "se", "t", "p", "max_lags"), 6, 6)


_MONTHLY = "(SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) / 1e6 AS revenue, count(*)::DOUBLE AS orders FROM orders GROUP BY 1)"
_DIFF = f"(SELECT revenue - lag(revenue) OVER (ORDER BY month) AS d_revenue, orders - lag(orders) OVER (ORDER BY month) AS d_orders FROM {_MONTHLY})"


def monthly_orders(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(
        (F.sum("o_totalprice") / 1e6).alias("revenue"), F.count("*").cast("double").alias("orders")
    )


@query(
    "diff_regression",
    K.with_ctes(
        [*K.ols_ctes("f", _MONTHLY, ["orders"], "revenue"), *K.ols_ctes("g", _DIFF, ["d_orders"], "d_revenue"),
         "s AS MATERIALIZED (SELECT 'levels' AS model, n, b1 AS coef, sqrt(sse / (n - 2) * v0_0) AS se, 1 - sse / syy AS r2 FROM f UNION ALL SELECT 'differences', n, b1, sqrt(sse / (n - 2) * v0_0), 1 - sse / syy FROM g)"],
        f"SELECT model, n::BIGINT AS n, round(coef, 8) AS coef, round(se, 8) AS se, round({K.t_p('coef / se', 'n - 2')}, 6) AS p, round(r2, 8) AS r2 FROM s",
    ),
)
def diff_regression(spark, d):
    out = G.difference_regression(monthly_orders(spark, d), "orders", "revenue", ["month"], n_buckets=1)
    return rounded(rounded(out, "coef", "se", "r2", digits=8), "p")


def _adf_sql(source: str, value: str, order: str, by: str, lags: int) -> str:
    """Every candidate order on the common sample, then every order on its own sample; pick by AIC."""
    lv = ", ".join(f"lag({value}, {j}) OVER w AS x{j}" for j in range(1, lags + 2))
    base = f"b0 AS MATERIALIZED (SELECT {by}, {value} AS x0, {lv} FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY {order}))"
    ds = ", ".join(f"x{j} - x{j + 1} AS d{j}" for j in range(lags + 1))
    diff = f"b AS MATERIALIZED (SELECT *, {ds} FROM b0)"
    ctes = [base, diff, f"cm AS MATERIALIZED (SELECT * FROM b WHERE x{lags + 1} IS NOT NULL)"]
    aic, own = [], []
    for q in range(lags + 1):
        xs = ["x1", *[f"d{j}" for j in range(1, q + 1)]]
        ctes += K.ols_ctes(f"c{q}", "cm", xs, "d0", [by])
        ctes += K.ols_ctes(f"o{q}", "b", xs, "d0", [by])
        aic.append(f"SELECT {by}, {q} AS q, n * (ln(2 * pi()) + ln(sse / n) + 1) + 2 * ({q} + 2) AS aic FROM c{q}")
        own.append(f"SELECT {by}, {q} AS q, n, b1 / sqrt(sse / (n - {q + 2}) * v0_0) AS st FROM o{q}")
    ctes.append("ai AS (SELECT * FROM (" + " UNION ALL ".join(aic) + f") QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY aic, q) = 1)")
    ctes.append("ow AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(own) + f") JOIN ai USING ({by}, q))")
    small = "(2.1659 + 1.4412 * st + 0.038269 * st * st)"
    large = "(1.7339 + 0.93202 * st - 0.12745 * st * st - 0.010368 * st * st * st)"
    ctes.append(f"z AS MATERIALIZED (SELECT *, CASE WHEN st <= -1.61 THEN {small} ELSE {large} END AS z FROM ow)")
    p = f"CASE WHEN st > 2.74 THEN 1.0 WHEN st < -18.83 THEN 0.0 ELSE {K.normal_sf('-z')} END"
    return K.with_ctes(ctes, f"SELECT {by}, round(st, 6) AS statistic, round({p}, 6) AS p, q::BIGINT AS used_lag, n::BIGINT AS n_obs, NULL::VARCHAR AS reason FROM z")


@query("adf", _adf_sql("events", "value", "ts, event_id", "user_id", 2))
def adf(spark, d):
    """Unit-root test of every user's series."""
    out = G.adf(table(spark, d, "events"), "value", ["ts", "event_id"], by=["user_id"], max_lag=2)
    return rounded(out, "statistic", "p")


def _stationarity_sql(lags: int = 12) -> str:
    """Both columns as series, in levels and in differences; the seven years of months make the lag rule 12."""
    long = f"lg AS MATERIALIZED (SELECT 'orders' AS series, month, orders::DOUBLE AS x FROM {_MONTHLY} UNION ALL SELECT 'revenue', month, revenue FROM {_MONTHLY})"
    both = """fm AS MATERIALIZED (SELECT series || '/level' AS s, month, x FROM lg UNION ALL
      SELECT series || '/difference', month, x - p FROM (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY month) AS p FROM lg) WHERE p IS NOT NULL)"""
    inner = _adf_sql("fm", "x", "month", "s", lags).removeprefix("WITH ")
    head, _, last = inner.rpartition("\nSELECT ")
    return f"WITH {long}, {both},\n{head}, ot AS (SELECT {last}) SELECT split_part(s, '/', 1) AS series, split_part(s, '/', 2) AS form, statistic, p, used_lag, n_obs FROM ot"


@query("stationarity_report", _stationarity_sql())
def stationarity_report(spark, d):
    return rounded(G.stationarity_report(monthly_orders(spark, d), ["orders", "revenue"], ["month"], n_buckets=1), "statistic", "p")


REPS = 3000


def _boot_sql() -> str:
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]
    w = " + ".join(f"(u >= {c!r})::INT" for c in cdf)
    xs = ["l_quantity", "l_tax"]
    ctes = [
        K.gram_cte("g", _TWIN, xs, "log_y"),
        *K.sweep_ctes("f", "g", 2, diag_add=[f"5.0 * a{i}_{i} / n" for i in range(2)]),
        f"z AS MATERIALIZED (SELECT l_orderkey, l_linenumber, (l_quantity - m0) / sqrt(a0_0 / n) AS x0, (l_tax - m1) / sqrt(a1_1 / n) AS x1, log_y - m2 AS y FROM {_TWIN}, g)",
        f"r AS (SELECT rep, x0, x1, y, ('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || (rep // 4) || '|9'), (1 + 8 * (rep % 4))::BIGINT, 8))::BIGINT / 4294967296.0 AS u FROM z, range(0, {REPS}) t(rep))",
        f"wt AS (SELECT rep, x0, x1, y, {w} AS w FROM r)",
        """s AS MATERIALIZED (SELECT rep, sum(w)::DOUBLE AS n, sum(w * x0) AS p0, sum(w * x1) AS p1, sum(w * y) AS py, sum(w * x0 * x0) AS q00, sum(w * x0 * x1) AS q01,
             sum(w * x1 * x1) AS q11, sum(w * x0 * y) AS q0y, sum(w * x1 * y) AS q1y FROM wt GROUP BY rep)""",
        "c AS (SELECT rep, q00 - p0 * p0 / n + 5.0 AS a, q01 - p0 * p1 / n AS b, q11 - p1 * p1 / n + 5.0 AS c, q0y - p0 * py / n AS d, q1y - p1 * py / n AS e FROM s)",
        "bt AS (SELECT rep, 'l_quantity' AS term, (d * c - b * e) / (a * c - b * b) AS boot FROM c UNION ALL SELECT rep, 'l_tax', (a * e - b * d) / (a * c - b * b) FROM c)",
        "pt AS (SELECT 'l_quantity' AS term, b1 * sqrt(g.a0_0 / g.n) AS coef_std FROM f, g UNION ALL SELECT 'l_tax', b2 * sqrt(g.a1_1 / g.n) FROM f, g)",
    ]
    return K.with_ctes(
        ctes,
        """SELECT term, round(any_value(coef_std), 8) AS coef_std, least(1.0, 2 * avg((boot * coef_std <= 0)::INT)) AS p_boot, round(quantile_cont(boot, 0.025), 8) AS ci_low,
        round(quantile_cont(boot, 0.975), 8) AS ci_high, count(*) AS replicates FROM bt JOIN pt USING (term) GROUP BY term""",
    )


@query("bootstrap_ci", _boot_sql())
def bootstrap_ci(spark, d):
    out = G.bootstrap_report(twins(spark, d), ["l_quantity", "l_tax"], "log_y", ["l_orderkey", "l_linenumber"], REPS, alpha=5.0, seed=9)
    return rounded(out, "coef_std", "ci_low", "ci_high", digits=8)


@query(
    "log_extrapolation",
    """WITH y AS (SELECT year(o_orderdate)::BIGINT AS yr, sum(o_totalprice) / 1e6 AS rev FROM orders GROUP BY 1),
    s AS (SELECT count(*) AS n, max(yr) AS last_x, regr_slope(rev, yr) AS ls, regr_intercept(rev, yr) AS li, regr_syy(rev, yr) AS syy, regr_r2(rev, yr) AS r2,
      regr_slope(rev, ln(yr - 1994)) AS gs, regr_intercept(rev, ln(yr - 1994)) AS gi, regr_r2(rev, ln(yr - 1994)) AS gr2 FROM y),
    p AS (SELECT *, li + ls * 2006 AS lin, gi + gs * ln(12) AS lg FROM s)
    SELECT n, last_x, round(ls, 4) AS lin_slope, round(gs, 4) AS log_slope, round(lin, 4) AS linear_prediction, round(lg, 4) AS log_prediction, round(sqrt(syy * (1 - r2) / (n - 2)), 4) AS linear_resid_std,
      round(sqrt(syy * (1 - gr2) / (n - 2)), 4) AS log_resid_std, round(least(lin, lg) - 40, 4) AS low, round(greatest(lin, lg) + 40, 4) AS high, (2006 - last_x)::DOUBLE AS horizon FROM p""",
)
def log_extrapolation(spark, d):
    o = table(spark, d, "orders")
    yearly = o.groupBy(F.year("o_orderdate").cast("bigint").alias("yr")).agg((F.sum("o_totalprice") / 1e6).alias("rev"))
    out = G.extrapolation_band(yearly, "yr", "rev", 1994, 2006, 40.0).drop("lin_intercept", "log_intercept")
    return rounded(out, "lin_slope", "log_slope", "linear_prediction", "log_prediction", "linear_resid_std", "log_resid_std", "low", "high", digits=4)


_SEG = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_DUM = "(SELECT c_acctbal, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS s{i}" for i, s in enumerate(_SEG)) + " FROM customer)"
_DX = [f"s{i}" for i in range(4)]


@query(
    "dummy_regression",
    K.with_ctes(
        [*K.ols_ctes("f", _DUM, _DX, "c_acctbal"), f"tr AS MATERIALIZED (SELECT *, coef / se AS t FROM ({K.term_rows('f', _DX, [f'seg_{s}' for s in _SEG])}))"],
        f"SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p, {K.t_p('t', 'df')} < 0.05 AND term <> 'const' AS significant FROM tr",
    ),
)
def dummy_regression(spark, d):
    return coef_rounded(G.significant_terms(G.factor_regression(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", prefix="seg")))


@query(
    "factor_regression",
    f"""WITH li AS (SELECT 'p' || l_partkey AS g, l_discount AS x, l_extendedprice AS y FROM lineitem),
    lv AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, covar_pop(y, y) * count(*) AS syy FROM li GROUP BY 1),
    w AS (SELECT sum(n) AS n, count(*) AS k, sum(sxx) AS sxx, sum(sxy) / sum(sxx) AS b, sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) AS sse,
          min(g) AS first, arg_min(n, g) AS rn, arg_min(mx, g) AS rx, arg_min(my, g) AS ry FROM lv),
    f AS (SELECT *, (n - k - 1)::DOUBLE AS df, sse / (n - k - 1) AS s2, ry - b * rx AS a0 FROM w),
    tr AS (SELECT 'const' AS term, a0 AS coef, sqrt(s2 * (1.0 / rn + rx * rx / sxx)) AS se, df FROM f
      UNION ALL SELECT 'part_' || g, my - b * mx - a0, sqrt(s2 * (1.0 / lv.n + 1.0 / rn + (mx - rx) * (mx - rx) / f.sxx)), df FROM lv, f WHERE g <> first
      UNION ALL SELECT 'l_discount', b, sqrt(s2 / sxx), df FROM f),
    te AS (SELECT *, coef / se AS t FROM tr)
    SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p FROM te""",
)
def factor_regression(spark, d):
    """A constant for every part, all of them at once."""
    rows = table(spark, d, "lineitem").withColumn("part", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    return coef_rounded(G.factor_regression(rows, "part", "l_extendedprice", ["l_discount"]))


# ---- missing values -----------------------------------------------------------------------

_IMP = ["l_quantity", "l_discount", "l_extendedprice"]


@query(
    "impute_regression",
    K.with_ctes(
        [*K.ols_ctes("f", f"(SELECT * FROM {_MISSING} WHERE tax_seen IS NOT NULL)", _IMP, "tax_seen"),
         f"im AS MATERIALIZED (SELECT l_extendedprice * (1 + l_tax) AS charge, l_extendedprice, (tax_seen IS NULL)::INT AS flag, coalesce(tax_seen, b0 + b1 * l_quantity + b2 * l_discount + b3 * l_extendedprice) AS tax FROM {_MISSING}, f)",
         *K.ols_ctes("h", "im", ["tax", "flag", "l_extendedprice"], "charge"),
         f"tr AS MATERIALIZED (SELECT *, coef / se AS t FROM ({K.term_rows('h', ['tax', 'flag', 'l_extendedprice'], ['tax_seen', 'missing_tax_seen', 'l_extendedprice'])}))"],
        f"SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({K.t_p('t', 'df')}, 6) AS p FROM tr",
    ),
)
def impute_regression(spark, d):
    rows = tax_with_gaps(spark, d).withColumn("charge", F.col(Y) * (1 + F.col("l_tax")))
    filled = P.impute_by_regression(rows, "tax_seen", _IMP)
    return coef_rounded(G.ols(filled, ["tax_seen", "missing_tax_seen", Y], "charge"))


@query(
    "impute_mean",
    f"""WITH m AS (SELECT avg(tax_seen) AS mu, quantile_cont(tax_seen, 0.5) AS med FROM {_MISSING})
    SELECT l_returnflag, round(avg(coalesce(tax_seen, mu)), 6) AS mean_filled, round(avg(coalesce(tax_seen, med)), 6) AS median_filled, round(stddev_samp(coalesce(tax_seen, mu)), 6) AS sd_mean_filled
    FROM {_MISSING}, m GROUP BY l_returnflag""",
)
def impute_mean(spark, d):
    rows = tax_with_gaps(spark, d).select("l_returnflag", "tax_seen", F.col("tax_seen").alias("tax_med"))
    filled = P.impute(P.impute(rows, rows, "tax_seen", "mean"), rows, "tax_med", "median")
    return rounded(
        filled.groupBy("l_returnflag").agg(F.avg("tax_seen").alias("mean_filled"), F.avg("tax_med").alias("median_filled"), F.stddev_samp("tax_seen").alias("sd_mean_filled")),
        "mean_filled", "median_filled", "sd_mean_filled",
    )
