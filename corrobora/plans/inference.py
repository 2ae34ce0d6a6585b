"""Tests, multiplicity, experiments and survival on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import p_text, pair_key
from ..operators import experiment as X
from ..operators import hypothesis as H
from ..operators import survival as V
from ..operators.order_stats import exact_median
from ..sources.readers import table
from . import sqlkit as K
from .registry import query

R = 6


def rounded(df: DataFrame, *columns: str, digits: int = R) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def events_by_arm(spark, d):
    """Events with the arm of their user (even ids A, odd ids B)."""
    arm = F.when(F.col("user_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    return table(spark, d, "events").withColumn("arm", arm)


ARM = "CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END"
MOMENTS = f"""m AS MATERIALIZED (
  SELECT count(*) FILTER (WHERE arm = 'A') AS n_a, avg(value) FILTER (WHERE arm = 'A') AS mean_a, var_samp(value) FILTER (WHERE arm = 'A') AS var_a,
         count(*) FILTER (WHERE arm = 'B') AS n_b, avg(value) FILTER (WHERE arm = 'B') AS mean_b, var_samp(value) FILTER (WHERE arm = 'B') AS var_b
  FROM (SELECT value, {ARM} AS arm FROM events)),
s AS MATERIALIZED (SELECT *, mean_a - mean_b AS diff,
    (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)) AS t, (n_a + n_b - 2)::DOUBLE AS df,
    (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t_welch,
    pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df_welch,
    (mean_a - mean_b) / sqrt((var_a * (n_a - 1) / n_a + var_b * (n_b - 1) / n_b) / 2) AS cohens_d, (mean_a - mean_b) / mean_b AS relative_effect FROM m)"""


@query(
    "t_tests",
    f"""WITH {MOMENTS}
    SELECT n_a, round(mean_a, 6) AS mean_a, n_b, round(mean_b, 6) AS mean_b, round(diff, 6) AS diff, round(t, 6) AS t, df, round({K.t_p('t', 'df')}, 6) AS p,
           round(cohens_d, 6) AS cohens_d, round(relative_effect, 6) AS relative_effect FROM s""",
)
def t_tests(spark, d):
    out = H.two_sample(events_by_arm(spark, d), "value", "arm", "A", "B")
    out = out.select("n_a", "mean_a", "n_b", "mean_b", "diff", "t", "df", "p", "cohens_d", "relative_effect")
    return rounded(out, "mean_a", "mean_b", "diff", "t", "p", "cohens_d", "relative_effect")


@query(
    "welch",
    f"""WITH {MOMENTS} SELECT n_a, n_b, round(t_welch, 6) AS t_welch, round(df_welch, 4) AS df_welch, round({K.t_p('t_welch', 'df_welch')}, 6) AS p_welch FROM s""",
)
def welch(spark, d):
    out = H.two_sample(events_by_arm(spark, d), "value", "arm", "A", "B").select("n_a", "n_b", "t_welch", "df_welch", "p_welch")
    return rounded(rounded(out, "t_welch", "p_welch"), "df_welch", digits=4)


def user_halves(spark, d):
    """Mean value per user before and after the middle of the month."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return events_by_arm(spark, d).groupBy("user_id", "arm").agg(
        F.avg(F.when(early, F.col("value"))).alias("pre"), F.avg(F.when(~early, F.col("value"))).alias("post")
    )


HALVES = f"""u AS (SELECT user_id, {ARM} AS arm, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS pre,
  avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS post FROM events GROUP BY user_id)"""


@query(
    "paired_t",
    f"""WITH {HALVES}, g AS (SELECT count(post - pre) AS n, avg(post - pre) AS mean, var_samp(post - pre) AS var FROM u),
    s AS (SELECT n, mean, var, mean / sqrt(var / n) AS t, (n - 1)::DOUBLE AS df FROM g)
    SELECT n, round(mean, 6) AS mean, round(var, 6) AS var, round(t, 6) AS t, df, round({K.t_p('t', 'df')}, 6) AS p FROM s""",
)
def paired_t(spark, d):
    return rounded(H.paired_t(user_halves(spark, d), "pre", "post"), "mean", "var", "t", "p")


@query(
    "did",
    f"""WITH {HALVES}, g AS (SELECT arm, post - pre AS x FROM u),
    m AS (SELECT count(x) FILTER (WHERE arm = 'A') AS n_a, avg(x) FILTER (WHERE arm = 'A') AS mean_a, var_samp(x) FILTER (WHERE arm = 'A') AS var_a,
                 count(x) FILTER (WHERE arm = 'B') AS n_b, avg(x) FILTER (WHERE arm = 'B') AS mean_b, var_samp(x) FILTER (WHERE arm = 'B') AS var_b FROM g),
    s AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
          pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df FROM m)
    SELECT n_a, n_b, round(mean_a - mean_b, 6) AS diff, round(t, 6) AS t_welch, round(df, 4) AS df_welch, round({K.t_p('t', 'df')}, 6) AS p_welch FROM s""",
)
def did(spark, d):
    out = H.difference_in_differences(user_halves(spark, d), "pre", "post", "arm", "A", "B")
    return rounded(rounded(out.select("n_a", "n_b", "diff", "t_welch", "df_welch", "p_welch"), "diff", "t_welch", "p_welch"), "df_welch", digits=4)


def _anova_sql(source: str, value: str, group: str) -> str:
    return f"""g AS (SELECT {group} AS g, count({value}) AS n, avg({value}) AS m, var_samp({value}) AS v FROM {source} GROUP BY 1),
    a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n_total, sum((n - 1) * v) AS ssw FROM g),
    b AS (SELECT sum(n * pow(m - (SELECT sum(n * m) / sum(n) FROM g), 2)) AS ssb FROM g),
    f AS (SELECT k, n_total, ssb, ssw, (ssb / (k - 1)) / (ssw / (n_total - k)) AS f, (k - 1)::DOUBLE AS d1, (n_total - k)::DOUBLE AS d2 FROM a, b)
    SELECT k, n_total, round(ssb, 2) AS ss_between, round(ssw, 2) AS ss_within, round(f, 6) AS f, d1 AS df_between, d2 AS df_within, round({K.f_p('f', 'd1', 'd2')}, 6) AS p FROM f"""


@query("anova", "WITH " + _anova_sql("customer", "c_acctbal", "c_mktsegment"))
def anova(spark, d):
    out = H.anova(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return rounded(rounded(out, "f", "p"), "ss_between", "ss_within", digits=2)


@query(
    "levene",
    "WITH md AS (SELECT c_mktsegment AS seg, median(c_acctbal) AS med FROM customer GROUP BY 1), dv AS (SELECT seg, abs(c_acctbal - med) AS dev FROM customer JOIN md ON seg = c_mktsegment), "
    + _anova_sql("dv", "dev", "seg"),
)
def levene(spark, d):
    out = H.levene(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return rounded(rounded(out, "f", "p"), "ss_between", "ss_within", digits=2)


@query(
    "welch_anova",
    f"""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
    w AS (SELECT *, n / v AS w FROM g), t AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * m) / sum(w) AS gm FROM w),
    s AS (SELECT max(k) AS k, sum(w * pow(m - gm, 2)) AS num, sum(pow(1 - w / sw, 2) / (n - 1)) AS lam FROM w, t),
    f AS (SELECT k, (num / (k - 1)) / (1 + 2 * (k - 2) * lam / (k * k - 1)) AS f, (k - 1)::DOUBLE AS d1, (k * k - 1) / (3 * lam) AS d2 FROM s)
    SELECT k, round(f, 6) AS f, d1 AS df_between, round(d2, 4) AS df_within, round({K.f_p('f', 'd1', 'd2')}, 6) AS p FROM f""",
)
def welch_anova(spark, d):
    out = H.welch_anova(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return rounded(rounded(out, "f", "p"), "df_within", digits=4)


RANKED = """r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY x) AS tie FROM src)"""


@query(
    "kruskal",
    f"""WITH src AS (SELECT event_type AS g, value AS x FROM events), {RANKED},
    p AS (SELECT g, count(*)::DOUBLE AS n, sum(rk) AS rs FROM r GROUP BY g),
    t AS (SELECT sum(tie::DOUBLE * tie - 1) AS t3 FROM r),
    s AS (SELECT count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS r2 FROM p),
    h AS (SELECT k, n, (12.0 / (n * (n + 1)) * r2 - 3 * (n + 1)) / (1 - t3 / (n * n * n - n)) AS h FROM s, t)
    SELECT k, n::BIGINT AS n, round(h, 6) AS h, round({K.chi2_p('h', 'k - 1')}, 6) AS p FROM h""",
)
def kruskal(spark, d):
    return rounded(H.kruskal(table(spark, d, "events"), "value", "event_type"), "h", "p")


@query(
    "mannwhitney",
    f"""WITH src AS (SELECT {ARM} AS g, value AS x FROM events), {RANKED},
    p AS (SELECT count(*) FILTER (WHERE g = 'A')::DOUBLE AS na, count(*) FILTER (WHERE g = 'B')::DOUBLE AS nb, sum(rk) FILTER (WHERE g = 'A') AS ra, sum(tie::DOUBLE * tie - 1) AS t3 FROM r),
    u AS (SELECT na, nb, ra - na * (na + 1) / 2 AS u, t3 FROM p),
    z AS (SELECT *, (abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - t3 / ((na + nb) * (na + nb - 1)))) AS z FROM u)
    SELECT 'A' AS a, 'B' AS b, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(u, 4) AS u, round(z, 6) AS z, round({K.normal_p2('z')}, 6) AS p FROM z""",
)
def mannwhitney(spark, d):
    return rounded(rounded(H.mann_whitney(events_by_arm(spark, d), "value", "arm", "A", "B"), "z", "p"), "u", digits=4)


RANK_PAIRS = f"""WITH v AS (SELECT event_type AS g, value AS x, count(*) AS c FROM events GROUP BY ALL),
    c AS (SELECT g, x, c, sum(c) OVER (PARTITION BY g ORDER BY x) AS cum FROM v),
    n AS (SELECT g, sum(c)::DOUBLE AS n FROM v GROUP BY g),
    pr AS (SELECT a.g AS a, b.g AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.g < b.g),
    xs AS (SELECT a, b, na, nb, x, sum(c) FILTER (WHERE g = a) AS ca, sum(c) FILTER (WHERE g = b) AS cb FROM pr JOIN v ON g = a OR g = b GROUP BY ALL),
    rn AS (SELECT *, coalesce(sum(coalesce(cb, 0)) OVER (PARTITION BY a, b ORDER BY x), 0) AS cumb FROM xs),
    u AS (SELECT a, b, na, nb, sum(coalesce(ca, 0) * (cumb - coalesce(cb, 0) / 2.0)) AS u, sum(pow(coalesce(ca, 0) + coalesce(cb, 0), 3) - coalesce(ca, 0) - coalesce(cb, 0)) AS t3 FROM rn GROUP BY ALL),
    z AS (SELECT *, greatest((abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - t3 / ((na + nb) * (na + nb - 1)))), 0) AS z FROM u)"""


@query(
    "pairwise_mannwhitney",
    f"""{RANK_PAIRS}
    SELECT a, b, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(u::DOUBLE, 4) AS u, round(z, 6) AS z, round({K.normal_p2('z')}, 6) AS p FROM z""",
)
def pairwise_mannwhitney(spark, d):
    return rounded(rounded(H.pairwise_mann_whitney(table(spark, d, "events"), "value", "event_type"), "z", "p"), "u", digits=4)


@query(
    "pairwise_ranks",
    f"""{RANK_PAIRS},
    pv AS (SELECT a, b, {K.normal_p2('z')} AS p FROM z), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, a, b) AS rank FROM pv),
    h AS (SELECT *, bool_and(p < 0.05 / (m - rank + 1)) OVER (ORDER BY rank) AS sig FROM r),
    md AS (SELECT event_type AS g, median(value) AS med FROM events GROUP BY 1)
    SELECT [h.a, h.b] AS pair, round(p, 6) AS p, CASE WHEN p < 0.0001 THEN '<0.0001' ELSE printf('%.4f', p) END AS p_text, rank::INT AS rank,
           round(0.05 / (m - rank + 1), 6) AS holm_threshold, sig AS sig_holm, CASE WHEN x.med > y.med THEN h.a || '>' || h.b ELSE h.b || '>' || h.a END AS direction
    FROM h JOIN md x ON x.g = h.a JOIN md y ON y.g = h.b""",
)
def pairwise_ranks(spark, d):
    """Rank tests of all pairs, stepped down, each with its direction by the exact medians."""
    e = table(spark, d, "events")
    pairs = H.adjust(H.pairwise_mann_whitney(e, "value", "event_type"), order=["a", "b"])
    out = H.with_direction(pairs, exact_median(e, "value", ["event_type"]), "event_type")
    out = out.select(pair_key("a", "b").alias("pair"), "p", p_text(F.col("p")).alias("p_text"), "rank", "holm_threshold", "sig_holm", "direction")
    return rounded(out, "p", "holm_threshold")


@query(
    "normality_moments",
    f"""WITH m AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS mu FROM customer GROUP BY 1),
    c AS (SELECT c_mktsegment, max(n) AS n, avg(pow(c_acctbal - mu, 2)) AS m2, avg(pow(c_acctbal - mu, 3)) AS m3, avg(pow(c_acctbal - mu, 4)) AS m4 FROM customer JOIN m USING (c_mktsegment) GROUP BY 1),
    s AS (SELECT c_mktsegment, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM c),
    j AS (SELECT *, n / 6.0 * (skew * skew + kurt * kurt / 4) AS jb FROM s)
    SELECT c_mktsegment, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(jb, 6) AS jb, round({K.chi2_p('jb', '2')}, 6) AS p FROM j""",
)
def normality_moments(spark, d):
    return rounded(H.jarque_bera(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]), "skew", "kurt", "jb", "p")


def _poly(c, x: str) -> str:
    out = f"{c[-1]!r}"
    for v in reversed(c[:-1]):
        out = f"({out} * ({x}) + {v!r})"
    return out


def _shapiro_ctes(source: str, value: str, group: str) -> str:
    """sw: W and p per group of more than eleven values."""
    last, second = f"(m1 / sqrt(ss) + {_poly(H._C1, 'u')})", f"(m2 / sqrt(ss) + {_poly(H._C2, 'u')})"
    return f"""sr AS (SELECT {group} AS g, {value} - avg({value}) OVER (PARTITION BY {group}) AS x, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS i,
      count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {value} IS NOT NULL),
    sm AS (SELECT *, {K.normal_quantile('(i - 0.375) / (n + 0.25)')} AS m FROM sr),
    sa AS (SELECT g, n, 1 / sqrt(n) AS u, sum(m * m) AS ss, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2, sum(x * x) AS xx FROM sm GROUP BY g, n),
    sb AS (SELECT *, {last} AS a1, {second} AS a2 FROM sa),
    sc AS (SELECT *, sqrt((ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS phi FROM sb),
    sd AS (SELECT g, n, xx, sum(x * CASE WHEN i = 1 THEN -a1 WHEN i = n THEN a1 WHEN i = 2 THEN -a2 WHEN i = n - 1 THEN a2 ELSE m / phi END) AS top FROM sm JOIN sc USING (g, n) GROUP BY g, n, xx),
    sz AS (SELECT g, n, least(1.0, top * top / xx) AS w, (ln(1 - top * top / xx) - {_poly(H._C5, 'ln(n)')}) / exp({_poly(H._C6, 'ln(n)')}) AS z FROM sd),
    sw AS (SELECT g, n, w, {K.normal_sf('z')} AS p FROM sz)"""


@query(
    "normality",
    f"""WITH {_shapiro_ctes('customer', 'c_acctbal', 'c_mktsegment')},
    m AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS mu FROM customer GROUP BY 1),
    c AS (SELECT g, count(*) AS n, avg(pow(c_acctbal - mu, 2)) AS m2, avg(pow(c_acctbal - mu, 3)) AS m3, avg(pow(c_acctbal - mu, 4)) AS m4 FROM customer JOIN m ON g = c_mktsegment GROUP BY g),
    j AS (SELECT g, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM c)
    SELECT g AS c_mktsegment, n, round(w, 6) AS w, round(p, 6) AS w_p, round(jb, 6) AS jb, round({K.chi2_p('jb', '2')}, 6) AS jb_p FROM sw JOIN j USING (g)""",
)
def normality(spark, d):
    return rounded(H.normality(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"), "w", "w_p", "jb", "jb_p")


def _assumption_sql() -> str:
    src = "src AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer)"
    dev = "dv AS (SELECT c_mktsegment AS seg, abs(c_acctbal - med) AS dev FROM customer JOIN (SELECT c_mktsegment AS s, median(c_acctbal) AS med FROM customer GROUP BY 1) ON s = c_mktsegment)"
    kw = f"""{RANKED}, kp AS (SELECT g, count(*)::DOUBLE AS n, sum(rk) AS rs FROM r GROUP BY g), kt AS (SELECT sum(tie::DOUBLE * tie - 1) AS t3 FROM r),
    ks AS (SELECT count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS r2 FROM kp), kh AS (SELECT k, (12.0 / (n * (n + 1)) * r2 - 3 * (n + 1)) / (1 - t3 / (n * n * n - n)) AS h FROM ks, kt),
    kr AS (SELECT round({K.chi2_p('h', 'k - 1')}, 6) AS p FROM kh)"""
    parts = f"(SELECT p FROM (WITH {_anova_sql('dv', 'dev', 'seg')})) AS levene_p, (SELECT p FROM (WITH {_anova_sql('customer', 'c_acctbal', 'c_mktsegment')})) AS anova_p, (SELECT p FROM kr) AS kruskal_p"
    return f"""WITH {src}, {dev}, {kw}, {_shapiro_ctes('customer', 'c_acctbal', 'c_mktsegment')},
    a AS (SELECT (SELECT round(min(p), 6) FROM sw) AS normality_min_p, {parts}), b AS (SELECT *, normality_min_p < 0.05 AS normality_violated, levene_p < 0.05 AS equal_variance_violated FROM a)
    SELECT *, CASE WHEN normality_violated OR equal_variance_violated THEN 'kruskal-wallis' ELSE 'anova' END AS test_used,
      CASE WHEN normality_violated OR equal_variance_violated THEN kruskal_p ELSE anova_p END AS p FROM b"""


@query("assumption_report", _assumption_sql())
def assumption_report(spark, d):
    out = H.assumption_report(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return rounded(out, "normality_min_p", "levene_p", "anova_p", "kruskal_p", "p")


PAIRS = f"""g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
    pr AS (SELECT a.g AS a, b.g AS b, a.n AS n_a, b.n AS n_b, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t, (a.n + b.n - 2)::DOUBLE AS df
           FROM g a JOIN g b ON a.g < b.g),
    p AS MATERIALIZED (SELECT a, b, n_a, n_b, t, df, {K.t_p('t', 'df')} AS p FROM pr),
    r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, a, b) AS rank FROM p)"""


def priority_pairs(spark, d):
    return H.adjust(H.pairwise_t(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"), order=["a", "b"])


@query(
    "pairwise_bonferroni",
    f"WITH {PAIRS} SELECT a, b, n_a, n_b, round(t, 6) AS t, df, round(p, 6) AS p, round(least(1.0, p * m), 6) AS p_bonferroni, p < 0.05 / m AS sig_bonferroni FROM r",
)
def pairwise_bonferroni(spark, d):
    out = priority_pairs(spark, d).select("a", "b", "n_a", "n_b", "t", "df", "p", "p_bonferroni", "sig_bonferroni")
    return rounded(out, "t", "p", "p_bonferroni")


@query(
    "pairwise_holm",
    f"""WITH {PAIRS}, md AS (SELECT o_orderpriority AS g, median(o_totalprice) AS med FROM orders GROUP BY 1),
    h AS (SELECT *, bool_and(p < 0.05 / (m - rank + 1)) OVER (ORDER BY rank) AS sig FROM r)
    SELECT h.a, h.b, round(p, 6) AS p, rank::INT AS rank, round(0.05 / (m - rank + 1), 6) AS holm_threshold, sig AS sig_holm,
           CASE WHEN x.med > y.med THEN h.a || '>' || h.b ELSE h.b || '>' || h.a END AS direction
    FROM h JOIN md x ON x.g = h.a JOIN md y ON y.g = h.b""",
)
def pairwise_holm(spark, d):
    o = table(spark, d, "orders")
    medians = exact_median(o, "o_totalprice", ["o_orderpriority"])
    out = H.with_direction(priority_pairs(spark, d), medians, "o_orderpriority")
    return rounded(out.select("a", "b", "p", "rank", "holm_threshold", "sig_holm", "direction"), "p", "holm_threshold")


@query(
    "pairwise_bh",
    f"WITH {PAIRS} SELECT a, b, round(p, 6) AS p, round(least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)), 6) AS p_bh, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)) < 0.05 AS sig_bh FROM r",
)
def pairwise_bh(spark, d):
    return rounded(priority_pairs(spark, d).select("a", "b", "p", "p_bh", "sig_bh"), "p", "p_bh")


@query(
    "icc",
    """WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM events GROUP BY 1),
    t AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
    s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n_total, sum(n * pow(m - gm, 2)) / (count(*) - 1) AS msb, sum((n - 1) * v) / (sum(n) - count(*)) AS msw,
                 (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM g, t)
    SELECT k, n_total, round(n0, 6) AS n0, round(msb, 6) AS ms_between, round(msw, 6) AS ms_within, round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc FROM s""",
)
def icc(spark, d):
    return rounded(H.icc(table(spark, d, "events"), "value", "user_id"), "n0", "ms_between", "ms_within", "icc")


@query(
    "cluster_means_test",
    f"""WITH e AS (SELECT user_id, {ARM} AS arm, value FROM events), c AS (SELECT user_id, arm, avg(value) AS value FROM e GROUP BY ALL),
    x AS (SELECT 'row' AS level, arm, value FROM e UNION ALL SELECT 'cluster', arm, value FROM c),
    m AS (SELECT level, count(*) FILTER (WHERE arm = 'A') AS n_a, avg(value) FILTER (WHERE arm = 'A') AS mean_a, var_samp(value) FILTER (WHERE arm = 'A') AS va,
          count(*) FILTER (WHERE arm = 'B') AS n_b, avg(value) FILTER (WHERE arm = 'B') AS mean_b, var_samp(value) FILTER (WHERE arm = 'B') AS vb FROM x GROUP BY level),
    s AS (SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)) AS t, (n_a + n_b - 2)::DOUBLE AS df FROM m)
    SELECT level, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_a - mean_b, 6) AS diff, round(t, 6) AS t, df, round({K.t_p('t', 'df')}, 6) AS p FROM s""",
)
def cluster_means_test(spark, d):
    out = H.cluster_means_test(events_by_arm(spark, d), "value", "user_id", "arm", "A", "B")
    return rounded(out, "mean_a", "mean_b", "diff", "t", "p")


@query(
    "pearson",
    f"""WITH s AS (SELECT event_type, count(*) AS n, corr(value, json_extract_string(props, '$.k')::DOUBLE) AS r FROM events GROUP BY 1),
    t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM s)
    SELECT event_type, n, round(r, 6) AS r, round(t, 6) AS t, round({K.t_p('t', 'n - 2')}, 6) AS p FROM t""",
)
def pearson(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return rounded(H.pearson(e, "value", "k", ["event_type"]), "r", "t", "p")


@query(
    "simple_regression",
    f"""WITH s AS (SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
      regr_r2(l_extendedprice, l_quantity) AS r2, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS sse, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem GROUP BY 1),
    t AS (SELECT *, sqrt(sse / (n - 2)) AS rs, slope / (sqrt(sse / (n - 2)) / sqrt(sxx)) AS t FROM s)
    SELECT l_returnflag, n::BIGINT AS n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 8) AS r2, round(rs, 4) AS resid_std, round(t, 6) AS t, round({K.t_p('t', 'n - 2')}, 6) AS p FROM t""",
)
def simple_regression(spark, d):
    out = H.simple_regression(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    out = out.select("l_returnflag", "n", "slope", "intercept", "r2", "resid_std", "t", "p")
    return rounded(rounded(rounded(out, "slope", "intercept", "resid_std", digits=4), "t", "p"), "r2", digits=8)


# ---- experiments --------------------------------------------------------------------------

AB = f"""c AS (SELECT count(*) FILTER (WHERE arm = 'A' AND bought) AS conv_a, count(*) FILTER (WHERE arm = 'A') AS n_a,
         count(*) FILTER (WHERE arm = 'B' AND bought) AS conv_b, count(*) FILTER (WHERE arm = 'B') AS n_b,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS span_days
  FROM (SELECT {ARM} AS arm, event_type = 'purchase' AS bought, ts FROM events)),
x AS MATERIALIZED (SELECT *, conv_a / n_a AS rate_a, conv_b / n_b AS rate_b, conv_b / n_b - conv_a / n_a AS effect,
     (n_a + n_b) * pow(conv_a::DOUBLE * (n_b - conv_b) - (n_a - conv_a)::DOUBLE * conv_b, 2) / (n_a::DOUBLE * n_b * (conv_a + conv_b) * (n_a + n_b - conv_a - conv_b)) AS chi2 FROM c)"""


def bought() -> F.Column:
    return (F.col("event_type") == "purchase").cast("int")


@query(
    "ab_chi2",
    f"""WITH {AB} SELECT conv_a, n_a, conv_b, n_b, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b, round(effect, 6) AS effect, round(chi2, 6) AS chi2, round({K.chi2_p('chi2', '1')}, 6) AS p,
    round(effect - {K.Z975} * sqrt(rate_a * (1 - rate_a) / n_a + rate_b * (1 - rate_b) / n_b), 6) AS ci_low, round(effect + {K.Z975} * sqrt(rate_a * (1 - rate_a) / n_a + rate_b * (1 - rate_b) / n_b), 6) AS ci_high FROM x""",
)
def ab_chi2(spark, d):
    row = X.conversion_table(events_by_arm(spark, d), "arm", bought(), "A", "B")
    return rounded(X.wald_interval(X.chi2_2x2(row)), "rate_a", "rate_b", "effect", "chi2", "p", "ci_low", "ci_high")


POWER = f"""h AS (SELECT *, abs(2 * asin(sqrt(rate_a + 0.03)) - 2 * asin(sqrt(rate_a))) AS cohens_h FROM x),
w AS MATERIALIZED (SELECT *, {K.normal_sf(f"{K.Z975} - cohens_h * sqrt(n_a / 2)")} + {K.normal_sf(f"{K.Z975} + cohens_h * sqrt(n_a / 2)")} AS power,
      ceil(2 * pow(({K.Z975} + 0.8416212335729143) / cohens_h, 2))::BIGINT AS n_required FROM h)"""


@query(
    "ab_power",
    f"WITH {AB}, {POWER} SELECT n_a, round(rate_a, 6) AS rate_a, round(cohens_h, 6) AS cohens_h, round(power, 6) AS power, n_required FROM w",
)
def ab_power(spark, d):
    row = X.conversion_table(events_by_arm(spark, d), "arm", bought(), "A", "B")
    out = X.power_report(row, 0.03).select("n_a", "rate_a", "cohens_h", "power", "n_required")
    return rounded(out, "rate_a", "cohens_h", "power")


@query(
    "ab_peeking",
    f"""WITH dd AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE arm = 'A' AND b) AS ca, count(*) FILTER (WHERE arm = 'A') AS na, count(*) FILTER (WHERE arm = 'B' AND b) AS cb, count(*) FILTER (WHERE arm = 'B') AS nb
      FROM (SELECT ts, {ARM} AS arm, event_type = 'purchase' AS b FROM events) GROUP BY 1),
    c AS (SELECT day, sum(ca) OVER w AS conv_a, sum(na) OVER w AS n_a, sum(cb) OVER w AS conv_b, sum(nb) OVER w AS n_b, row_number() OVER w AS day_no FROM dd WINDOW w AS (ORDER BY day)),
    x AS (SELECT *, (n_a + n_b)::DOUBLE * pow(conv_a::DOUBLE * (n_b - conv_b) - (n_a - conv_a)::DOUBLE * conv_b, 2) / (n_a::DOUBLE * n_b * (conv_a + conv_b) * (n_a + n_b - conv_a - conv_b)) AS chi2 FROM c)
    SELECT day_no::INT AS day_no, day, conv_a::BIGINT AS conv_a, n_a::BIGINT AS n_a, conv_b::BIGINT AS conv_b, n_b::BIGINT AS n_b, round(chi2, 6) AS chi2, round({K.chi2_p('chi2', '1')}, 6) AS p FROM x""",
)
def ab_peeking(spark, d):
    out = X.peeking_profile(events_by_arm(spark, d), "ts", "arm", bought(), "A", "B")
    return rounded(out.select("day_no", "day", "conv_a", "n_a", "conv_b", "n_b", "chi2", "p"), "chi2", "p")


@query(
    "ab_decision",
    f"""WITH {AB}, {POWER}, p AS (SELECT *, {K.chi2_p('chi2', '1')} AS p FROM w)
    SELECT round(span_days, 6) AS span_days, round(p, 6) AS p, round(effect, 6) AS effect, round(power, 6) AS power, span_days >= 27 AS window_covered,
      CASE WHEN span_days < 27 THEN 'extend_test' WHEN p < 0.05 AND effect > 0 THEN 'launch_b' WHEN p < 0.05 THEN 'do_not_launch' WHEN power < 0.8 THEN 'inconclusive' ELSE 'do_not_launch' END AS decision FROM p""",
)
def ab_decision(spark, d):
    out = X.decision(events_by_arm(spark, d), "ts", "arm", bought(), "A", "B", planned_days=28, lift=0.03)
    return rounded(out.select("span_days", "p", "effect", "power", "window_covered", "decision"), "span_days", "p", "effect", "power")


@query(
    "ab_peeking_summary",
    f"""WITH dd AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE arm = 'A' AND b) AS ca, count(*) FILTER (WHERE arm = 'A') AS na, count(*) FILTER (WHERE arm = 'B' AND b) AS cb, count(*) FILTER (WHERE arm = 'B') AS nb
      FROM (SELECT ts, {ARM} AS arm, event_type = 'purchase' AS b FROM events) GROUP BY 1),
    c AS (SELECT sum(ca) OVER w AS conv_a, sum(na) OVER w AS n_a, sum(cb) OVER w AS conv_b, sum(nb) OVER w AS n_b, row_number() OVER w AS day_no FROM dd WINDOW w AS (ORDER BY day)),
    x AS (SELECT *, (n_a + n_b)::DOUBLE * pow(conv_a::DOUBLE * (n_b - conv_b) - (n_a - conv_a)::DOUBLE * conv_b, 2) / (n_a::DOUBLE * n_b * (conv_a + conv_b) * (n_a + n_b - conv_a - conv_b)) AS chi2 FROM c),
    p AS (SELECT day_no, {K.chi2_p('chi2', '1')} AS p FROM x)
    SELECT round(max(p) FILTER (WHERE day_no = 5), 6) AS p_early, round(arg_max(p, day_no), 6) AS p_final, count(*) FILTER (WHERE p < 0.05) AS days_significant, count(*) AS days FROM p""",
)
def ab_peeking_summary(spark, d):
    out = X.peeking_summary(X.peeking_profile(events_by_arm(spark, d), "ts", "arm", bought(), "A", "B"))
    return rounded(out, "p_early", "p_final")


# ---- survival -----------------------------------------------------------------------------

def shipments(spark, d):
    """Days from order to shipment; line status F is the observed event, the return flag the arm."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linestatus", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.date_diff("l_shipdate", "o_orderdate")
    return joined.select(F.col("l_returnflag").alias("arm"), days.alias("t"), V.event_flag("l_linestatus", "F").alias("event"))


SHIP = """s AS (SELECT l_returnflag AS arm, (l_shipdate::DATE - o_orderdate::DATE)::INT AS t, (l_linestatus = 'F')::INT AS event
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
KM = f"""{SHIP}, c AS (SELECT arm, t, sum(event)::BIGINT AS events, (count(*) - sum(event))::BIGINT AS censored, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT *, (sum(n) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS at_risk FROM c),
k AS (SELECT arm, t, events, censored, at_risk, CASE WHEN bool_or(events = at_risk) OVER w THEN 0.0
      ELSE exp(sum(CASE WHEN events = at_risk THEN 0.0 ELSE ln(1 - events / at_risk) END) OVER w) END AS survival FROM r WINDOW w AS (PARTITION BY arm ORDER BY t))"""


@query("kaplan_meier", f"WITH {KM} SELECT arm, t, events, censored, at_risk, round(survival, 8) AS survival FROM k")
def kaplan_meier(spark, d):
    return rounded(V.kaplan_meier(shipments(spark, d), "t", "event", "arm"), "survival", digits=8)


@query("median_survival", f"WITH {KM} SELECT arm, min(t) FILTER (WHERE survival <= 0.5 + 1e-12) AS median_survival FROM k GROUP BY arm")
def median_survival(spark, d):
    return V.median_survival(V.kaplan_meier(shipments(spark, d), "t", "event", "arm"), "t", "arm")


@query(
    "logrank",
    f"""WITH {SHIP}, c AS (SELECT t, sum(event) AS d, sum(event) FILTER (WHERE arm = 'A') AS da, count(*) AS c, count(*) FILTER (WHERE arm = 'A') AS ca FROM s WHERE arm IN ('A', 'R') GROUP BY t),
    r AS (SELECT d, coalesce(da, 0) AS da, sum(c) OVER w AS n, sum(ca) OVER w AS na FROM c WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    q AS (SELECT sum(da) AS o, sum(d * na / n) AS e, sum(CASE WHEN n > 1 THEN d::DOUBLE * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END) AS v, sum(d) AS d FROM r),
    x AS (SELECT *, pow(o - e, 2) / v AS chi2 FROM q)
    SELECT o::BIGINT AS observed_a, round(e, 6) AS expected_a, round(v, 6) AS variance, d::BIGINT AS events, round(chi2, 6) AS chi2, round({K.chi2_p('chi2', '1')}, 6) AS p FROM x""",
)
def logrank(spark, d):
    return rounded(V.logrank(shipments(spark, d).filter("arm IN ('A', 'R')"), "t", "event", "arm", "A", "R"), "expected_a", "variance", "chi2", "p")


@query(
    "censoring_rate",
    f"""WITH {SHIP}, g AS (SELECT arm, count(*) AS n, 1 - avg(event) AS cr, avg(t) AS m, var_samp(t) AS v, quantile_cont(t, 0.5)::DOUBLE AS med FROM s WHERE arm IN ('A', 'R') GROUP BY arm),
    x AS (SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t, (a.n + b.n - 2)::DOUBLE AS df FROM g a, g b WHERE a.arm = 'A' AND b.arm = 'R'),
    p AS (SELECT {K.t_p('t', 'df')} AS p FROM x)
    SELECT arm, n, round(cr, 6) AS censoring_rate, round(m, 6) AS naive_mean, med AS naive_median, round(p, 6) AS naive_t_p FROM g, p""",
)
def censoring_rate(spark, d):
    return rounded(V.censoring_contrast(shipments(spark, d).filter("arm IN ('A', 'R')"), "t", "event", "arm", "A", "R"), "censoring_rate", "naive_mean", "naive_t_p")
