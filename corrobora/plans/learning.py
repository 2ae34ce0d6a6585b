"""Feature preparation, models and scores on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import sql_draws, sql_poisson, sql_state
from ..functions.scalars import hash_unit
from ..operators import features as P
from ..operators import logit as LG
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import sampling
from ..operators import selection as SL
from ..operators import trees as TR
from ..operators.regression import dummies
from ..session import staged
from ..sources.readers import table
from . import sqlkit as K
from .inference import rounded
from .registry import query
from .relational import unit


def parts(spark, d):
    """Parts with a train / test side fixed by the part key."""
    return sampling.hash_split(table(spark, d, "part"), ["p_partkey"], 0.8, seed=1)


PARTS = f"p AS MATERIALIZED (SELECT *, CASE WHEN {unit('p_partkey', 1)} < 0.8 THEN 'train' ELSE 'test' END AS split FROM part)"


@query(
    "train_scale",
    f"""WITH {PARTS}, s AS (SELECT avg(p_size) AS ma, stddev_pop(p_size) AS sa, avg(p_retailprice) AS mb, stddev_pop(p_retailprice) AS sb FROM p WHERE split = 'train'),
    l AS (SELECT avg(p_size) AS la, stddev_pop(p_size) AS lsa FROM p)
    SELECT p_partkey, split, round((p_size - ma) / sa, 6) AS std_p_size, round((p_retailprice - mb) / sb, 6) AS std_p_retailprice, round((p_size - la) / lsa, 6) AS leaky_p_size FROM p, s, l""",
)
def train_scale(spark, d):
    rows = parts(spark, d)
    scaled = P.standardise(rows, rows.filter("split = 'train'"), ["p_size", "p_retailprice"])
    scaled = P.standardise(scaled, rows, ["p_size"], prefix="leaky_")
    return rounded(scaled.select("p_partkey", "split", "std_p_size", "std_p_retailprice", "leaky_p_size"), "std_p_size", "std_p_retailprice", "leaky_p_size")


@query(
    "clip_range",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderdate < TIMESTAMP '1995-07-01')
    SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS clipped FROM orders, b""",
)
def clip_range(spark, d):
    o = table(spark, d, "orders")
    out = P.clip_to_train(o, o.filter(F.col("o_orderdate") < "1995-07-01"), ["o_totalprice"])
    return out.select("o_orderkey", F.col("o_totalprice").alias("clipped"))


ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "ordinal",
    f"""SELECT nullif(list_position({ORDER!r}, o_orderpriority), 0) - 1 AS level, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL""",
)
def ordinal(spark, d):
    o = table(spark, d, "orders").withColumn("level", P.ordinal("o_orderpriority", ORDER))
    return rounded(o.groupBy("level", "o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), "mean", digits=4).withColumn("level", F.col("level").cast("int"))


@query(
    "onehot_minfreq",
    f"""WITH {PARTS}, c AS (SELECT p_name, count(*) AS n FROM p WHERE split = 'train' GROUP BY 1)
    SELECT split, CASE WHEN n >= 60 THEN p_name WHEN n IS NOT NULL THEN 'infrequent' END AS pooled, count(*) AS rows FROM p LEFT JOIN c USING (p_name) GROUP BY ALL""",
)
def onehot_minfreq(spark, d):
    rows = parts(spark, d)
    out = P.pool_rare(rows, rows.filter("split = 'train'"), "p_name", 60, "pooled")
    return out.groupBy("split", "pooled").agg(F.count("*").alias("rows"))


#: All levels of part.p_type.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "onehot_columns",
    "SELECT p_partkey, " + ", ".join(f"(p_type = '{t}')::INT::DOUBLE AS \"type_{t}\"" for t in PART_TYPES) + " FROM part",
)
def onehot_columns(spark, d):
    rows, names = dummies(table(spark, d, "part"), "p_type", PART_TYPES, drop_first=False, prefix="type")
    return rows.select("p_partkey", *names)


@query(
    "target_encode_oof",
    f"""WITH e AS (SELECT event_id, user_id, (event_type = 'purchase')::INT AS y, floor({unit('event_id', 2)} * 5)::INT AS fold FROM events),
    s AS (SELECT user_id, fold, sum(y) AS s, count(y) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(s) OVER w AS ts, sum(n) OVER w AS tn FROM s WINDOW w AS (PARTITION BY user_id))
    SELECT event_id, e.fold, round(ts / tn, 6) AS te_leaky, round((ts - s) / nullif(tn - n, 0), 6) AS te_oof FROM e JOIN t ON e.user_id = t.user_id AND e.fold = t.fold""",
)
def target_encode_oof(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    out = P.target_encode(rows, "user_id", "y", ["event_id"], 5, seed=2)
    return rounded(out.select("event_id", "fold", "te_leaky", "te_oof"), "te_leaky", "te_oof")


def _cut(x: str) -> str:
    return " + ".join(f"({x} >= c[{i}])::INT" for i in range(1, 10))


@query(
    "quantile_bins",
    f"""WITH b AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
    SELECT ({_cut('o_totalprice')})::INT AS bin, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders, b GROUP BY 1""",
)
def quantile_bins(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_totalprice")
    out = P.quantile_bins(o, o.filter(F.col("o_orderdate") < "2000-01-01"), "o_totalprice", 10, "bin")
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query(
    "binned_mi",
    f"""WITH q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM events),
    e AS (SELECT (event_type = 'error')::INT AS y, (({_cut('value')})::INT)::VARCHAR AS value_bin, date_part('hour', ts)::INT::VARCHAR AS hour, (user_id % 10)::VARCHAR AS user_mod FROM events, q),
    f AS (SELECT 'value_bin' AS feature, value_bin AS v, y FROM e UNION ALL SELECT 'hour', hour, y FROM e UNION ALL SELECT 'user_mod', user_mod, y FROM e),
    j AS (SELECT feature, v, y, count(*) AS n FROM f GROUP BY ALL),
    x AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, v) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM j),
    m AS (SELECT feature, sum(n / t * ln(n::DOUBLE * t / (nx * ny))) AS mi FROM x GROUP BY 1)
    SELECT feature, round(mi, 8) AS mi, row_number() OVER (ORDER BY mi DESC, feature)::INT AS rank FROM m""",
)
def binned_mi(spark, d):
    e = table(spark, d, "events")
    rows = P.quantile_bins(e, e, "value", 10).select(
        (F.col("event_type") == "error").cast("int").alias("y"), "value_bin", F.hour("ts").alias("hour"), (F.col("user_id") % 10).alias("user_mod")
    )
    return rounded(P.mutual_information(rows, ["value_bin", "hour", "user_mod"], "y"), "mi", digits=8)


_PROBS = [i / 99 for i in range(100)]


@query(
    "quantile_to_normal",
    f"""WITH q AS (SELECT quantile_cont(o_totalprice, {_PROBS!r}) AS c FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
    k AS (SELECT unnest(range(0, 100)) AS i, unnest(c) AS x FROM q), n AS (SELECT a.i, a.x, b.x AS nx FROM k a LEFT JOIN k b ON b.i = a.i + 1),
    r AS (SELECT o_orderkey, o_totalprice AS v, i, x, nx FROM orders ASOF LEFT JOIN n ON o_totalprice >= n.x),
    p AS (SELECT o_orderkey, least(greatest(CASE WHEN i IS NULL THEN 0.0 WHEN nx IS NULL THEN 1.0 ELSE (i + (v - x) / (nx - x)) / 99 END, 1e-7), 1 - 1e-7) AS p FROM r)
    SELECT o_orderkey, round({K.normal_quantile('p')}, 6) AS z FROM p""",
)
def quantile_to_normal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = P.quantile_to_normal(o, o.filter(F.col("o_orderdate") < "2000-01-01"), "o_totalprice", 100, "z")
    return rounded(out.select("o_orderkey", "z"), "z")


@query(
    "class_weights",
    """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM c)
    SELECT quality, count(*) AS n, round(sum(t / (k * c.n)), 6) AS total_weight FROM labels JOIN c USING (quality), t GROUP BY quality""",
)
def class_weights(spark, d):
    out = P.class_weights(table(spark, d, "labels"), "quality")
    return rounded(out.groupBy("quality").agg(F.count("*").alias("n"), F.sum("weight").alias("total_weight")), "total_weight")


# ---- metrics ------------------------------------------------------------------------------

SCORED = f"""s AS MATERIALIZED (SELECT doc_id, lang, quality, ({unit('doc_id', 4)} + 0.3 * quality) AS score FROM documents JOIN labels USING (doc_id)), h AS (SELECT *, (score > 0.6)::INT AS pred FROM s)"""


def scored(spark, d):
    """A fixed score per labelled document: a hash plus a little truth."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    rows = rows.withColumn("score", hash_unit("doc_id", seed=4) + 0.3 * F.col("quality"))
    return rows.withColumn("pred", (F.col("score") > 0.6).cast("int"))


@query(
    "metrics",
    f"""WITH {SCORED}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND pred = 0) AS tn FROM h GROUP BY lang)
    SELECT lang, n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, (tp + fp = 0) OR (fn + tn = 0) AS constant_prediction FROM c""",
)
def metrics(spark, d):
    return rounded(M.classification(scored(spark, d), "quality", "pred", ["lang"]), "accuracy", "precision", "recall", "f1")


@query(
    "roc_auc",
    f"""WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s),
    a AS (SELECT count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q, sum(rk) FILTER (WHERE quality = 1) AS rs FROM r)
    SELECT p AS n_pos, q AS n_neg, round((rs - p * (p + 1) / 2) / (p * q), 6) AS auc FROM a""",
)
def roc_auc(spark, d):
    return rounded(M.roc_auc(scored(spark, d), "quality", "score"), "auc")


@query(
    "regression_errors",
    """WITH m AS (SELECT avg(l_extendedprice / l_quantity) AS k FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(sqrt(avg(pow(l_extendedprice - k * l_quantity, 2))), 2) AS rmse, round(avg(abs(l_extendedprice - k * l_quantity)), 2) AS mae FROM lineitem, m GROUP BY 1""",
)
def regression_errors(spark, d):
    li = table(spark, d, "lineitem")
    k = li.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).scalar()
    rows = li.select("l_returnflag", "l_extendedprice", (k * F.col("l_quantity")).alias("guess"))
    return rounded(M.regression_errors(rows, "l_extendedprice", "guess", ["l_returnflag"]), "rmse", "mae", digits=2)


# ---- models -------------------------------------------------------------------------------

NUMERIC = ["log_chars", "words", "lines"]


def document_features(spark, d):
    """Labelled documents with size features and a train / test side stratified by label."""
    # features first: the join shuffles a few numbers per document and not the texts
    sizes = table(spark, d, "documents").select(
        "doc_id", "lang", "source", F.log1p("n_chars").alias("log_chars"),
        F.log1p(F.size(F.split("text", r"\s+"))).alias("words"), F.log1p(F.size(F.split("text", "\n"))).alias("lines"),
    )  # fmt: skip
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = staged(sizes.join(labels, "doc_id"))
    return sampling.stratified_split(rows, "quality", ["doc_id"], 0.8, seed=6)


def sides(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


LANGS = ["de", "en", "es", "fr"]
#: Labelled documents with the features as x1, x2, ..., in the order of the fit, and the side of the split.
LABELLED = rf"""lb AS MATERIALIZED (SELECT doc_id, quality, lang, ln(1 + n_chars) AS x1, ln(1 + len(regexp_split_to_array(text, '[ 	

]+'))) AS x2,
      ln(1 + len(string_split(text, chr(10)))) AS x3, {unit('doc_id', 6)} AS u FROM documents JOIN labels USING (doc_id)),
    lc AS (SELECT quality, quantile_cont(u, 0.8) AS cut, count(*) FILTER (WHERE u IS NOT NULL) AS n FROM lb GROUP BY quality),
    ls AS MATERIALIZED (SELECT lb.*, CASE WHEN u <= cut THEN 'train' ELSE 'test' END AS split FROM lb JOIN lc USING (quality))"""
_HOT = ", ".join(f"(lang IS NOT DISTINCT FROM '{v}')::INT::DOUBLE AS x{i}" for i, v in enumerate(LANGS, 4))
LOGIT = [
    LABELLED,
    f"hot AS MATERIALIZED (SELECT *, {_HOT} FROM ls)",
    "cw AS (SELECT quality, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM ls WHERE split = 'train' GROUP BY quality)",
    "tr AS MATERIALIZED (SELECT hot.*, quality::DOUBLE AS y, w FROM hot JOIN cw USING (quality) WHERE split = 'train')",
    *K.newton_ctes("nt", "tr", 3 + len(LANGS), 9),
    "pr AS MATERIALIZED (SELECT doc_id, quality, 1 / (1 + exp(-(b0 + " + " + ".join(f"b{i} * x{i}" for i in range(1, 4 + len(LANGS))) + "))) AS score FROM hot, nt WHERE split = 'test')",
]


def balanced_logit(spark, d):
    """Fit on the training side, and the rows of the test side."""
    train, test = sides(document_features(spark, d))
    return LG.fit_logistic(train, "quality", NUMERIC, ["lang"], balanced=True), test


@query(
    "logreg_balanced",
    K.with_ctes(
        [*LOGIT, """c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND score > 0.5) AS tp, count(*) FILTER (WHERE quality = 0 AND score > 0.5) AS fp,
          count(*) FILTER (WHERE quality = 1 AND score <= 0.5) AS fn, count(*) FILTER (WHERE quality = 0 AND score <= 0.5) AS tn FROM pr)"""],
        """SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision",
        round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
        (tp + fp = 0) OR (fn + tn = 0) AS constant_prediction FROM c""",
    ),
)  # fmt: skip
def logreg_balanced(spark, d):
    model, test = balanced_logit(spark, d)
    out = model.predict(test, ["doc_id", "quality"])
    return rounded(M.classification(out, "quality", "prediction"), "accuracy", "precision", "recall", "f1")


@query("class_predictions", K.with_ctes(LOGIT, "SELECT doc_id, (score > 0.5)::INT AS predicted_class, round(score, 6) AS score FROM pr"))
def class_predictions(spark, d):
    model, test = balanced_logit(spark, d)
    out = model.predict(test, ["doc_id"])
    return rounded(out.select("doc_id", F.col("prediction").cast("int").alias("predicted_class"), "score"), "score")


@query(
    "logreg_terms",
    K.with_ctes(LOGIT, " UNION ALL ".join(f"SELECT '{t}' AS term, round(b{i}, 6) AS coef FROM nt" for i, t in enumerate(["const", *NUMERIC, *(f"lang_{v}" for v in LANGS)]))),
)
def logreg_terms(spark, d):
    """The fitted numbers themselves."""
    model, _ = balanced_logit(spark, d)
    return rounded(spark.createDataFrame(list(zip(model.terms, model.coef)), "term string, coef double"), "coef")


@query(
    "predictions_to_labels",
    K.with_ctes(
        [*LOGIT, "sent AS (SELECT doc_id, (score > 0.5)::INT AS predicted FROM pr WHERE doc_id % 10 <> 3 UNION ALL SELECT -1 - doc_id, 1 FROM pr WHERE doc_id % 10 = 3)",
         "tst AS (SELECT doc_id, quality FROM ls WHERE split = 'test')",
         "j AS (SELECT predicted, quality FROM sent FULL JOIN tst USING (doc_id))"],
        """SELECT count(*) FILTER (WHERE predicted IS NOT NULL AND quality IS NOT NULL) AS matched, count(*) FILTER (WHERE predicted IS NULL) AS unpredicted,
        count(*) FILTER (WHERE quality IS NULL) AS unlabelled, round(avg((predicted = quality)::INT), 6) AS accuracy FROM j""",
    ),
)  # fmt: skip
def predictions_to_labels(spark, d):
    """A delivered prediction file against the labels: some rows are missing, some name ids that no label has."""
    model, test = balanced_logit(spark, d)
    lost = F.col("doc_id") % 10 == 3
    out = model.predict(test, ["doc_id"]).withColumn("prediction", F.when(lost, 1.0).otherwise(F.col("prediction")))
    sent = out.select(F.when(lost, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "prediction")
    return rounded(M.matched_accuracy(sent, "prediction", test.select("doc_id", "quality"), "quality", "doc_id"), "accuracy")


FOREST = [*NUMERIC, *(f"lang_{v}" for v in LANGS)]
_TREES, _BINS = 3, 8


def _forest_sql() -> list[str]:
    """Three bagged trees of depth 2 from the same histograms: bins, draws, two levels of cuts, then a value per row and tree."""
    probs = [k / _BINS for k in range(1, _BINS)]
    cuts = ", ".join(f"list_distinct(quantile_cont(x{i}, {probs})) AS c{i}" for i in (1, 2, 3))
    bins = [f"len(list_filter(c{i}, lambda q: q <= x{i}))" for i in (1, 2, 3)] + [f"(x{i} >= 1)::INT" for i in range(4, 4 + len(LANGS))]
    out = [
        *LOGIT[:2],
        f"fq AS (SELECT {cuts} FROM ls WHERE split = 'train')",
        f"fr AS MATERIALIZED (SELECT doc_id, split, quality, [{', '.join(b + '::BIGINT' for b in bins)}] AS bins, {sql_state(['doc_id'], 12)} FROM hot, fq)",
        f"ft AS (SELECT doc_id, t, high, low FROM fr, range(0, {_TREES}) r(t))",
        *sql_draws("dr", "ft", "t", "doc_id"),
        f"f0 AS MATERIALIZED (SELECT t, doc_id, split, quality::DOUBLE AS y, bins, {sql_poisson('draw')} AS w, 0 AS node, 0.0::DOUBLE AS v FROM fr JOIN dr USING (doc_id))",
    ]
    for k in (0, 1):
        out += [
            f"h{k} AS (SELECT t, node, f, bin, sum(w * y) AS g, sum(w)::DOUBLE AS h FROM (SELECT t, node, y, w, unnest(range({len(FOREST)})) AS f, unnest(bins) AS bin FROM f{k} WHERE split = 'train' AND w > 0) GROUP BY ALL)",
            f"s{k} AS (SELECT *, sum(g) OVER b AS gl, sum(h) OVER b AS hl, sum(g) OVER e AS gt, sum(h) OVER e AS ht FROM h{k} WINDOW b AS (PARTITION BY t, node, f ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY t, node, f))",
            f"c{k} AS (SELECT *, CASE WHEN hl >= 1 AND ht - hl >= 1 THEN gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht END AS gain FROM s{k})",
            f"m{k} AS MATERIALIZED (SELECT * FROM c{k} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY gain DESC, f, bin) = 1)",
            f"""f{k + 1} AS MATERIALIZED (SELECT r.t, doc_id, split, y, bins, w, CASE WHEN m.f IS NULL THEN r.node ELSE 2 * r.node + 1 + (bins[m.f + 1] >= m.bin)::INT END AS node,
              CASE WHEN m.f IS NULL THEN v WHEN bins[m.f + 1] >= m.bin THEN (gt - gl) / (ht - hl) ELSE gl / hl END AS v FROM f{k} r LEFT JOIN m{k} m ON m.t = r.t AND m.node = r.node)""",
        ]
    return out


def small_forest(spark, d):
    """Three trees of depth 2 over the training side, and the rows of the test side."""
    rows, names = dummies(document_features(spark, d), "lang", LANGS, drop_first=False, prefix="lang")
    train, test = sides(rows)
    return TR.bagged_forest(train, "quality", [*NUMERIC, *names], ["doc_id"], trees=_TREES, depth=2, bins=_BINS, indicators=names, seed=12), test


@query(
    "forest_importance",
    K.with_ctes(
        [*_forest_sql(), "a AS (SELECT t, f, gain FROM m0 UNION ALL SELECT t, f, gain FROM m1)", "p AS (SELECT t, f, sum(gain) / sum(sum(gain)) OVER (PARTITION BY t) AS part FROM a GROUP BY t, f)",
         f"nm AS (SELECT unnest(range({len(FOREST)})) AS f, unnest({FOREST!r}) AS feature)", f"i AS (SELECT feature, coalesce(sum(part), 0) / {_TREES} AS importance FROM nm LEFT JOIN p USING (f) GROUP BY feature)"],
        "SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank FROM i",
    ),
)  # fmt: skip
def forest_importance(spark, d):
    model, test = small_forest(spark, d)
    return rounded(TR.importance_table(model, test), "importance")


@query(
    "forest_auc",
    K.with_ctes(
        [*_forest_sql(), "sc AS (SELECT doc_id, any_value(y) AS quality, sum(v) / count(*) AS score FROM f2 WHERE split = 'test' GROUP BY doc_id)",
         "r AS (SELECT quality, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 AS rk FROM sc)",
         "a AS (SELECT count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q, sum(rk) FILTER (WHERE quality = 1) AS rs FROM r)"],
        "SELECT p AS n_pos, q AS n_neg, round((rs - p * (p + 1) / 2) / (p * q), 6) AS auc FROM a",
    ),
)  # fmt: skip
def forest_auc(spark, d):
    model, test = small_forest(spark, d)
    # sums of three shares in another order differ in the last digit, which must not break a tie
    out = model.predict(test, ["quality"]).withColumn("score", F.round("score", 9))
    return rounded(M.roc_auc(out, "quality", "score"), "auc")


#: Size features that say something, and eight columns of noise that say nothing.
CANDIDATES = [*NUMERIC, *(f"noise{i}" for i in range(8))]
_CAND = [*(f"x{i}" for i in (1, 2, 3)), *(unit("doc_id", 100 + i) for i in range(8))]


def _mi_sql(name: str, where: str) -> list[str]:
    probs = [k / 10 for k in range(1, 10)]
    cuts = ", ".join(f"list_distinct(quantile_cont({c}, {probs})) AS c{i}" for i, c in enumerate(CANDIDATES))
    bins = " UNION ALL ".join(f"SELECT '{c}' AS feature, quality AS y, len(list_filter(c{i}, lambda q: q <= {c})) AS v FROM cd, {name}_q WHERE {where}" for i, c in enumerate(CANDIDATES))
    return [
        f"{name}_q AS MATERIALIZED (SELECT {cuts} FROM cd WHERE {where})",
        f"{name}_j AS (SELECT feature, v, y, count(*) AS n FROM ({bins}) GROUP BY ALL)",
        f"{name}_x AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, v) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM {name}_j)",
        f"{name}_m AS (SELECT feature, sum(n / t * ln(n::DOUBLE * t / (nx * ny))) AS mi FROM {name}_x GROUP BY feature)",
        f"{name} AS (SELECT feature, mi, row_number() OVER (ORDER BY round(mi, 12) DESC, feature)::INT AS place FROM {name}_m)",
    ]


def candidates(spark, d):
    rows = document_features(spark, d)
    return staged(rows.withColumns({f"noise{i}": hash_unit("doc_id", seed=100 + i) for i in range(8)}))


def chooser(spark, d):
    return SL.BestColumns(inputCols=CANDIDATES, labelCol="quality", k=3)


@query(
    "selection_contrast",
    K.with_ctes(
        [LABELLED, "cd AS MATERIALIZED (SELECT doc_id, quality, split, " + ", ".join(f"{e} AS {c}" for c, e in zip(CANDIDATES, _CAND)) + " FROM ls)", *_mi_sql("tn", "split = 'train'"), *_mi_sql("al", "true")],
        "SELECT feature, round(tn.mi, 8) AS mi_train, tn.place AS rank_train, tn.place <= 3 AS chosen, round(al.mi, 8) AS mi_all, al.place AS rank_all, al.place <= 3 AS chosen_leaky FROM tn JOIN al USING (feature)",
    ),
)  # fmt: skip
def selection_contrast(spark, d):
    """Columns chosen on the training side, next to what a look at all rows would have chosen."""
    rows, choose = candidates(spark, d), chooser(spark, d)
    seen = choose.scores(sides(rows)[0]).select("feature", F.col("mi").alias("mi_train"), F.col("rank").alias("rank_train"), (F.col("rank") <= 3).alias("chosen"))
    leaky = choose.scores(rows).select("feature", F.col("mi").alias("mi_all"), F.col("rank").alias("rank_all"), (F.col("rank") <= 3).alias("chosen_leaky"))
    return rounded(seen.join(leaky, "feature"), "mi_train", "mi_all", digits=8)


@query("rf_importance")
def rf_importance(spark, d):
    train, _ = sides(document_features(spark, d))
    model = ML.random_forest(train, "quality", NUMERIC, ["lang"], trees=200, depth=8, row_id=["doc_id"])
    return rounded(ML.importances(model, train), "importance").filter("rank <= 5")


@query("gbt_model")
def gbt_model(spark, d):
    train, test = sides(document_features(spark, d))
    model = ML.boosted_trees(train, "quality", NUMERIC, ["lang"], rounds=100, row_id=["doc_id"])
    out = ML.predictions(model, test, ["doc_id", "quality"])
    return rounded(M.roc_auc(out, "quality", "score"), "auc")


@query("linreg_rmse")
def linreg_rmse(spark, d):
    """Integer codes used as numbers against the same codes used as categories."""
    rows = sampling.hash_split(table(spark, d, "part").withColumn("code", F.col("p_size").cast("string")), ["p_partkey"], 0.8, seed=8)
    train, test = sides(rows)
    naive = ML.predictions(ML.linear(train, "p_retailprice", ["p_size"]), test, ["p_retailprice"]).withColumn("model", F.lit("as_number"))
    fixed = ML.predictions(ML.linear(train, "p_retailprice", [], ["code", "p_type"]), test, ["p_retailprice"]).withColumn("model", F.lit("as_category"))
    return rounded(M.regression_errors(naive.unionByName(fixed), "p_retailprice", "prediction", ["model"]), "rmse", "mae", digits=4)
