"""Models fitted by distributed sums against plain numpy."""

import random

import numpy as np
import pytest

from corrobora.operators import logit, metrics


def penalised_optimum(x, y, w, penalty):
    """Gradient of the penalised loss is zero there: plain Newton on the full matrix."""
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * b)
    return b


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic(spark, balanced):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        a, c = rng.gauss(0, 2), rng.choice("uvw")
        rows.append((i, a, rng.gauss(5, 1), c, int(rng.random() < 1 / (1 + np.exp(-(a - 2.5 + (c == "u")))))))
    df = spark.createDataFrame(rows + [(-1, None, 1.0, "u", 1), (-2, 1.0, 1.0, "u", None)], "id int, a double, b double, c string, y int").repartition(6)
    model = logit.fit_logistic(df, "y", ["a", "b"], ["c"], balanced=balanced)
    x = np.array([[1, r[1], r[2], r[3] == "u", r[3] == "v", r[3] == "w"] for r in rows], float)
    y = np.array([r[4] for r in rows], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    want = penalised_optimum(x, y, w, 1.0)
    assert model.terms == ["const", "a", "b", "c_u", "c_v", "c_w"]
    assert np.allclose(model.coef, want, atol=1e-7) and model.change <= 1e-9
    new = spark.createDataFrame([(1, 0.5, 5.0, "u"), (2, 0.5, 5.0, "never seen"), (3, 0.5, 5.0, None), (4, None, 5.0, "u")], "id int, a double, b double, c string")
    score = {r.id: r.score for r in model.predict(new, ["id"]).collect()}
    chance = lambda z: 1 / (1 + np.exp(-z))
    assert score[1] == pytest.approx(chance(want[0] + 0.5 * want[1] + 5 * want[2] + want[3]))
    assert score[2] == score[3] == pytest.approx(chance(want[0] + 0.5 * want[1] + 5 * want[2]))
    assert score[4] is None


def test_logistic_without_rows_and_with_one_class(spark):
    schema = "a double, c string, y int"
    none = logit.fit_logistic(spark.createDataFrame([], schema), "y", ["a"], ["c"])
    assert none.coef == (0.0, 0.0) and none.levels == {"c": ()}
    one = logit.fit_logistic(spark.createDataFrame([(1.0, "x", 1), (2.0, "x", 1)], schema), "y", ["a"], ["c"], steps=5)
    assert one.steps == 5 and all(np.isfinite(one.coef))


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(logit, "MAX_LEVELS", 3)
    df = spark.createDataFrame([(float(i), f"v{i}", i % 2) for i in range(8)], "a double, c string, y int")
    with pytest.raises(ValueError, match="more than 3 levels"):
        logit.fit_logistic(df, "y", ["a"], ["c"])


def test_matched_accuracy_counts_both_sides(spark):
    sent = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 1.0), (9, 1.0)], "id int, p double")
    held = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0), (5, 0)], "id int, y int")
    r = metrics.matched_accuracy(sent, "p", held, "y", "id").first()
    assert (r.matched, r.unpredicted, r.unlabelled, r.accuracy) == (3, 2, 1, pytest.approx(2 / 3))


def test_draws_are_even_and_the_same_as_columns_and_arrays(spark):
    from pyspark.sql import functions as F

    from corrobora.functions import draws

    df = spark.range(3000).select("id", draws.row_state("id", seed=3).alias("s"))
    rows = df.select("id", "s", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: draws.draw16(F.col("s"), k)).alias("d")).orderBy("id").collect()
    state = np.array([r.s for r in rows])
    got = draws.draws16(state[:, 0], state[:, 1], 41)
    assert (got == np.array([r.d for r in rows])).all()
    counts = np.histogram(got, 16, (0, 65536))[0] / got.size
    assert np.abs(counts - 1 / 16).max() < 0.004
    # neither neighbouring draws nor neighbouring rows go together
    centred = got - 32767.5
    for a, b in ((centred[:, :-1], centred[:, 1:]), (centred[:, :-2], centred[:, 2:]), (centred[:-1], centred[1:])):
        assert abs((a * b).mean() / (centred**2).mean()) < 0.015
    poisson = draws.POISSON_TABLE[got]
    assert abs(poisson.mean() - 1) < 0.01 and abs(poisson.var() - 1) < 0.02


def grow_by_hand(x, g, h, cuts, depth, penalty, least):
    """One tree on plain arrays: every node tries every cut."""
    out = {}

    def node(i, rows, level):
        out[i] = g[rows].sum() / (h[rows].sum() + penalty) if h[rows].sum() + penalty else 0.0
        if level == depth:
            return
        best = None
        gain_of = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
        for f, c in enumerate(cuts):
            for cut in c:
                left, right = rows[~(x[rows, f] >= cut)], rows[x[rows, f] >= cut]
                if min(h[left].sum(), h[right].sum()) >= least and h[left].sum() > 0 and h[right].sum() > 0:
                    gain = gain_of(left) + gain_of(right) - gain_of(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = gain, left, right
        if best:
            node(2 * i + 1, best[1], level + 1)
            node(2 * i + 2, best[2], level + 1)

    node(0, np.arange(len(g)), 0)
    return out


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.uniform(0, 3), float(rng.random() < 0.3)
        rows.append((i, None if i % 97 == 0 else a, b, c, int(rng.random() < 1 / (1 + np.exp(-2 * (a > 0.3) - 1.5 * c + 1.2)))))
    return rows


def test_boosted_trees_follow_the_plain_computation(spark):
    from corrobora.operators import trees

    rows = labelled(900, 3)
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int").repartition(5)
    model = trees.boosted_forest(df, "y", ["a", "b", "c"], ["id"], rounds=3, depth=2, step=0.3, bins=6, indicators=["c"])
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    y = np.array([r[4] for r in rows], float)
    cuts = [np.unique(np.nanquantile(x[:, f], [k / 6 for k in range(1, 6)])) for f in (0, 1)] + [np.array([1.0])]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-total))
        want = grow_by_hand(x, y - p, p * (1 - p), cuts, 2, 1.0, 1e-3)
        at = tree.nodes(x)
        assert set(at) <= set(want)
        assert np.allclose(tree.value[at], [0.3 * want[i] for i in at], atol=1e-9)
        total += tree.value[at]
    got = {r.id: r.score for r in model.predict(df, ["id"]).collect()}
    assert np.allclose([got[r[0]] for r in rows], 1 / (1 + np.exp(-total)))


def test_bagged_forest(spark, monkeypatch):
    from corrobora.operators import trees

    rows = labelled(3000, 5)
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    fit = lambda d, **k: trees.bagged_forest(d, "y", ["a", "b", "c"], ["id"], trees=12, depth=4, bins=12, indicators=["c"], **k)
    model = fit(df.repartition(4), some=2)
    again = fit(df.orderBy("b").repartition(7), some=2)
    assert all((s.feature == t.feature).all() and np.allclose(s.value, t.value) for s, t in zip(model.trees, again.trees))
    monkeypatch.setattr(trees, "CELLS", 1000)  # a few trees at a time
    fewer = fit(df.repartition(4), some=2)
    assert all((s.feature == t.feature).all() and np.allclose(s.value, t.value) for s, t in zip(model.trees, fewer.trees))
    names = [n for n, _, _ in model.importances()]
    assert names[-1] == "b" and sum(v for _, v, _ in model.importances()) == pytest.approx(1.0)
    assert metrics.roc_auc(model.predict(df, ["y"]), "y", "score").first().auc > 0.75
    none = trees.bagged_forest(df.limit(0), "y", ["a"], ["id"], trees=2, depth=2)
    assert none.score(np.zeros((3, 1))).tolist() == [0, 0, 0]


def test_selection_pipeline_learns_from_train_only_and_can_be_saved(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from corrobora.operators import selection

    rng = random.Random(8)
    rows = []
    for i in range(800):
        y = rng.randint(0, 1)
        # tells the label on the test side only: a choice that looked there would take it
        rows.append((i, 3 * y + rng.gauss(0, 1), y + rng.gauss(0, 1), rng.gauss(0, 1), float(y) if i >= 600 else rng.random(), 7.0, y))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, leak double, flat double, y int")
    train, test = df.filter("id < 600"), df.filter("id >= 600")
    columns = ["a", "b", "c", "leak", "flat"]
    scaled = [f"{c}_s" for c in columns]
    stages = [selection.Scaler(inputCols=columns, outputCols=scaled), selection.BestColumns(inputCols=scaled, labelCol="y", k=2), LogisticRegression(labelCol="y")]
    model = Pipeline(stages=stages).fit(train)
    assert model.stages[1].getOrDefault("chosen") == ["a_s", "b_s"]
    x = np.array([r[1:6] for r in rows[:600]])
    assert np.allclose(model.stages[0].getOrDefault("means"), x.mean(0)) and np.allclose(model.stages[0].getOrDefault("deviations"), x.std(0))
    leaky = Pipeline(stages=stages[:2]).fit(df)
    assert "leak_s" in leaky.stages[1].getOrDefault("chosen")
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    scored = lambda m: [tuple(r) for r in m.transform(test).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()]
    assert scored(again) == scored(model)
    hit = model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert hit > 0.85
    # a row with nothing to scale is left out, not guessed
    assert model.transform(spark.createDataFrame([(1, None, 1.0, 1.0, 1.0, 7.0, 1)], df.schema)).count() == 0


def test_bootstrap_draws_keep_32_bits_of_a_digest_per_four_replicates():
    import hashlib

    from corrobora.functions import draws

    for ids in (["17|1", "18|2"], ["1234567890123|4", "1234567890124|4"], ["x" * 60]):
        want = [[int(hashlib.md5(f"{i}|{r // 4}|9".encode()).hexdigest()[8 * (r % 4) :][:8], 16) for r in range(1002)] for i in ids]
        assert (draws.digest_draws(ids, 1002, 9) == np.array(want)).all()
    # a count of eight has a probability below 2^-16; sixteen bits never draw it
    assert draws.poisson_counts(np.array([0, 2**32 - 1], np.uint32)).tolist() == [0, 9]
    from corrobora.plans import ORACLE

    assert "rep // 4" in ORACLE["bootstrap_ci"] and "65535" not in ORACLE["bootstrap_ci"]


def test_bootstrap_counts_are_those_of_the_digests(spark):
    import hashlib

    from corrobora.functions import draws
    from corrobora.operators import regression

    start = draws._MD5_START.copy()
    for ids in (["7"], ["17|1", "18|2"], ["12345678|4", "12345679|4"], ["x" * 60]):
        for blocks in (1, 7, 130):
            raw = [[np.frombuffer(hashlib.md5(f"{i}|{b}|s".encode()).digest(), ">u4") for b in range(blocks)] for i in ids]
            want = draws.poisson_counts(np.array(raw).astype(np.uint32))
            found = draws.Digests(blocks, "s").counts(ids)
            assert all((found[k] == want[:, :, k]).all() for k in range(4))
    assert (draws._MD5_START == start).all()
    # all rows in one of many partitions, ids of several lengths, replicates that are no multiple of four
    rng = np.random.default_rng(5)
    rows = [(10 ** (k % 4) + k, *map(float, rng.normal(size=3))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").coalesce(1)
    df = df.union(spark.createDataFrame([], df.schema).repartition(40))
    found = {r["rep"]: r["coef"] for r in regression.bootstrap_ridge(df, ["a", "b"], "y", ["id"], 6, 2.0, 9).collect()}
    x = np.array([r[1:] for r in rows])
    z = (x - x.mean(0)) / np.append(x[:, :2].std(0), 1.0)
    w = draws.poisson_counts(np.vstack([draws.digest_draws([str(r[0])], 6, 9) for r in rows])).astype(float)
    assert sorted(found) == list(range(6))
    for rep in range(6):
        c = z - np.average(z, axis=0, weights=w[:, rep])
        s = (c * w[:, rep : rep + 1]).T @ c
        assert np.allclose(found[rep], np.linalg.solve(s[:2, :2] + 2 * np.eye(2), s[:2, 2]))
    assert regression.bootstrap_ridge(df, ["a"], "y", ["id"], 5, 0.0, 9).count() == 5
