"""Model fits on Spark ML, with the settings that match the usual single-machine defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .features import class_weights


def feature_stages(numeric: Sequence[str], nominal: Sequence[str] = (), drop_last: bool = False) -> list:
    """Indexing, one-hot and assembly, learned from the rows given to fit; levels unknown then share a slot of their own."""
    stages: list = []
    inputs = list(numeric)
    if nominal:
        idx = [f"{c}_idx" for c in nominal]
        hot = [f"{c}_hot" for c in nominal]
        stages.append(StringIndexer(inputCols=list(nominal), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=drop_last, handleInvalid="keep"))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return stages


def fit_on(train: DataFrame, stages: list, row_id: Sequence[str] = ()) -> PipelineModel:
    """Fit on the training rows as a staged table: iterations read files, not the plan behind them.

    With ``row_id`` the rows get a fixed place, so that seeded bagging draws the same rows each run.
    """
    return Pipeline(stages=stages).fit(staged(train, row_id))


def logistic(
    train: DataFrame, label: str, numeric: Sequence[str], nominal: Sequence[str] = (), balanced: bool = False, max_iter: int = 100, tol: float = 1e-5
) -> PipelineModel:
    """L2-regularised logistic regression with unit penalty on the summed loss (1/n on the mean loss)."""
    rows = staged(train)
    n = rows.count()
    data = class_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0))
    model = LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter,
        regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, tol=tol,
    )
    return Pipeline(stages=[*feature_stages(numeric, nominal), model]).fit(data)


def random_forest(train: DataFrame, label: str, numeric: Sequence[str], nominal: Sequence[str] = (), trees: int = 200, depth: int = 8, seed: int = 42, row_id: Sequence[str] = ()) -> PipelineModel:
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return fit_on(train, [*feature_stages(numeric, nominal), model], row_id)


def boosted_trees(train: DataFrame, label: str, numeric: Sequence[str], nominal: Sequence[str] = (), rounds: int = 100, depth: int = 3, step: float = 0.1, seed: int = 42, row_id: Sequence[str] = ()) -> PipelineModel:
    model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return fit_on(train, [*feature_stages(numeric, nominal), model], row_id)


def linear(train: DataFrame, target: str, numeric: Sequence[str], nominal: Sequence[str] = ()) -> PipelineModel:
    model = LinearRegression(featuresCol="features", labelCol=target, solver="normal", regParam=0.0)
    return fit_on(train, [*feature_stages(numeric, nominal), model])


def predictions(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., prediction, score): score is the probability of class 1, or the value itself for regressions."""
    out = model.transform(df)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*keep, F.col("prediction"), score.alias("score"))


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance, rank) of a fitted tree ensemble, one row per feature-vector slot."""
    spark = df.sparkSession
    meta = model.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    values = model.stages[-1].featureImportances.toArray()
    order = sorted(range(len(values)), key=lambda i: (-values[i], names[i]))
    rows = [(names[i], float(values[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")
