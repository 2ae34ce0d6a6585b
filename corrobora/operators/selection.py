"""Pipeline stages that learn from the rows they are fitted on, and from no others: scaling and the choice of columns.

Both are ordinary Spark ML stages: they go into a ``Pipeline`` in front of a model, so that a split, a fold or a saved model
takes the scaling and the choice along. What a fitted stage has learned are its params, which is what is saved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .features import mutual_information
from .order_stats import exact_quantiles


class ScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / deviation with the numbers of the fit; a column that was flat there is only centred. Nulls stay null."""

    means = Param(Params._dummy(), "means", "mean of each input column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation of each input column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        return dataset.withColumns({out: (F.col(c).cast("double") - m) / (s or 1.0) for c, out, m, s in learned})


class Scaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns mean and population deviation of each column in one pass."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ScalerModel:
        columns = self.getInputCols()
        numbers = [F.col(c).cast("double") for c in columns]
        row = dataset.agg(*[F.avg(c) for c in numbers], *[F.stddev_pop(c) for c in numbers]).first()
        learned = [0.0 if v is None else float(v) for v in row]
        model = ScalerModel()._set(inputCols=columns, outputCols=self.getOutputCols(), means=learned[: len(columns)], deviations=learned[len(columns) :])
        return model._resetUid(self.uid)


class BestColumnsModel(Model, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Assembles the chosen columns, most informative first; a row with a null in one of them is left out."""

    chosen = Param(Params._dummy(), "chosen", "the columns kept, best first", TypeConverters.toListString)
    information = Param(Params._dummy(), "information", "mutual information of each kept column with the label", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.getOrDefault(self.chosen), outputCol=self.getOutputCol(), handleInvalid="skip").transform(dataset)


class BestColumns(Estimator, HasInputCols, HasLabelCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Chooses the k columns with the largest mutual information with the label, over quantile bins of the rows of the fit.

    Ties go to the first name. Counts of bins and labels are all that leaves the table.
    """

    k = Param(Params._dummy(), "k", "how many columns to keep", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of each column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, labelCol: str = "label", outputCol: str = "features", k: int = 10, bins: int = 10) -> None:
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(labelCol="label", outputCol="features", k=10, bins=10)

    def scores(self, dataset: DataFrame) -> DataFrame:
        """(feature, mi, rank) of all input columns."""
        columns, bins = self.getInputCols(), self.getOrDefault(self.bins)
        rows = staged(dataset.select(self.getLabelCol(), *[F.col(c).cast("double").alias(c) for c in columns]))
        # one long table, so that the cuts of all columns come from the same passes
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
        long = rows.select(F.inline(cells))
        cuts: dict[str, set[float]] = {c: set() for c in columns}
        for r in exact_quantiles(long, "value", [i / bins for i in range(1, bins)], ["feature"]).collect():
            cuts[r["feature"]].add(r["quantile"])
        binned = {c: F.when(F.col(c).isNotNull(), self._bin(F.col(c), sorted(cuts[c]))) for c in columns}
        return mutual_information(rows.withColumns(binned), columns, self.getLabelCol())

    @staticmethod
    def _bin(x: Column, cuts: Sequence[float]) -> Column:
        out = F.lit(0)
        for q in cuts:
            out = out + (x >= q).cast("int")
        return out

    def _fit(self, dataset: DataFrame) -> BestColumnsModel:
        best = self.scores(dataset).filter(F.col("rank") <= self.getOrDefault(self.k)).orderBy("rank").collect()
        model = BestColumnsModel()._set(outputCol=self.getOutputCol(), chosen=[r["feature"] for r in best], information=[float(r["mi"]) for r in best])
        return model._resetUid(self.uid)
