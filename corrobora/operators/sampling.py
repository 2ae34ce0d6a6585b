"""Samples and splits fixed by row ids: the same on every run, cluster and partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import hash_order, hash_unit
from .order_stats import before_row, exact_quantiles, rows_at


def random_sample(df: DataFrame, row_id: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement (n is a report-sized number: the top-n stays on one node)."""
    ranked = df.withColumn("_h", hash_order(*row_id, seed=seed))
    return ranked.orderBy("_h", *row_id).limit(n).drop("_h")


def stratified_sample(df: DataFrame, key: str, row_id: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Up to n rows per key. The rank filter is pushed below the shuffle (at most n rows per key and task)."""
    w = Window.partitionBy(key).orderBy(hash_order(*row_id, seed=seed), *row_id)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hash_split(df: DataFrame, row_id: Sequence[str], fraction: float = 0.8, seed: int = 0, out: str = "split") -> DataFrame:
    """Tag rows 'train' / 'test' by id. Pass an entity id to keep an entity on one side."""
    return df.withColumn(out, F.when(hash_unit(*row_id, seed=seed) < fraction, F.lit("train")).otherwise(F.lit("test")))


def stratified_split(
    df: DataFrame, label: str, row_id: Sequence[str], fraction: float = 0.8, seed: int = 0, out: str = "split"
) -> DataFrame:
    """Train share equal in every class: the cut is the exact quantile of the row hash within the class.

    The cut is found by selection, so a class with most of the rows is never sorted in one task.
    """
    rows = df.withColumn("_u", hash_unit(*row_id, seed=seed))
    cuts = exact_quantiles(rows, "_u", [fraction], [label]).select(label, F.col("quantile").alias("_cut"))
    cuts = cuts.withColumnRenamed(label, "_label")
    tagged = rows.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    side = F.when(F.col("_u") <= F.col("_cut"), F.lit("train")).otherwise(F.lit("test"))
    return tagged.withColumn(out, side).drop("_u", "_cut")


def chronological_split(df: DataFrame, order: Sequence[str], fraction: float = 0.8, out: str = "split") -> DataFrame:
    """First ``fraction`` of the rows in time order train, the rest test; order must end in a unique id."""
    return _split_at(df, order, math.floor(df.count() * fraction), out)


def positional_split(df: DataFrame, order: Sequence[str], n_train: int, out: str = "split") -> DataFrame:
    """The first ``n_train`` rows in order train."""
    return _split_at(df, order, n_train, out)


def _split_at(df: DataFrame, order: Sequence[str], position: int, out: str) -> DataFrame:
    """Rows before the one at ``position`` are train: that row is found by counting, the others are only compared with it.

    Beyond the last row all are train. Rows that tie with the cut in the whole order are test.
    """
    numbers, found = rows_at(df, order, [position])
    side = before_row(numbers, found[position]) if found else F.lit(position > 0)
    return df.withColumn(out, F.when(side, F.lit("train")).otherwise(F.lit("test")))


def equal_parts(df: DataFrame, order: Sequence[str], parts: int, out: str = "part") -> DataFrame:
    """Part 0 to ``parts`` - 1 of each row: part i begins at the row at position ceil(i * n / parts) along the order.

    The first rows of the parts are found by counting, all in the same rounds.
    """
    n = df.count()
    numbers, found = rows_at(df, order, sorted({-(-i * n // parts) for i in range(1, parts)}))
    part = F.lit(parts - 1)
    for i in range(parts - 1, 0, -1):
        cut = -(-i * n // parts)
        part = F.when(before_row(numbers, found[cut]), i - 1).otherwise(part) if cut in found else F.lit(i - 1)
    return df.withColumn(out, part.cast("int"))


def split_report(df: DataFrame, split: str, target: Column | str) -> DataFrame:
    """(split, n, rate)."""
    t = F.col(target) if isinstance(target, str) else target
    return df.groupBy(split).agg(F.count("*").alias("n"), F.avg(t.cast("double")).alias("rate"))
