"""Merging drifting sources and working on keyed history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import blank_to_null, currency
from ..functions.timezones import iso_utc, wall_to_utc
from .scan import previous


@dataclass(frozen=True)
class SourceSpec:
    """How one source deviates from the canonical schema."""

    name: str
    zone: str = "UTC"
    renames: Mapping[str, str] = field(default_factory=dict)
    currency_columns: Sequence[str] = ()
    blank_columns: Sequence[str] = ()
    timestamp: str = "timestamp"
    timestamp_format: str | None = None


def canonical(df: DataFrame, spec: SourceSpec, columns: Sequence[str], utc: str = "timestamp_utc") -> DataFrame:
    """One source in canonical columns, tagged with its name and time zone; missing columns become NULL."""
    out = df.withColumnsRenamed(dict(spec.renames))
    for c in spec.currency_columns:
        out = out.withColumn(c, currency(c))
    for c in spec.blank_columns:
        out = out.withColumn(c, blank_to_null(c))
    ts = F.col(spec.timestamp)
    if spec.timestamp_format:
        ts = F.to_timestamp_ntz(ts, F.lit(spec.timestamp_format))
    out = out.withColumn(utc, wall_to_utc(ts, spec.zone))
    have = set(out.columns)
    return out.select(
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns],
        F.lit(spec.name).alias("source"),
        F.lit(spec.zone).alias("source_tz"),
    )


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in a stated order; rows are reduced map-side, no per-key sort.

    ``min_by`` over the order struct keeps one row per key and partition before the shuffle, so a
    hot key costs one row per task.
    """
    return _keep(df, key, order, F.min_by)


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key in a stated order."""
    return _keep(df, key, order, F.max_by)


def _keep(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    ranking = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*key).agg(pick(F.struct(*rest), ranking).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def merge_sources(
    sources: Sequence[tuple[DataFrame, SourceSpec]], columns: Sequence[str], key: str, tie: str, utc: str = "timestamp_utc"
) -> DataFrame:
    """Union of all sources in canonical form, first source wins a repeated key, UTC as ISO text."""
    merged: DataFrame | None = None
    for rank, (df, spec) in enumerate(sources):
        part = canonical(df, spec, [*columns, tie], utc).withColumn("_rank", F.lit(rank))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    first = keep_first(merged, [key], ["_rank", tie])
    out = first.withColumn(utc, iso_utc(utc))
    return out.drop("_rank", *([tie] if tie not in columns else []))


def step_changes(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``delta_<c>``: change since the previous row of the same key, 0 for the first.

    Rows without a key have no history and keep 0.
    """
    known = previous(df.filter(F.col(key).isNotNull()), {f"_p_{c}": c for c in columns}, order, [key])
    deltas = {f"delta_{c}": F.coalesce(F.col(c) - F.col(f"_p_{c}"), F.lit(0.0)) for c in columns}
    out = known.withColumns(deltas).drop(*[f"_p_{c}" for c in columns])
    loose = df.filter(F.col(key).isNull()).withColumns({f"delta_{c}": F.lit(0.0) for c in columns})
    return out.unionByName(loose)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the key sets and of their intersection and differences in one pass."""
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    sides = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    in_a, in_b = F.col("_a") == 1, F.col("_b") == 1
    return sides.agg(
        F.count_if(in_a).alias("keys_a"), F.count_if(in_b).alias("keys_b"), F.count_if(in_a & in_b).alias("in_both"),
        F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b"),
    ).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
