"""Ordered computations over a whole table without a single-task window.

A window without a partition key moves every row to one task; one with a hot key moves a third
of the table there. The three primitives below keep the work spread:

range_buckets   order-preserving buckets with bounds at approximate quantiles
prefix_sums     running sums: window inside (key, bucket) plus the offset of earlier buckets
with_halo       equal-sized chunks of a dense row index, each with copies of its neighbours'
                edge rows, so that lag / moving-average frames never look outside a chunk

Key columns given as ``by`` must not be NULL: offsets meet the rows in an equi-join.

Buckets depend only on the data (bounds become literals of the plan), never on physical
partition ids, so a lost executor recomputes the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import as_col
from ..session import parallelism, staged

BUCKET = "_bucket"


def sortable(df: DataFrame, order: str) -> Column:
    """Order-preserving double for a numeric, date or timestamp column (used for bucketing only)."""
    kind = dict(df.dtypes)[order]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    if kind == "string":
        raise TypeError(f"{order}: order by a number, date or timestamp")
    return F.col(order).cast("double")


def range_buckets(
    df: DataFrame, order: str, n_buckets: int | None = None, out: str = BUCKET, then: str | None = None
) -> DataFrame:
    """Add a bucket that never decreases along ``order``; equal values share a bucket.

    The bounds come from one approximate-quantile pass over the one column; at most
    ``n_buckets`` numbers reach the driver. They only balance the work: any bounds give the same
    result. ``n_buckets=1`` skips the pass, for tables already collapsed to calendar periods. A value that fills whole buckets by itself (it shows up
    as several bounds) would still land in one task: with ``then``, the next order column, its
    rows are split by the quantiles of that column, so the order (order, then) is kept.
    """
    n = n_buckets or parallelism(df.sparkSession)
    keyed = df.withColumn("_sortable", sortable(df, order))
    bounds: list[float] = []
    hot: list[float] = []
    if n > 1:
        found = _balanced_bounds(keyed, "_sortable", n)
        bounds = sorted(set(found))
        hot = sorted({b for b in bounds if found.count(b) > 1})
    if not bounds:
        # one bucket; computed from the row so that joins on it stay equi-joins
        return keyed.withColumn(out, F.pmod(F.hash("_sortable"), F.lit(1))).drop("_sortable")
    bucketed = _cut(keyed, "_sortable", bounds, out)
    if hot and then is not None and dict(df.dtypes)[then] != "string":
        # a hot value is the lower bound of its bucket, so its parts come before the rest of it
        bucketed = bucketed.withColumn("_then", sortable(df, then))
        is_hot = F.col("_sortable").isin(hot)
        parts = _balanced_bounds(bucketed.filter(is_hot), "_then", n)
        bucketed = _cut(bucketed, "_then", sorted(set(parts)), "_part")
        part = F.when(is_hot, F.col("_part")).otherwise(F.lit(n))
        bucketed = bucketed.withColumn(out, F.col(out) * (n + 1) + part).drop("_then", "_part")
    return bucketed.drop("_sortable")


_ROWS_PER_BUCKET = 50_000


def collapsed_buckets(counts: DataFrame, order: str, n_buckets: int | None = None) -> DataFrame:
    """Buckets of a table already grouped to one row per value.

    The grouping is the pass over the raw rows; its result is staged so that the bounds, the bucket
    totals and the windows read the small table and not the raw rows again. As many buckets as its
    size calls for, one (and no bounds pass) when it is small.
    """
    table = staged(counts)
    n = n_buckets or min(parallelism(counts.sparkSession), math.ceil(table.count() / _ROWS_PER_BUCKET) or 1)
    return range_buckets(table, order, n)


_SKETCH_GROUPS = 64


def _balanced_bounds(df: DataFrame, column: str, n: int) -> list[float]:
    """n - 1 approximate quantiles, merged in two levels so that no reducer meets all sketches."""
    probs = [i / n for i in range(1, n)]
    fine = [i / (2 * n) for i in range(2 * n + 1)]
    rows = df.select(F.col(column)).filter(F.col(column).isNotNull() & ~F.isnan(column))
    groups = rows.groupBy((F.spark_partition_id() % _SKETCH_GROUPS).alias("g")).agg(
        F.percentile_approx(column, fine, 4 * n).alias("q")
    )
    merged = groups.select(F.explode("q").alias("q")).agg(F.percentile_approx("q", probs, 4 * n).alias("b")).first()
    return [b for b in (merged["b"] or []) if math.isfinite(b)]


def _cut(df: DataFrame, column: str, bounds: Sequence[float], out: str) -> DataFrame:
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=column, outputCol=out, handleInvalid="keep")
    return cut.transform(df).withColumn(out, F.col(out).cast("int"))


def prefix_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column | str],
    by: Sequence[str] = (),
    ties: str = "rows",
    reverse: bool = False,
    bucket: str = BUCKET,
) -> DataFrame:
    """Inclusive running sums along ``order`` within ``by``, for a table from ``range_buckets``.

    ties='rows' needs a unique order; ties='range' gives equal order values the same sum.
    reverse=True sums from the row to the end (risk sets).
    """
    by = list(by)
    tmp = {name: f"_sum_{i}" for i, name in enumerate(sums)}
    totals = df.groupBy(*by, bucket).agg(*[F.sum(as_col(c)).alias(tmp[n]) for n, c in sums.items()])
    walk = F.col(bucket).desc() if reverse else F.col(bucket).asc()
    # one row per (key, bucket): at most n_buckets rows per key meet in this window
    earlier = Window.partitionBy(*by).orderBy(walk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, bucket, *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{t}_off") for t in tmp.values()]
    )
    keys = [F.col(o).desc() if reverse else F.col(o).asc() for o in order]
    local = Window.partitionBy(*by, bucket).orderBy(*keys)
    if ties == "rows":
        local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        local = local.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, [*by, bucket])
    running = {n: F.sum(as_col(c)).over(local) + F.col(f"{tmp[n]}_off") for n, c in sums.items()}
    return joined.withColumns(running).drop(*[f"{t}_off" for t in tmp.values()])


def with_row_index(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "_idx", n_buckets: int | None = None
) -> DataFrame:
    """Dense 0-based position along ``order`` (whose last column must make it unique) within ``by``."""
    bucketed = range_buckets(df, order[0], n_buckets, then=order[1] if len(order) > 1 else None)
    placed = prefix_sums(bucketed, order, {out: F.lit(1)}, by)
    return placed.withColumn(out, (F.col(out) - 1).cast("bigint")).drop(BUCKET)


def with_halo(
    df: DataFrame, idx: str = "_idx", before: int = 0, after: int = 0, chunk_rows: int = 1 << 20
) -> DataFrame:
    """Chunks of ``chunk_rows`` index positions plus edge copies; drop rows with ``_halo`` afterwards.

    ``before`` rows of the previous chunk and ``after`` rows of the next are visible to a window
    over ``partitionBy(*by, '_chunk').orderBy(idx)``.
    """
    if max(before, after) > chunk_rows:
        raise ValueError("chunk_rows must be at least the frame size")
    home = F.floor(F.col(idx) / chunk_rows)
    offset = F.col(idx) % chunk_rows
    own = F.struct(home.alias("chunk"), F.lit(False).alias("halo"))
    later = F.when(offset >= chunk_rows - before, F.struct((home + 1).alias("chunk"), F.lit(True).alias("halo")))
    sooner = F.when(
        (offset < after) & (home > 0), F.struct((home - 1).alias("chunk"), F.lit(True).alias("halo"))
    )
    spread = df.withColumn("_place", F.explode(F.array_compact(F.array(own, later, sooner))))
    return spread.withColumns({"_chunk": F.col("_place.chunk"), "_halo": F.col("_place.halo")}).drop("_place")


def lagged(
    df: DataFrame,
    columns: Mapping[str, tuple[str, int]],
    idx: str = "_idx",
    by: Sequence[str] = (),
    chunk_rows: int = 1 << 20,
) -> DataFrame:
    """Add lag columns ``{out: (column, distance)}`` over a dense index without a global window."""
    reach = max(d for _, d in columns.values())
    placed = with_halo(df, idx, before=reach, chunk_rows=max(chunk_rows, reach))
    frame = Window.partitionBy(*by, "_chunk").orderBy(idx)
    with_lags = placed.withColumns({out: F.lag(c, d).over(frame) for out, (c, d) in columns.items()})
    return with_lags.filter(~F.col("_halo")).drop("_chunk", "_halo")


def previous(
    df: DataFrame, columns: Mapping[str, str], order: Sequence[str], by: Sequence[str] = (), n_buckets: int | None = None
) -> DataFrame:
    """Add ``{out: column of the preceding row}`` along ``order`` within ``by``; NULL on the first row.

    The lag runs inside (by, bucket); the first row of a bucket takes the last row of the key's
    previous bucket from an edge table of one row per (key, bucket). A key that holds most of the
    table is thereby spread over the buckets.
    """
    by = list(by)
    rows = range_buckets(df, order[0], n_buckets, then=order[1] if len(order) > 1 else None)
    value = F.struct(*[F.col(c).alias(o) for o, c in columns.items()])
    edge = rows.groupBy(*by, BUCKET).agg(F.max_by(value, F.struct(*order)).alias("_edge"))
    edge = edge.withColumn("_edge", F.lag("_edge").over(Window.partitionBy(*by).orderBy(BUCKET)))
    local = Window.partitionBy(*by, BUCKET).orderBy(*order)
    joined = rows.join(edge, [*by, BUCKET])
    joined = joined.withColumn("_preceding", F.coalesce(F.lag(value).over(local), F.col("_edge")))
    return joined.withColumns({o: F.col(f"_preceding.{o}") for o in columns}).drop("_preceding", "_edge", BUCKET)


def mid_ranks(df: DataFrame, value: str, group: str, n_buckets: int | None = None) -> DataFrame:
    """One row per (value, group): its count, the mid-rank of the value and the size of its tie.

    The table is collapsed to counts per value before anything is ordered.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value, group).agg(F.count("*").alias("cnt"))
    cells = collapsed_buckets(counts, value, n_buckets)
    # the join on (bucket) and this frame share the bucket partitioning
    cum = prefix_sums(cells, [value], {"_upto": F.col("cnt")}, ties="range")
    tie = F.sum("cnt").over(Window.partitionBy(BUCKET, value))
    return (
        cum.withColumn("tie", tie)
        .withColumn("mid_rank", F.col("_upto") - F.col("tie") + (F.col("tie") + 1) / 2.0)
        .drop("_upto", BUCKET)
    )
