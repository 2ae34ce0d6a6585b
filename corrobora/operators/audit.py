"""Evidence tables for the ways a plausible analysis goes wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType

from ..functions.scalars import any_of


# ---- joins --------------------------------------------------------------------------------

def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key has no dimension row (a NULL key is an orphan too)."""
    return fact.join(dim.select(key), key, "left_anti")


def join_loss_audit(fact: DataFrame, dim: DataFrame, key: str, measure: str) -> DataFrame:
    """What an inner join would lose against the left join: rows, keys and the measure.

    The dimension is reduced to its distinct keys, so duplicates there cannot inflate the totals;
    the fact table is summed per key before the join, so a hot key (or a third of the rows without
    one) crosses the network as a single row per task.
    """
    keys = dim.select(key).distinct().withColumn("_hit", F.lit(True))
    per_key = fact.groupBy(key).agg(F.count("*").alias("_n"), F.sum(measure).alias("_m"))
    tagged = per_key.join(keys, key, "left")
    hit = F.col("_hit").isNotNull()
    part = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return tagged.agg(
        F.sum("_n").alias("rows_left"), part("_n", hit).alias("rows_inner"), part("_n", ~hit).alias("rows_lost"),
        F.sum("_m").alias("measure_left"), part("_m", hit).alias("measure_inner"),
    ).withColumns(
        {
            "measure_lost": F.col("measure_left") - F.col("measure_inner"),
            "share_lost": 1 - F.col("measure_inner") / F.col("measure_left"),
        }
    )


def left_report(
    fact: DataFrame, period: Column, measure: Column, domain: Sequence, threshold: float = 0.9, orphan: Column | None = None,
    rows: Column | None = None,
) -> DataFrame:
    """(period, total, orphan_rows, share_of_mean, underperforming) over a fixed list of periods.

    Periods without rows count as 0, and the mean is over the whole list. ``rows`` has the number of rows that a row of an already
    summed table stands for.
    """
    orphan = F.lit(False) if orphan is None else orphan
    weight = F.when(orphan, F.lit(1) if rows is None else rows)
    sums = fact.groupBy(period.alias("period")).agg(F.sum(measure).alias("total"), F.coalesce(F.sum(weight), F.lit(0)).alias("orphan_rows"))
    listed = fact.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in domain])).alias("period"))
    frame = listed.join(sums, "period", "left")
    frame = frame.fillna({"total": 0.0, "orphan_rows": 0})
    mean = F.avg("total").over(Window.partitionBy())  # one row per listed period
    return frame.withColumn("share_of_mean", F.col("total") / mean).withColumn(
        "underperforming", F.col("share_of_mean") < threshold
    )


# ---- paradoxes and contradictions ---------------------------------------------------------

def simpson_check(df: DataFrame, stratum: str, arm: Column | str, outcome: Column | str, a, b) -> DataFrame:
    """Rates of both arms overall and per stratum from one grouping-set pass, and the verdict.

    ``reversal`` holds when every stratum orders the arms one way and the total the other way.
    """
    g = F.col(arm) if isinstance(arm, str) else arm
    o = (F.col(outcome) if isinstance(outcome, str) else outcome).cast("double")
    rows = df.select(F.col(stratum).alias("stratum"), F.when(g == F.lit(a), o).alias("_a"), F.when(g == F.lit(b), o).alias("_b"))
    table = rows.rollup("stratum").agg(
        F.grouping("stratum").alias("_total"), F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
        F.avg("_a").alias("rate_a"), F.avg("_b").alias("rate_b"),
    )
    table = table.withColumn("gap", F.col("rate_a") - F.col("rate_b"))
    total, part = F.col("_total") == 1, F.col("_total") == 0
    verdict = table.agg(
        F.struct(
            F.bool_and(F.when(part, F.col("gap") > 0)).alias("up"),
            F.bool_and(F.when(part, F.col("gap") < 0)).alias("down"),
            F.max(F.when(total, F.col("gap"))).alias("overall"),
        )
    ).scalar()
    out = table.withColumn("_v", verdict).withColumn(
        "reversal", (F.col("_v.up") & (F.col("_v.overall") < 0)) | (F.col("_v.down") & (F.col("_v.overall") > 0))
    )
    scope = F.when(total, F.lit("(all)")).otherwise(F.col("stratum"))
    return out.select(scope.alias("stratum"), "n_a", "n_b", "rate_a", "rate_b", "gap", "reversal")


def rates_pivot(df: DataFrame, stratum: str, arm: str, outcome: str, arms: Sequence) -> DataFrame:
    """Stratum by arm table of rates."""
    return df.groupBy(stratum).pivot(arm, list(arms)).agg(F.avg(outcome))


def source_contradiction(
    left: DataFrame, right: DataFrame, period: str, left_value: str, right_value: str
) -> DataFrame:
    """Two sources side by side per period with growth, gap and whether their trends disagree.

    Both sides are aggregated before they meet, so the join is one row per period.
    """
    a = left.groupBy(period).agg(F.sum(left_value).alias("left_total"))
    b = right.groupBy(period).agg(F.sum(right_value).alias("right_total"))
    both = a.join(b, period, "full")
    w = Window.orderBy(period)  # one row per period
    grow = lambda c: F.col(c) / F.lag(c).over(w) - 1
    out = both.withColumns(
        {"left_growth": grow("left_total"), "right_growth": grow("right_total"), "gap": F.col("left_total") - F.col("right_total")}
    )
    return out.withColumns(
        {
            "gap_growth": F.col("gap") / F.lag("gap").over(w) - 1,
            "contradiction": F.coalesce(F.signum("left_growth") * F.signum("right_growth") < 0, F.lit(False)),
        }
    )


# ---- leakage, drift, balance --------------------------------------------------------------

def leak_columns(df: DataFrame, target: str, columns: Sequence[str], populated: float = 0.01) -> DataFrame:
    """Per column: null rate by class; ``leaky`` when one class never has a value but the other does."""
    per = {}
    for c in columns:
        for k in (0, 1):
            per[c, k] = F.avg(F.when(F.col(target) == k, F.col(c).isNull().cast("double")))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), per[c, 0].alias("null_rate_0"), per[c, 1].alias("null_rate_1")) for c in columns]).alias("r"))
    flat = row.select(F.explode("r").alias("r")).select("r.*")
    a, b = F.col("null_rate_0"), F.col("null_rate_1")
    return flat.withColumn("leaky", F.coalesce(((a == 1) & (b < 1 - populated)) | ((b == 1) & (a < 1 - populated)), F.lit(False)))


def missing_driver(df: DataFrame, column: str, features: Sequence[str]) -> DataFrame:
    """(feature, corr, driver): correlation of missingness with each feature; the largest is the driver."""
    miss = F.col(column).isNull().cast("double")
    row = df.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.corr(miss, F.col(f).cast("double")).alias("corr")) for f in features]).alias("r"))
    flat = row.select(F.explode("r").alias("r")).select("r.*")
    # one row per feature
    rank = F.row_number().over(Window.orderBy(F.abs("corr").desc_nulls_last(), "feature"))
    return flat.withColumn("driver", rank == 1)


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("missing_rate")) for c in columns]).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*")


def cohort_profile(df: DataFrame, cohort: Column, label: str = "cohort") -> DataFrame:
    """Rows per cohort, and the slope of the count over cohorts: survivors thin out towards the past."""
    counts = df.groupBy(cohort.alias(label)).agg(F.count("*").alias("n"))
    slope = counts.agg(F.regr_slope(F.col("n"), F.col(label))).scalar()
    return counts.withColumns({"slope": slope, "share": F.col("n") / counts.agg(F.sum("n")).scalar()})


def drift(df: DataFrame, target: str, position: Column, parts: int = 5) -> DataFrame:
    """(part, n, rate, shift): target rate in equal slices of a 0..1 position; shift is last minus first."""
    return drift_of_parts(df, target, F.least(F.floor(position * parts), F.lit(parts - 1)).cast("int"))


def drift_of_parts(df: DataFrame, target: str, part: Column) -> DataFrame:
    """(part, n, rate, shift) for parts that are numbered already, such as those of ``sampling.equal_parts``."""
    table = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
    ends = table.agg(F.max_by("rate", "part") - F.min_by("rate", "part")).scalar()
    return table.withColumn("shift", ends)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(class, n, share, majority_accuracy): what a constant prediction would score."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("all"), F.max("n").alias("top"))).scalar()
    return counts.withColumn("_t", total).select(
        "class", "n", (F.col("n") / F.col("_t.all")).alias("share"), (F.col("_t.top") / F.col("_t.all")).alias("majority_accuracy")
    )


def zscores(df: DataFrame, columns: Sequence[str], ddof: int = 0, prefix: str = "z_") -> DataFrame:
    """Distance from the column mean in standard deviations; the statistics are one scalar row."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[sd(c).alias(f"s_{c}") for c in columns])).scalar()
    rows = df.withColumn("_z", stats)
    return rows.withColumns({f"{prefix}{c}": (F.col(c) - F.col(f"_z.m_{c}")) / F.col(f"_z.s_{c}") for c in columns}).drop("_z")


def flag_outliers(df: DataFrame, columns: Sequence[str], limit: float = 3.0, out: str = "outlier") -> DataFrame:
    """True when any column lies beyond ``limit`` population standard deviations."""
    z = zscores(df, columns)
    return z.withColumn(out, any_of(F.abs(f"z_{c}") > limit for c in columns)).drop(*[f"z_{c}" for c in columns])


def outliers_by_class(df: DataFrame, columns: Sequence[str], target: str, limit: float = 3.0) -> DataFrame:
    """(class, n, outliers, outlier_rate, ratio): who would be removed by an outlier rule."""
    flagged = flag_outliers(df, columns, limit)
    table = flagged.groupBy(F.col(target).alias("class")).agg(
        F.count("*").alias("n"), F.count_if("outlier").alias("outliers"), F.avg(F.col("outlier").cast("double")).alias("outlier_rate")
    )
    overall = table.agg(F.sum("outliers") / F.sum("n")).scalar()
    return table.withColumn("ratio", F.col("outlier_rate") / F.nullif(overall, F.lit(0.0)))


def drop_outliers_of_class(df: DataFrame, columns: Sequence[str], target: str, removable, limit: float = 3.0) -> DataFrame:
    """Remove outliers only in the class where they are errors; extreme rows of the other class stay."""
    return flag_outliers(df, columns, limit).filter(~((F.col(target) == F.lit(removable)) & F.col("outlier"))).drop("outlier")


def integer_categoricals(df: DataFrame, columns: Sequence[str] | None = None, max_levels: int = 50) -> DataFrame:
    """(column, distinct_values, categorical): integer columns with few distinct values are codes.

    Column types come from the schema. The sketch is exact for the few levels that matter and
    stays small for a key column, which an exact distinct count would have to shuffle.
    """
    whole = (IntegerType, LongType, ShortType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, whole) and (columns is None or f.name in columns)]
    row = df.agg(
        F.array(*[F.struct(F.lit(c).alias("column"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("bigint"), F.lit(12))).alias("distinct_values")) for c in names]).alias("r")
    )
    return row.select(F.explode("r").alias("r")).select("r.*").withColumn("categorical", F.col("distinct_values") <= max_levels)


def rare_categories(df: DataFrame, column: str, limits: Sequence[int] = (5, 10)) -> DataFrame:
    """How many categories, and rows in them, fall below each size limit."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    row = counts.agg(
        F.count("*").alias("_k"), F.sum("n").alias("_rows"),
        *[F.count_if(F.col("n") < k).alias(f"k{k}") for k in limits],
        *[F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias(f"r{k}") for k in limits],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("below"), F.col(f"k{k}").alias("categories"), F.col(f"r{k}").alias("rows")) for k in limits])
    return row.select(F.col("_k").alias("all_categories"), F.col("_rows").alias("all_rows"), F.explode(rows).alias("r")).select(
        "r.*", "all_categories", "all_rows"
    )


def range_check(df: DataFrame, columns: Sequence[str], is_train: Column) -> DataFrame:
    """(column, train and test ranges, out_of_range): test rows outside what training saw."""
    aggs = []
    for c in columns:
        tr, te = F.when(is_train, F.col(c)), F.when(~is_train, F.col(c))
        aggs += [F.min(tr).alias(f"a_{c}"), F.max(tr).alias(f"b_{c}"), F.min(te).alias(f"c_{c}"), F.max(te).alias(f"d_{c}")]
    stats = df.agg(*aggs)
    bounds = stats.select(F.struct("*")).scalar()
    rows = df.filter(~is_train).withColumn("_b", bounds)
    outside = rows.agg(
        F.count("*").alias("_n"),
        *[F.count_if((F.col(c) < F.col(f"_b.a_{c}")) | (F.col(c) > F.col(f"_b.b_{c}"))).alias(f"o_{c}") for c in columns],
    )
    one = outside.withColumn("_s", bounds)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"_s.a_{c}").cast("double").alias("train_min"), F.col(f"_s.b_{c}").cast("double").alias("train_max"),
                F.col(f"_s.c_{c}").cast("double").alias("test_min"), F.col(f"_s.d_{c}").cast("double").alias("test_max"),
                F.col(f"o_{c}").alias("out_of_range"), F.col("_n").alias("test_rows"),
            )
            for c in columns
        ]
    )
    return one.select(F.explode(cells).alias("r")).select("r.*")


def longitudinal_check(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Are repeated keys duplicates or visits? Visits carry distinct sequence values."""
    pairs = df.groupBy(key, sequence).agg(F.count("*").alias("n"))
    per = pairs.groupBy(key).agg(F.sum("n").alias("rows"), F.count("*").alias("steps"))
    return per.agg(
        F.count("*").alias("keys"), F.sum("rows").alias("rows"), F.count_if(F.col("rows") > 1).alias("repeated_keys"),
        F.sum(F.col("rows") - F.col("steps")).alias("true_duplicates"),
    ).withColumn("longitudinal", (F.col("repeated_keys") > 0) & (F.col("true_duplicates") < F.col("rows") - F.col("keys")))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column profile in one pass: rows, missing rate, distinct (sketch), mean, deviations, range."""
    stats = []
    for c in columns:
        v = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("rows"), F.avg(F.col(c).isNull().cast("double")).alias("missing_rate"),
                F.approx_count_distinct(c).alias("distinct_sketch"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_sample"),
                F.stddev_pop(v).alias("std_population"), F.min(v).alias("min"), F.max(v).alias("max"),
            )
        )
    return df.agg(F.array(*stats).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, type, rows, missing, distinct_values, top_value, top_rows) for numbers, texts and dates alike; all counts exact.

    One pass over the table with its columns as rows, counted by value within the tasks first, so a value that most rows
    hold costs a row per task; what is left is a row per value. ``top_value`` is the commonest value as text, of equals the
    first. An empty table gives every column with zero rows.
    """
    types = dict(df.dtypes)
    names = df.sparkSession.createDataFrame([(c, types[c]) for c in columns], "column string, type string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))
    here = F.col("value").isNotNull()
    top = F.min(F.when(here, F.struct((-F.col("n")).alias("less"), "value")))
    found = values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"), top.alias("top"),
    )
    out = names.join(found, "column", "left").na.fill(0, ["rows", "missing", "distinct_values"])
    return out.select(
        "column", "type", "rows", "missing", "distinct_values", F.col("top.value").alias("top_value"),
        (-F.col("top.less")).alias("top_rows"),
    )


def integer_levels(df: DataFrame, columns: Sequence[str] | None = None, max_levels: int = 50) -> DataFrame:
    """(column, levels, categorical): the number of distinct values of integer columns that are codes, null of all others.

    A theta sketch of at least twice ``max_levels`` entries keeps every hash until it is full, so its count is exact there,
    and its size does not grow with a key column.
    """
    whole = (IntegerType, LongType, ShortType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, whole) and (columns is None or f.name in columns)]
    entries = max(12, (2 * max_levels).bit_length())
    count = lambda c: F.theta_sketch_estimate(F.theta_sketch_agg(F.col(c).cast("bigint"), entries))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), count(c).alias("found")) for c in names]).alias("r"))
    flat = row.select(F.explode("r").alias("r")).select("r.*").withColumn("categorical", F.col("found") <= max_levels)
    return flat.select("column", F.when(F.col("categorical"), F.col("found")).alias("levels"), "categorical")
