"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies, its source's target over its source's size. The
whole part is taken for certain. For the rest, documents are ranked by their random odds divided
by their inclusion odds, and the ranking is cut where the words taken come nearest to the target:
a sample of fixed size in words, with unequal inclusion probabilities.

No source is ever ordered in one task. The cut is found by counting words per bucket of the rank,
twice, and only the rows of the last bucket are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import n_words, stage, text_of, unit

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BUCKETS = 1024


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add target to a table (source, source_size) of one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and divide ``share`` of all
    sizes; none gets more than ``cap`` times its size, and what is over goes to the others by weight.
    The level at which this settles is found by going through the sources in the order in which
    they fill up. Both windows run over one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    known = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    fills = every.orderBy(F.col("ceiling") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("ceiling").over(fills), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fills), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - full) / open_weight
    # the first source that the level does not fill fixes the level for all after it
    turn = F.row_number().over(every.orderBy(F.col("ceiling") / F.col("weight"), F.asc_nulls_last("source")))
    stepped = known.withColumns({"level": level, "turn": turn})
    holds = F.col("level") * F.col("weight") <= F.col("ceiling")
    settled = F.min_by("level", F.when(holds, F.col("turn"))).over(every)
    target = F.least(F.col("ceiling"), F.coalesce(settled * F.col("weight"), F.col("ceiling")))
    return stepped.withColumn("target", target).drop("weight", "ceiling", "level", "turn")


def _rank(expected: Column, copy: int, u: Column) -> Column:
    """Place in (0, 1) of a copy whose inclusion is undecided: the Pareto quotient, then copies not expected at all."""
    p = F.least(F.greatest(expected - copy, F.lit(0.0)), F.lit(1.0))
    quotient = u / (1 - u) * (1 - p) / p
    return F.when(p <= 0, (1 + u) / 2).otherwise(quotient / (1 + quotient) / 2)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: int = 2,
    affinity: Column | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken (words).

    ``affinity`` scales a document's expected copies (default: all alike). Random numbers are
    functions of the id and the text, so a rerun takes the same rows. Rows equal in id, source and text are handled as
    one row with a count, however many they are, and then take 0 to ``cap`` copies each. Null source is a
    source of its own, null text has size 0; a document of size 0 is taken 0 times. Other columns are
    ignored. An empty table gives no rows.
    """
    text = text_of()
    wanted = F.lit(1.0) if affinity is None else affinity.cast("double")
    narrow = docs.select(F.col(key).alias("doc_id"), "source", n_words(text).alias("size"), F.md5(text).alias("print"), wanted.alias("affinity"))
    rows = stage(narrow.groupBy("doc_id", "source", "size", "print", "affinity").agg(F.count("*").alias("rows")), "mix-rows")
    totals = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).cast("bigint").alias("source_size"),
        F.sum(F.col("size") * F.col("rows") * F.col("affinity")).alias("wanted"),
    )
    aims = stage(targets(totals, weights, share, float(cap)), "mix-targets")
    same_source = F.col("source").eqNullSafe(F.col("aim_source"))
    aim = aims.withColumnRenamed("source", "aim_source")
    expected = F.when(F.col("wanted") > 0, F.least(F.col("target") * F.col("affinity") / F.col("wanted"), F.lit(float(cap)))).otherwise(0.0)
    with_aim = rows.join(aim, same_source).withColumn("expected", expected)
    u = unit(F.col("doc_id"), F.col("print"))
    certain = F.floor(F.col("expected") + 1e-9).cast("bigint")
    copies = F.array(*[F.when(F.lit(c) >= certain, F.struct(F.lit(c).alias("copy"), _rank(F.col("expected"), c, u).alias("rank"))) for c in range(cap)])
    base = with_aim.withColumn("certain", certain)
    units = stage(
        base.filter("size > 0").select("doc_id", "source", "print", "size", "rows", F.explode(F.array_compact(copies)).alias("u"))
        .select("doc_id", "source", "print", "size", "rows", "u.copy", "u.rank"), "mix-units",
    )
    sure = base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows") * F.col("certain")).alias("sure"))
    left = aim.join(sure, F.col("source").eqNullSafe(F.col("aim_source")), "left").select(
        "aim_source", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("left")
    )
    chosen = stage(_cut(units, left), "mix-chosen")
    extra = chosen.groupBy("doc_id", "source", "print").agg(F.collect_list("taken_rows").alias("extra"))
    joined = base.join(
        extra.select(F.col("doc_id").alias("x_id"), F.col("source").alias("x_source"), F.col("print").alias("x_print"), "extra"),
        F.col("doc_id").eqNullSafe(F.col("x_id")) & F.col("source").eqNullSafe(F.col("x_source")) & (F.col("print") == F.col("x_print")), "left",
    )
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("place")
    more = F.expr("aggregate(coalesce(extra, CAST(array() AS array<bigint>)), 0L, (a, n) -> a + IF(place < n, 1L, 0L))")
    out = joined.select("*", each).withColumn("copies", F.col("certain") + more)
    return out.select(
        "doc_id", "source", "size", F.col("source_size"), "target", "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "print",
    )


def _cut(units: DataFrame, left: DataFrame) -> DataFrame:
    """doc_id, source, print, copy, taken_rows of the copies above the cut.

    ``left`` has the words that each source still lacks. A copy that crosses the line is taken if that
    comes nearer to it than leaving it.
    """
    rows, want = units, left
    taken = []
    for level in (1, 2):
        fine = BUCKETS**level
        rows = rows.withColumn("bucket", F.floor(F.col("rank") * fine))
        found = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
        # at most BUCKETS rows per source meet in this window
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        at = found.withColumn("upto", upto).join(want, F.col("source").eqNullSafe(F.col("aim_source")))
        line = at.groupBy("aim_source", "left").agg(
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("bucket"))).alias("whole"),
            F.min(F.when(F.col("upto") > F.col("left"), F.col("bucket"))).alias("split"),
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("sum"),
        )
        line = stage(line, f"mix-line-{level}")
        met = rows.drop("aim_source", "left").join(line, F.col("source").eqNullSafe(F.col("aim_source")))
        taken.append(met.filter(F.col("bucket") <= F.col("whole")).select("doc_id", "source", "print", "copy", F.col("rows").alias("taken_rows")))
        rows = met.filter(F.col("bucket") == F.col("split")).select("doc_id", "source", "print", "size", "rows", "copy", "rank")
        want = line.select("aim_source", (F.col("left") - F.coalesce("sum", F.lit(0))).alias("left"))
    ordered = Window.partitionBy("source").orderBy("rank", "copy", F.asc_nulls_first("doc_id"), "print").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("rows")).over(ordered), F.lit(0))
    last = rows.withColumn("before", before).join(want, F.col("source").eqNullSafe(F.col("aim_source")))
    fits = F.greatest(F.lit(0), F.least(F.col("rows"), F.round((F.col("left") - F.col("before")) / F.col("size")).cast("bigint")))
    taken.append(last.withColumn("taken_rows", fits).filter("taken_rows > 0").select("doc_id", "source", "print", "copy", "taken_rows"))
    return taken[0].unionByName(taken[1]).unionByName(taken[2])
