"""Exact order statistics by radix selection instead of sorting.

``percentile``/``median`` in Spark keep all values of a group in one task. Here a value is a sortable 64-bit number, and a
round of counting fixes 16 of its bits: the rows that share the bits found so far are counted by the next 16, which leaves at
most 65536 counts per group and wanted rank to order, whatever the values are. Four rounds fix any number; most tables need
two or three, as the rounds end when every cell that holds a wanted rank holds one value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

_DIGIT = 16


def sortable_bits(v: Column) -> Column:
    """A double as a bigint of the same order: its IEEE bits, negated below zero; NaN is above all, null stays null.

    Built from exponent and mantissa, which division by a power of two gives exactly.
    """
    size = F.abs(v)
    finite = F.when((size > 0) & (size < float("inf")), size)
    guess = F.floor(F.log2(finite))
    high = F.when(finite >= F.pow(F.lit(2.0), guess + 1), guess + 1).when(finite < F.pow(F.lit(2.0), guess), guess - 1).otherwise(guess)
    power = F.greatest(high, F.lit(-1022).cast("bigint"))
    mantissa = F.floor((finite / F.pow(F.lit(2.0), power) - 1.0) * float(1 << 52))
    bits = (power + 1023) * F.lit(1 << 52) + mantissa
    whole = F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(2047 << 52))
    return F.when(v < 0, -F.coalesce(whole, bits)).otherwise(F.coalesce(whole, bits))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), n_buckets: int | None = None, times: str | None = None
) -> DataFrame:
    """Linear-interpolation quantiles: (by..., prob, quantile, n). Null is a group like any other; null values are no rows.

    ``n_buckets`` is taken for the sake of callers that hand one number to several operators; counting needs no buckets.

    A round reads the value and the keys, joins them to the cells that hold a wanted rank (a written table of a row per key
    and cell, so Spark broadcasts it while it is small) and sends counts. NaN counts as the largest value. In a table that is
    already counted, ``times`` says how often a row's value occurs (whole numbers from 1).
    """
    by = list(by)
    # keys as one struct: structs with null fields are equal to each other in joins and groupings
    key = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_all")).alias("_key")
    often = F.lit(1) if times is None else F.col(times).cast("bigint")
    rows = df.select(key, F.col(value).cast("double").alias("_v"), often.alias("_times")).filter(F.col("_v").isNotNull())
    rows = rows.withColumn("_bits", sortable_bits(F.col("_v")))
    cells = [(F.count("*") if times is None else F.sum("_times")).alias("_cnt"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    counts = staged(rows.groupBy("_key", F.shiftright("_bits", 64 - _DIGIT).alias("_cell")).agg(*cells))
    sizes = counts.groupBy("_key").agg(F.sum("_cnt").alias("n"))
    # wanted 0-based positions: floor and ceiling of prob * (n - 1)
    wanted = sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumn("_pos", F.col("prob") * (F.col("n") - 1))
    wanted = wanted.withColumn("_local", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    share = F.when(F.floor("_pos") == F.ceil("_pos"), F.lit(1.0)).otherwise(
        F.when(F.col("_local") == F.floor("_pos"), F.ceil("_pos") - F.col("_pos")).otherwise(F.col("_pos") - F.floor("_pos"))
    )
    wanted = wanted.select("_key", F.struct("prob", "n", share.alias("share"), F.col("_local").alias("local")).alias("_t"))
    hits = staged(_hits(counts, wanted, ["_key"]))

    for place in range(64 - 2 * _DIGIT, -1, -_DIGIT):
        if hits.filter("_lo < _hi").isEmpty():
            break
        inside = rows.withColumn("_part", F.shiftright("_bits", place + _DIGIT)).join(
            hits.select("_key", F.col("_cell").alias("_part")), ["_key", "_part"]
        )
        counts = inside.groupBy("_key", "_part", F.shiftright("_bits", place).alias("_cell")).agg(*cells)
        wanted = hits.select("_key", F.col("_cell").alias("_part"), F.explode("_targets").alias("_t"))
        hits = staged(_hits(counts, wanted, ["_key", "_part"]))

    found = hits.select("_key", F.col("_lo").alias("_v"), F.explode("_targets").alias("_t")).select("_key", "_v", "_t.*")
    # between two equal values lies that value and not a rounded sum of its shares
    between = F.when(F.min("_v") == F.max("_v"), F.max("_v")).otherwise(F.sum(F.col("_v") * F.col("share")))
    out = found.groupBy("_key", "prob").agg(between.alias("quantile"), F.max("n").alias("n"))
    return out.select(*[F.col(f"_key.{c}").alias(c) for c in by], "prob", "quantile", "n")


def _hits(counts: DataFrame, wanted: DataFrame, inside: list[str]) -> DataFrame:
    """One row per cell that holds a wanted rank, with those ranks counted from the cell's start.

    At most 65536 cells of one key and part meet in the window.
    """
    walk = Window.partitionBy(*inside).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.withColumn("_start", F.sum("_cnt").over(walk) - F.col("_cnt"))
    place = F.col("_t.local")
    met = spans.join(wanted, inside).filter((place >= F.col("_start")) & (place < F.col("_start") + F.col("_cnt")))
    target = F.col("_t").withField("local", place - F.col("_start"))
    return met.groupBy("_key", "_cell", "_lo", "_hi").agg(F.collect_list(target).alias("_targets"))


def exact_median(
    df: DataFrame, value: str, by: Sequence[str] = (), n_buckets: int | None = None, times: str | None = None
) -> DataFrame:
    """(by..., median, n)."""
    out = exact_quantiles(df, value, [0.5], by, n_buckets, times)
    return out.select(*by, F.col("quantile").alias("median"), "n")


_TEXT = 6  # bytes of a text that one number holds


def _numbers(df: DataFrame, column: str) -> Iterator[Column]:
    """The column as sortable bigints, the leading one first; nulls lie before all others (and with the smallest bigint).

    A text gives a number for every six bytes: the bytes and how many there are.
    """
    kind, c = dict(df.dtypes)[column], F.col(column)
    first = F.lit(-(1 << 63)).cast("bigint")
    if kind == "string":
        at = 1
        while True:
            piece = F.substring(F.encode(c, "UTF-8"), at, _TEXT)
            code = F.conv(F.rpad(F.hex(piece), 2 * _TEXT, "0"), 16, 10).cast("bigint")
            yield F.coalesce(code * 8 + F.octet_length(piece), first)
            at += _TEXT
    if kind in ("timestamp", "timestamp_ntz"):
        number = F.unix_micros(c.cast("timestamp"))
    elif kind == "date":
        number = F.unix_date(c).cast("bigint")
    elif kind in ("float", "double"):
        number = sortable_bits(c.cast("double"))
    elif kind.startswith("decimal"):
        digits, scale = (int(x) for x in kind[8:-1].split(","))
        if digits > 18:
            raise TypeError(f"{column}: decimals of up to 18 digits")
        number = (c * F.lit(10**scale)).cast("bigint")
    elif kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        number = c.cast("bigint")
    else:
        raise TypeError(f"{column}: order by numbers, dates, timestamps or texts")
    yield F.coalesce(number, first)


@dataclass
class _Range:
    """Rows equal to what is found so far, whose next number lies in low..high; positions by their place among them."""

    found: tuple[int, ...]
    low: int
    high: int
    rows: int
    places: dict[int, int] = field(default_factory=dict)


def _narrow(df: DataFrame, numbers: list[Column], ranges: list[_Range]) -> list[_Range]:
    """One round of counting: each range in at most 2^16 cells, and of these the ones that hold a wanted place."""
    tag, cell = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    last = numbers[-1]
    for i, r in enumerate(ranges):
        shift = 0
        while (r.high >> shift) - (r.low >> shift) >= 1 << _DIGIT:
            shift += 1
        mine = (last >= r.low) & (last <= r.high)
        for number, value in zip(numbers, r.found):
            mine = mine & (number == value)
        tag = F.when(mine, F.lit(i)).otherwise(tag)
        cell = F.when(mine, F.shiftright(last, shift)).otherwise(cell)
    tagged = df.select(tag.alias("r"), cell.alias("cell"), last.alias("x")).filter("r IS NOT NULL")
    counts = tagged.groupBy("r", "cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    spans = counts.withColumn("start", upto - F.col("n"))
    held = F.lit(False)
    for i, r in enumerate(ranges):
        for place in r.places.values():
            held = held | ((F.col("r") == i) & (F.col("start") <= place) & (F.col("start") + F.col("n") > place))
    out = []
    for hit in spans.filter(held).collect():  # at most one row per wanted position
        r = ranges[hit["r"]]
        inside = {p: k - hit["start"] for p, k in r.places.items() if hit["start"] <= k < hit["start"] + hit["n"]}
        out.append(_Range(r.found, hit["low"], hit["high"], hit["n"], inside))
    return out


def rows_at(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> tuple[list[Column], dict[int, tuple[int, ...]]]:
    """The rows at 0-based positions along ``order``, found by counting: no sort, no index and no window over rows.

    Returns the order as bigint columns and, per position below the number of rows, the leading numbers of its row, as
    many as tell it from all others (all of them if rows tie in the whole order). ``order`` may hold numbers, dates,
    timestamps and texts; nulls come first. Column after column is fixed, each in at most four rounds; every round reads
    only the order columns and returns a row per position.
    """
    numbers: list[Column] = []
    size = df.count()
    open_, found = [_Range((), 0, 0, size, {p: p for p in positions if 0 <= p < size})], {}
    for column in order:
        for piece in _numbers(df, column):
            open_ = [r for r in open_ if r.places]
            if not open_:
                break
            numbers.append(piece)
            todo = [_Range(r.found, -(1 << 63), (1 << 63) - 1, r.rows, r.places) for r in open_]
            open_ = []
            while todo:
                narrowed = _narrow(df, numbers, todo)
                todo = [r for r in narrowed if r.low < r.high]
                open_ += [_Range((*r.found, r.low), 0, 0, r.rows, r.places) for r in narrowed if r.low == r.high]
            for r in [r for r in open_ if r.rows == 1]:
                found |= dict.fromkeys(r.places, r.found)
            open_ = [r for r in open_ if r.rows > 1]
            # a text ends where a piece is not full
            if dict(df.dtypes)[column] == "string" and all(r.found[-1] % 8 < _TEXT for r in open_):
                break
    for r in open_:
        found |= dict.fromkeys(r.places, r.found)
    return numbers, found


def before_row(numbers: Sequence[Column], row: Sequence[int]) -> Column:
    """Whether a row comes before the one that ``rows_at`` found."""
    out = F.lit(False)
    for number, value in reversed(list(zip(numbers, row))):
        out = (number < value) | ((number == value) & out)
    return out
