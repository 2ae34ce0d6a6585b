"""Output checks as data: every check is a row (seq, check, ok, detail).

Row-level checks of one table share a single aggregate pass; only key checks add a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import blank_to_null, contains_any, ordered_pair


class Expectations:
    """Collects checks on one DataFrame and evaluates them together."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._checks: list[tuple[str, Column, Column]] = []  # name, ok, detail; over the aggregate row
        self._aggs: dict[str, Column] = {}
        self._scalars: dict[str, Column] = {}

    def _agg(self, expression: Column) -> Column:
        name = f"_a{len(self._aggs)}"
        self._aggs[name] = expression
        return F.col(name)

    def _scalar(self, one_value: DataFrame) -> Column:
        name = f"_s{len(self._scalars)}"
        self._scalars[name] = one_value.scalar()
        return F.col(name)

    def _add(self, name: str, ok: Column, detail: Column) -> Expectations:
        self._checks.append((name, ok, detail.cast("string")))
        return self

    # ---- shape
    def columns(self, expected: Sequence[str]) -> Expectations:
        """Exact column list and order (known from the schema, no pass over the data)."""
        return self._add("columns", F.lit(self.df.columns == list(expected)), F.lit(",".join(self.df.columns)))

    def row_count(self, expected: Column | DataFrame | int) -> Expectations:
        """Row count equals a number or the single value of another query."""
        n = self._agg(F.count("*"))
        want = self._scalar(expected) if isinstance(expected, DataFrame) else (expected if isinstance(expected, Column) else F.lit(expected))
        return self._add("row_count", n == want, n)

    def unique(self, key: str) -> Expectations:
        dup = self._scalar(
            self.df.groupBy(key).agg((F.count("*") - 1).alias("_d")).agg(F.coalesce(F.sum("_d"), F.lit(0)))
        )
        return self._add(f"unique:{key}", dup == 0, dup)

    # ---- values
    def _none(self, name: str, bad: Column) -> Expectations:
        n = self._agg(F.count_if(bad))
        return self._add(name, n == 0, n)

    def not_null(self, column: str) -> Expectations:
        return self._none(f"not_null:{column}", F.col(column).isNull())

    def positive(self, column: str) -> Expectations:
        """Numeric, present and above zero; text that is no number fails."""
        v = F.col(column).try_cast("double")
        return self._none(f"positive:{column}", v.isNull() | F.isnan(v) | (v <= 0))

    def numeric(self, column: str) -> Expectations:
        """Every non-null value parses as a number."""
        return self._none(f"numeric:{column}", F.col(column).isNotNull() & F.col(column).try_cast("double").isNull())

    def between(self, column: str, low, high) -> Expectations:
        return self._none(f"between:{column}", ~F.coalesce(F.col(column).between(low, high), F.lit(False)))

    def utc_text(self, column: str) -> Expectations:
        """Parseable timestamp text with an explicit zero offset."""
        c = F.col(column)
        good = c.rlike(r"(Z|\+00:00)$") & F.try_to_timestamp(c).isNotNull()
        return self._none(f"utc:{column}", ~F.coalesce(good, F.lit(False)))

    def null_where(self, column: str, condition: Column, label: str) -> Expectations:
        """Column is empty on the rows that meet the condition."""
        return self._none(f"null_where:{column}:{label}", condition & blank_to_null(F.col(column).cast("string")).isNotNull())

    def prefix(self, column: str, prefix: str) -> Expectations:
        return self._none(f"prefix:{column}", ~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))

    def domain(self, column: str, allowed: Sequence) -> Expectations:
        return self._none(f"domain:{column}", ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))

    def not_constant(self, column: str) -> Expectations:
        low, high = self._agg(F.min(column)), self._agg(F.max(column))
        return self._add(f"not_constant:{column}", F.coalesce(low != high, F.lit(False)), low)

    # ---- sets
    def has_keys(self, required: DataFrame, key: str, label: str = "keys") -> Expectations:
        """No required key is missing."""
        missing = self._scalar(
            required.select(key).distinct().join(self.df.select(key), key, "left_anti").agg(F.count("*"))
        )
        return self._add(f"has_{label}:{key}", missing == 0, missing)

    def recall(self, key: str, known: Sequence, at_least: int, flagged_between: tuple[int, int]) -> Expectations:
        """Enough known items found, and neither too few nor too many flagged."""
        hits = self._agg(F.count_if(F.col(key).isin(list(known))))
        n = self._agg(F.count("*"))
        return self._add(f"recall:{key}", (hits >= at_least) & n.between(*flagged_between), F.concat_ws("/", hits, n))

    # ---- aggregates against a truth
    def close(self, name: str, value: Column, truth, tolerance: float) -> Expectations:
        """An aggregate lies within a tolerance of the truth (a number or the single value of a query)."""
        v = self._agg(value.cast("double"))
        want = self._scalar(truth) if isinstance(truth, DataFrame) else F.lit(float(truth))
        return self._add(f"close:{name}", F.coalesce(F.abs(v - want) <= tolerance, F.lit(False)), F.round(v, 6))

    def band(self, name: str, value: Column, low: float, high: float) -> Expectations:
        v = self._agg(value.cast("double"))
        return self._add(f"band:{name}", F.coalesce(v.between(low, high), F.lit(False)), F.round(v, 6))

    def at_most_ratio(self, name: str, value: Column, baseline: DataFrame, ratio: float) -> Expectations:
        """An aggregate is at most ``ratio`` times a recomputed baseline."""
        v = self._agg(value.cast("double"))
        base = self._scalar(baseline)
        return self._add(f"ratio:{name}", F.coalesce(v <= ratio * base, F.lit(False)), F.round(v / base, 6))

    # ---- result
    def report(self) -> DataFrame:
        row = self.df.agg(F.lit(1).alias("_one"), *[e.alias(n) for n, e in self._aggs.items()]).withColumns(self._scalars)
        lines = F.array(
            *[
                F.struct(F.lit(i + 1).alias("seq"), F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
                for i, (name, ok, detail) in enumerate(self._checks)
            ]
        )
        return row.select(F.explode(lines).alias("r")).select("r.*")


def verdict(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(passed, failed, reward, reason): reward 1 only when all pass, reason is the first failure in order."""
    bad = ~F.col("ok")
    return report.groupBy(*by).agg(
        F.count_if("ok").alias("passed"), F.count_if(bad).alias("failed"),
        F.bool_and("ok").cast("int").alias("reward"),
        F.min_by(F.when(bad, F.concat_ws(": ", "check", "detail")), F.when(bad, F.col("seq"))).alias("reason"),
    )


# ---- report documents ----------------------------------------------------------------------

def json_report_checks(
    docs: DataFrame, text: str, required: Sequence[str], numbers: Sequence[str] = (), interval: str | None = None, min_width: float = 0.0
) -> DataFrame:
    """One row per document: missing keys, fields that are no numbers, and a sane [low, high] interval."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), keys)
    field = lambda name: F.get_json_object(text, f"$.{name}")
    wrong = F.array_compact(F.array(*[F.when(field(n).try_cast("double").isNull(), F.lit(n)) for n in numbers]))
    out = docs.withColumns({"missing_keys": missing, "not_numeric": wrong})
    ok = (F.size("missing_keys") == 0) & (F.size("not_numeric") == 0)
    if interval:
        pair = F.from_json(field(interval), "array<double>")
        low, high = F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2))
        out = out.withColumns({"low": low, "high": high, "interval_size": F.coalesce(F.size(pair), F.lit(0))})
        fine = (F.col("interval_size") == 2) & (F.col("low") < F.col("high")) & (F.col("high") - F.col("low") >= min_width)
        out = out.withColumns({"contains_zero": F.coalesce((F.col("low") <= 0) & (F.col("high") >= 0), F.lit(False))})
        ok = ok & F.coalesce(fine, F.lit(False))
    return out.withColumn("ok", ok)


def keyword_check(docs: DataFrame, text: str, accepted: Sequence[str], rejected: Sequence[str] = ()) -> DataFrame:
    """``ok`` when an accepted keyword appears and no rejected one does."""
    return docs.withColumn("ok", contains_any(text, accepted) & ~contains_any(text, rejected))


def direction_check(pairs: DataFrame, text: str, required: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """(missing, forbidden_found, ok) of a table of statements such as 'A>B' or 'B<A'."""
    said = pairs.select(ordered_pair(text).alias("p")).filter("p IS NOT NULL")
    need = F.array(*[F.lit(r) for r in required]).cast("array<string>")
    ban = F.array(*[F.lit(r) for r in forbidden]).cast("array<string>")
    # only the listed pairs can matter, so at most that many are collected
    hit = said.filter(p_in(said, [*required, *forbidden])).agg(F.collect_set("p").alias("s"))
    out = hit.select(F.array_except(need, "s").alias("missing"), F.array_intersect(ban, "s").alias("forbidden_found"))
    return out.withColumn("ok", (F.size("missing") == 0) & (F.size("forbidden_found") == 0))


def p_in(df: DataFrame, values: Sequence[str]) -> Column:
    return df["p"].isin(list(values)) if values else F.lit(False)
