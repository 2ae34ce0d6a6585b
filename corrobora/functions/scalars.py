"""Row expressions: cleaning, parsing, text matching. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def currency(c: Column | str) -> Column:
    """'$1,234.50' -> 1234.5; text that is no number becomes NULL."""
    return F.regexp_replace(as_col(c), r"[$,\s]", "").try_cast("double")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def normal_text(c: Column | str) -> Column:
    return F.upper(F.trim(as_col(c)))


def indicator(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def parse_by_source(text: Column | str, source: Column | str, formats: dict[str, str]) -> Column:
    """Date parsed with the format its own source declares; unknown source or bad text -> NULL."""
    text, source = as_col(text), as_col(source)
    parsed = F.lit(None).cast("date")
    for name, pattern in formats.items():
        parsed = F.when(source == name, F.try_to_timestamp(text, F.lit(pattern)).cast("date")).otherwise(parsed)
    return parsed


def naive_parse(text: Column | str, pattern: str) -> Column:
    """One format for every row, as a tool without the source column would do; misfits -> NULL."""
    return F.try_to_timestamp(as_col(text), F.lit(pattern)).cast("date")


def matched_keywords(text: Column | str, keywords: Sequence[str]) -> Column:
    """Array of the keywords contained in the text, case-insensitive, in list order."""
    low = F.lower(as_col(text))
    return F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(k)) for k in keywords]))


def contains_any(text: Column | str, keywords: Sequence[str]) -> Column:
    low = F.lower(as_col(text))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    return hit


def first_line_with(text: Column | str, needle: str) -> Column:
    """First line that contains the needle, or NULL."""
    lines = F.filter(F.split(as_col(text), "\n"), lambda line: line.contains(needle))
    return F.try_element_at(lines, F.lit(1))


def truncate(text: Column | str, width: int) -> Column:
    """Cut long text for display and mark the cut."""
    text = as_col(text)
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def ordered_pair(text: Column | str) -> Column:
    """'A>B' or 'B<A' -> 'A>B'; anything else NULL."""
    compact = F.regexp_replace(as_col(text), r"\s+", "")
    pattern = r"^([A-Za-z0-9_]+)([<>])([A-Za-z0-9_]+)$"
    left, sign, right = (F.regexp_extract(compact, pattern, i) for i in (1, 2, 3))
    return F.when(sign == ">", F.concat(left, F.lit(">"), right)).when(sign == "<", F.concat(right, F.lit(">"), left))


def pair_key(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array(as_col(a), as_col(b)))


def clip(c: Column | str, low=None, high=None) -> Column:
    c = as_col(c)
    if low is not None:
        c = F.greatest(c, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        c = F.least(c, high if isinstance(high, Column) else F.lit(high))
    return c


def safe_ratio(num: Column, den: Column) -> Column:
    """Division where a zero denominator counts as one."""
    return num / F.when(den == 0, F.lit(1.0)).otherwise(den)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def p_text(p: Column) -> Column:
    return F.when(p < 0.0001, F.lit("<0.0001")).otherwise(F.format_string("%.4f", p))


def hash_unit(*parts: Column | str, seed: int | str = 0) -> Column:
    """Uniform [0, 1) draw fixed by the row's id: the same row always gets the same number.

    First 32 bits of md5(id|seed). Any engine with md5 reproduces it, and it does not change
    with partitioning, task retries or executor loss.
    """
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(*parts: Column | str, seed: int | str = 0) -> Column:
    """md5 text to order rows at random but reproducibly."""
    return F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts], F.lit(str(seed))))
