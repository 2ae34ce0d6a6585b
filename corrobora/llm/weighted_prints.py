"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its lower-case words and how often each occurs. For every term and
every sample, two gamma variables and a uniform one are drawn from hashes of the term alone; they turn the weight into a quantised
level and a race value, and the term with the smallest value is the sample. Two texts draw the same (term, level) with a chance equal to
their generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scan import previous
from .common import stage, text_of

SAMPLES = 32
BLOCK = 4
SPLIT = r"[\x20\x09-\x0D]+"
_LOW = 0xFFFFFFFF
_BITS21 = (1 << 21) - 1


def _uniform(bits: Column, width: int) -> Column:
    return (bits.cast("double") + 0.5) / float(1 << width)


def _race(term: Column, seed: Column) -> tuple[Column, Column, Column]:
    """(r, beta, ln c) of a term in the sample of this seed: r and c are Gamma(2, 1), beta is uniform."""
    first, second = F.xxhash64(term, seed), F.xxhash64(term, seed + 1)
    u1, u2, beta = (_uniform(F.shiftrightunsigned(first, s).bitwiseAND(F.lit(_BITS21)), 21) for s in (43, 22, 1))
    u3, u4 = _uniform(F.shiftrightunsigned(second, 32), 32), _uniform(second.bitwiseAND(F.lit(_LOW)), 32)
    return -F.log(u1 * u2), beta, F.log(-F.log(u3 * u4))


def _drawn(term: Column, log_weight: Column, r: Column, beta: Column, log_c: Column) -> Column:
    """Race value in the high bits, identity of (term, level) in the low 32; null where the term is absent."""
    level = F.floor(log_weight / r + beta)
    value = log_c - r * (level - beta) - r
    place = ((value + 200.0) * float(1 << 22)).cast("bigint")
    name = term.bitwiseXOR(F.shiftleft(level.cast("bigint"), 20)).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(place, 32).bitwiseOR(name)


def samples(weights: DataFrame, keys: list[str], columns: list[str], n: int = SAMPLES) -> DataFrame:
    """One row per key and block of ``BLOCK`` samples: ``{weight}_{i}``, the winner of the block's sample i.

    ``weights`` has one row per (keys, term) with positive or null weights. Any partitioning by the keys is used as it is. Samples are
    drawn in blocks, a row each, because generated code for many at once grows beyond what the JVM compiles.
    """
    if n % BLOCK:
        raise ValueError(f"the number of samples must be a multiple of {BLOCK}")
    block = F.explode(F.sequence(F.lit(0), F.lit(n // BLOCK - 1))).alias("block")
    out = weights.select("*", block).withColumns({f"_log_{c}": F.log(F.col(c).cast("double")) for c in columns})
    races = {}
    for i in range(BLOCK):
        r, beta, log_c = _race(F.col("term"), (F.col("block") * BLOCK + i) * 2)
        races |= {f"_r_{i}": r, f"_b_{i}": beta, f"_c_{i}": log_c}
    drawn = [
        F.min(_drawn(F.col("term"), F.col(f"_log_{c}"), F.col(f"_r_{i}"), F.col(f"_b_{i}"), F.col(f"_c_{i}"))).alias(f"{c}_{i}")
        for c in columns for i in range(BLOCK)
    ]
    return out.withColumns(races).groupBy(*keys, "block").agg(*drawn)


def signatures(drawn: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per key: the samples' identities of each weight column as text, 8 hexadecimal digits each."""
    digits = lambda c: F.lpad(F.lower(F.hex(F.coalesce(F.col(c), F.lit(0)).bitwiseAND(F.lit(_LOW)))), 8, "0")
    parts = {f"_{c}": F.concat(*[digits(f"{c}_{i}") for i in range(BLOCK)]) for c in columns}
    rows = drawn.select(*keys, F.struct("block", *[x.alias(c) for c, x in parts.items()]).alias("part"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(*keys, *[F.array_join(F.col(f"parts._{c}"), "").alias(name) for c, name in columns.items()])


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two signatures, the estimate of the generalised Jaccard similarity."""
    same = [(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("double") for i in range(n)]
    return sum(same[1:], same[0]) / float(n)


def neighbours(docs: DataFrame) -> DataFrame:
    """ord, print, copies, n_chars, next_ord, next_print: every different (doc_id, text) and the next in descending order."""
    narrow = docs.select(F.col("ord"), F.xxhash64("text").alias("print"), F.length("text").cast("bigint").alias("n_chars"))
    rows = stage(narrow.groupBy("ord", "print").agg(F.count("*").alias("copies"), F.max("n_chars").alias("n_chars")), "print-rows")
    beside = previous(rows, {"next_ord": "ord", "next_print": "print"}, ["ord", "print"])
    last = rows.agg(F.max(F.struct("ord", "print"))).scalar()
    return beside.withColumn("last", last).select(
        "ord", "print", "copies", "n_chars", F.coalesce("next_ord", "last.ord").alias("next_ord"),
        F.when(F.col("next_ord").isNull(), F.col("last.print")).otherwise(F.col("next_print")).alias("next_print"),
    )


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The edited text has its last third replaced by as much of the start of the next document, by descending doc_id and round to
    the first after the last; null ids come last, equal ids are ordered by their texts' hashes. Rows equal in doc_id and text
    are one document for this order and get the same result each. Null text counts as empty: no words, a fingerprint of
    zeros, alike to any other text without words. Other columns are ignored; an empty table gives no rows.
    """
    lowest = F.lit(-(1 << 63)).cast("bigint")
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("ord"), text_of().alias("text"))
    order = stage(neighbours(base), "print-order")
    key = ["ord", "print"]
    # the one shuffle of whole texts; everything below but the heads stays in this partitioning
    texts = base.withColumn("print", F.xxhash64("text")).dropDuplicates(key)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    asks = order.select(F.col("next_ord").alias("ord"), F.col("next_print").alias("print"), F.col("ord").alias("to_ord"), F.col("print").alias("to_print"), third.alias("take"))
    heads = texts.join(asks, key).select(
        F.col("to_ord").alias("ord"), F.col("to_print").alias("print"), F.substring("text", F.lit(1), F.col("take")).alias("head")
    )
    own = texts.join(order.select(*key, "n_chars"), key).join(heads, key)
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int"))
    edited = own.withColumn("kept", kept)
    # words before the cut belong to both texts; the word at the cut may differ
    both = F.regexp_extract("kept", r"(?s)^(.*[\x20\x09-\x0D])", 1)
    done = (F.length("both") + 1).cast("int")
    parts = F.array(
        F.struct(F.lit(1).alias("own"), F.lit(1).alias("edit"), F.col("both").alias("part")),
        F.struct(F.lit(1).alias("own"), F.lit(0).alias("edit"), F.substring("text", done, F.length("text")).alias("part")),
        F.struct(F.lit(0).alias("own"), F.lit(1).alias("edit"), F.concat(F.substring("kept", done, F.length("kept")), F.col("head")).alias("part")),
    )
    split = edited.withColumn("both", both).select(*key, F.explode(parts).alias("p"))
    words = split.select(*key, "p.own", "p.edit", F.explode(F.split(F.lower("p.part"), SPLIT)).alias("word")).filter("word <> ''")
    counts = words.select(*key, "own", "edit", F.xxhash64("word").alias("term")).groupBy(*key, "term").agg(
        F.sum("own").alias("own"), F.sum("edit").alias("edit")
    )
    weights = counts.select(*key, "term", F.when(F.col("own") > 0, F.col("own")).alias("own"), F.when(F.col("edit") > 0, F.col("edit")).alias("edit"))
    prints = signatures(samples(weights, key, ["own", "edit"], n), key, {"own": "fingerprint", "edit": "edited_fingerprint"})
    hashes = edited.select(*key, F.sha2(F.concat("kept", "head").cast("binary"), 256).alias("edited_sha256"))
    blank = F.lit("0" * 8 * n)
    whole = hashes.join(prints, key, "left").select(
        *key, "edited_sha256", *[F.coalesce(c, blank).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    )
    whole = stage(whole, "prints")
    after = whole.select(F.col("ord").alias("next_ord"), F.col("print").alias("next_print"), F.col("fingerprint").alias("next_fingerprint"))
    out = order.join(whole, key).join(after, ["next_ord", "next_print"])
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return out.withColumn("copy", each).select(
        F.when(F.col("ord") != lowest, F.col("ord")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), n).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), n).alias("near_next"),
    )
