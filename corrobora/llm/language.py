"""Language of a text by its words, with character n-grams for the words that are not known.

Known words score by their log frequency in each language. A word outside the table falls back to
character n-grams, the longest first: n-grams of ``LONGEST`` characters if any of the word's are
known, else one shorter, down to single letters.

The tables are learned from a bounded sample of the labelled documents of each language (``TRAIN_DOCS``), so every labelled
language is learned, and hold at most ``TOP_WORDS`` words and ``TOP_GRAMS`` n-grams per language, so they can be sent to every task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import stage, text_of

#: Documents of each language that are learned from.
TRAIN_DOCS = 20_000
TOP_WORDS = 30_000
TOP_GRAMS = 10_000
LONGEST = 4
_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Tables:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def _grams(word: str, n: int) -> list[str]:
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def learn(docs: DataFrame, sample: int = TRAIN_DOCS, words: int = TOP_WORDS, grams: int = TOP_GRAMS) -> Tables | None:
    """Tables from at most ``sample`` documents of each language with text and lang, those with the smallest hash of their id.

    Words and n-grams are counted in Spark; only the most frequent of each language reach the driver. What a language's
    sample holds counts for all its documents in the prior. None if no document has a language and a letter.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    # hashes first: the ones that can be among the smallest are a bounded number; their last one is the cut of the language
    hashes = known.select("lang", F.xxhash64("doc_id").alias("hash")).distinct()
    docs_of = hashes.groupBy("lang").agg(F.count("*").alias("docs"))
    share = F.col("hash").cast("double") / float(1 << 64) + 0.5
    low = hashes.join(F.broadcast(docs_of), "lang").filter(share * F.col("docs") <= sample + 8 * math.sqrt(sample) + 20)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    first = low.withColumn("place", place).filter(F.col("place") <= sample)
    found = first.groupBy("lang").agg(F.max("hash").alias("cut"), (F.max("docs") / F.max("place")).alias("times")).collect()
    if not found:
        return None
    cuts = docs.sparkSession.createDataFrame([(r["lang"], r["cut"]) for r in found], "lang string, cut bigint")
    times = {r["lang"]: r["times"] for r in found}
    picked = known.join(F.broadcast(cuts), "lang").filter(F.xxhash64("doc_id") <= F.col("cut")).select("lang", "text")

    def counted(found: Counter, schema: list[str]) -> Iterator:
        import pyarrow as pa

        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)] + [pa.array(list(found.values()), pa.int64())], schema)

    def cut_words(frames: Iterator) -> Iterator:
        for batch in frames:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(_TOKEN.findall(text.lower())).items():
                    found[lang, word] += n
            yield from counted(found, ["lang", "term", "n"])

    def cut_grams(frames: Iterator) -> Iterator:
        for batch in frames:
            found: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for size in range(1, LONGEST + 1):
                    for gram in _grams(f" {word} " if size > 1 else word, size):
                        found[lang, size, gram] += n
            yield from counted(found, ["lang", "kind", "term", "n"])

    # n-grams are cut from the distinct words of a language, whose counts they carry
    seen = picked.mapInArrow(cut_words, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    seen = stage(seen, "language-words")
    cut = seen.mapInArrow(cut_grams, "lang string, kind bigint, term string, n bigint").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    counts = seen.select("lang", F.lit(0).cast("bigint").alias("kind"), "term", "n").union(cut)
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "term")
    total = F.sum("n").over(Window.partitionBy("lang", "kind"))
    limit = F.when(F.col("kind") == 0, words).otherwise(grams)
    tops = counts.withColumn("total", total).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
    rows = tops.toPandas().sort_values(["lang", "kind", "place"])
    if not len(rows):
        return None
    sizes = rows[rows["kind"] == 0].groupby("lang")["total"].first()
    sizes = sizes * sizes.index.map(times)
    langs = sorted(sizes.index)
    prior = np.log(np.array([sizes[x] for x in langs], float) / sizes[langs].sum())

    def matrix(part) -> tuple[dict[str, int], np.ndarray]:
        terms = {t: i for i, t in enumerate(dict.fromkeys(part["term"]))}
        logs = np.full((len(terms), len(langs)), np.nan)
        for lang, own in part.groupby("lang"):
            if lang in sizes.index:
                j = langs.index(lang)
                logs[[terms[t] for t in own["term"]], j] = np.log((own["n"] + 0.5) / (own["total"] + 0.5 * len(terms))).to_numpy()
        for j, lang in enumerate(langs):
            own = part[part["lang"] == lang]
            floor = math.log(0.5 / (float(own["total"].iloc[0]) + 0.5 * len(terms))) if len(own) else math.log(0.5 / len(terms))
            logs[np.isnan(logs[:, j]), j] = floor
        return terms, logs

    word_ids, word_logs = matrix(rows[rows["kind"] == 0])
    gram_ids: dict[str, int] = {}
    gram_logs = []
    for size in range(1, LONGEST + 1):
        ids_, logs = matrix(rows[rows["kind"] == size])
        gram_ids |= {t: i + len(gram_ids) for t, i in ids_.items()}
        gram_logs.append(logs)
    return Tables(langs, prior, word_ids, word_logs, gram_ids, np.concatenate(gram_logs))


def back_off(tables: Tables, word: str) -> np.ndarray:
    """Mean log frequency of the word's longest known n-grams (zeros if none is known)."""
    for size in range(LONGEST, 0, -1):
        found = [tables.grams[g] for g in _grams(f" {word} " if size > 1 else word, size) if g in tables.grams]
        if found:
            return tables.gram_logs[found].mean(0)
    return np.zeros(len(tables.langs))


def guess(tables: Tables | None, text: str | None, seen: dict[str, np.ndarray]) -> tuple[str, float]:
    """(language, its share of the probability among the languages) of one whole text."""
    words = _TOKEN.findall((text or "").lower())
    if tables is None or not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    index = np.array([tables.words.get(w, -1) for w in words])
    total = tables.prior + tables.word_logs[index[index >= 0]].sum(0)
    for i in np.flatnonzero(index < 0).tolist():
        logs = seen.get(words[i])
        if logs is None:
            if len(seen) > 100_000:
                seen.clear()
            logs = seen[words[i]] = back_off(tables, words[i])
        total = total + logs
    best = int(total.argmax())
    # the share is that of ten words like the text's, else any long text would get exactly 1
    odds = np.exp((total - total[best]) * min(1.0, 10 / len(words)))
    return tables.langs[best], float(1 / odds.sum())


def identify(docs: DataFrame, tables: Tables | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, lang_pred and score (0 to 1) of every document.

    Only the text is read. Null texts and texts without a letter give ``und`` and 0, and so does a table
    without any labelled document. Ties go to the language first in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    fields = [docs.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    # a carried text is read where it is, not sent twice
    at = carry.index("text") if "text" in carry else len(carry)

    def batches(frames: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}
        for batch in frames:
            texts = batch.column(at).to_pylist()
            found = [guess(shared.value, t, seen) for t in texts]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carry))] + new, names=schema.names)

    columns = [F.col(c).alias(f"in_{i}") for i, c in enumerate(carry)]
    return docs.select(*columns, *([] if at < len(carry) else [text_of()])).mapInArrow(batches, schema)
