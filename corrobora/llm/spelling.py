"""Groups of spellings: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary's words are put into blocked Bloom filters, one per word length. Every word generates the words
that it becomes by one deleted letter and by one replaced letter (an insertion is the deletion seen from the longer
word) and probes each against the filter of that length, which every task holds. Only positives leave their task: an
equi-join with the vocabulary removes the false ones. A word's form is its most frequent neighbour, if that is much more
frequent; roots follow from forms by pointer jumping.

Filters are a fixed number of bits per word. A vocabulary whose filters exceed ``FILTER_BYTES`` is probed in as many
passes as it takes, each with the filters of one hash range.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import slices, stage

#: Letters of words: ASCII and Latin-1. Only A-Z is lower-cased.
LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form occurs so many times as often as the word at least.
RATIO = 10
#: One run in so many loses a letter, by its checksum.
TYPO = 31
#: Words longer than this share one filter.
LAST_SHARD = 64
BITS_PER_WORD = 20
FILTER_BYTES = 64 << 20
#: Probes made at a time, and distinct words counted in a task before they are handed on.
PROBES = 1 << 21
HELD_WORDS = 300_000
#: A block is four words of 64 bits; a word sets two bits in each.
_LANES = 4
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = _U(pow(_BASE, -1, 1 << 64))


def words(docs: DataFrame) -> DataFrame:
    """word, n: every word of at least LEAST_LETTERS letters that occurs LEAST_COUNT times.

    A word is a maximal run of letters; the runs whose checksum with the doc_id is a multiple of TYPO lose one letter.
    Null texts have none; a null doc_id counts as an empty one. Repeated rows count each time. Other columns are not read.
    """
    least, typo, held_words = LEAST_LETTERS, TYPO, HELD_WORDS

    def count(frames: Iterator) -> Iterator:
        import pyarrow as pa

        runs, edge = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[^{LETTERS}]")
        totals: Counter[str] = Counter()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
            totals.clear()
            return out

        for frame in frames:
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                # bytes.lower changes A-Z alone
                lowered = (text.as_py() or b"").lower().decode("utf-8", "replace")
                found: Counter[str] = Counter()
                for part in slices(lowered, edge):
                    found.update(runs.findall(part))
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % typo == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least:
                            continue
                    totals[run] += n
                if len(totals) > held_words:
                    yield batch()
        if totals:
            yield batch()

    read = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    counted = read.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, _BASE, np.uint64), out=out[1:])
    return out


class Spelled:
    """Words of one length as arrays: code points, letter values and the sums a word's hash is made of."""

    def __init__(self, group: list[str]) -> None:
        self.length = len(group[0])
        self.codes = np.array(group, f"<U{self.length}").view(np.uint32).reshape(len(group), self.length)
        self.powers = _powers(self.length)
        terms = mix(self.codes.astype(np.uint64)) * self.powers[:-1]
        self.sums = np.zeros((len(group), self.length + 1), np.uint64)
        np.cumsum(terms, 1, out=self.sums[:, 1:])

    @property
    def hashes(self) -> np.ndarray:
        return mix(self.sums[:, -1])


def by_length(vocabulary: list[str], cells: int = PROBES) -> Iterator[tuple[np.ndarray, Spelled]]:
    """Places and arrays of the words of each length, not more letters at a time than ``cells`` (one word at least)."""
    lengths = np.array([len(w) for w in vocabulary], np.int64)
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(group):
            step = max(1, cells // int(lengths[group[0]]))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                yield some, Spelled([vocabulary[i] for i in some])


def shard_of(length: int) -> int:
    return min(length, LAST_SHARD)


def _bits(h: np.ndarray, lane: int) -> np.ndarray:
    low, high = _U(12 * lane), _U(12 * lane + 6)
    return (_U(1) << ((h >> low) & _U(63))) | (_U(1) << ((h >> high) & _U(63)))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    spread = (h * _U(0xD6E8FEB86659FD93)) >> _U(32)
    return ((spread * _U(blocks)) >> _U(32)).astype(np.int64)


class Filters:
    """Blocked Bloom filters by word length for the words whose hash falls into one of ``slices`` ranges."""

    def __init__(self, counts: dict[int, int], n_slices: int, slice_: int) -> None:
        self.n_slices, self.slice = n_slices, slice_
        self.blocks = {s: -(-n * BITS_PER_WORD // (n_slices * 64 * _LANES)) for s, n in sorted(counts.items())}
        starts = np.cumsum([0, *self.blocks.values()])
        self.starts = dict(zip(self.blocks, starts.tolist()))
        self.counts = counts
        self.lanes = np.zeros((_LANES, int(starts[-1])), np.uint64)

    def mine(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(50)) % _U(self.n_slices) == _U(self.slice)

    def place(self, shard: int, h: np.ndarray) -> np.ndarray:
        return self.starts[shard] + _block(h, self.blocks[shard])

    def may_hold(self, shard: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that the shard may hold: all that it holds and few others."""
        at = np.flatnonzero(self.mine(h)) if self.n_slices > 1 else np.arange(len(h))
        h = h[at]
        block = self.place(shard, h)
        for lane in range(_LANES):
            wanted = _bits(h, lane)
            kept = np.flatnonzero(self.lanes[lane].take(block) & wanted == wanted)
            at, h, block = at[kept], h[kept], block[kept]
        return at


def build(vocabulary: DataFrame, counts: dict[int, int], n_slices: int, slice_: int) -> Filters:
    """The filters of one hash range: blocks are made in tasks and by key; the driver gets FILTER_BYTES of them at most."""
    empty = Filters(counts, n_slices, slice_)
    lanes = [f"lane{k}" for k in range(_LANES)]

    def marks(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for frame in frames:
            for _, group in by_length(frame.column(0).to_pylist()):
                h = group.hashes
                h = h[empty.mine(h)]
                columns = [empty.place(shard_of(group.length), h), *(_bits(h, k).view(np.int64) for k in range(_LANES))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", *lanes])

    made = vocabulary.select("word").mapInArrow(marks, "block bigint, " + ", ".join(f"{c} bigint" for c in lanes))
    full = made.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in lanes]).toArrow()
    block = full.column("block").to_numpy()
    for k, c in enumerate(lanes):
        empty.lanes[k][block] = full.column(c).to_numpy().view(np.uint64)
    return empty


def probe(group: Spelled, filters: Filters, letters: np.ndarray) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) for every edit that the filters may hold: one letter deleted, or replaced by a later one.

    Of a pair that differs by one letter the word with the earlier letter finds the other. Of equal letters in a row only the first is
    deleted, the others give the same word.
    """
    n, length, codes, sums = len(group.codes), group.length, group.codes, group.sums
    texts = codes.view(f"<U{length}").ravel()
    shorter = shard_of(length - 1)
    if shorter in filters.counts:
        first = np.ones((n, length), bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(first)
        h = mix(sums[row, at] + (sums[row, -1] - sums[row, at + 1]) * _BASE_INVERSE)
        for k in filters.may_hold(shorter, h).tolist():
            word = str(texts[row[k]])
            yield int(row[k]), word[: at[k]] + word[at[k] + 1 :]
    shard = shard_of(length)
    # a shard of one word holds no other
    if filters.counts.get(shard, 0) < 2:
        return
    values = mix(letters.astype(np.uint64))
    step = max(1, PROBES // (n * len(letters)))
    for start in range(0, length, step):
        here = codes[:, start : start + step]
        row, at, letter = np.nonzero(letters[None, None, :] > here[:, :, None])
        if len(row):
            old = mix(here[row, at].astype(np.uint64))
            at += start
            h = mix(sums[row, -1] + (values[letter] - old) * group.powers[at])
            for k in filters.may_hold(shard, h).tolist():
                word = str(texts[row[k]])
                yield int(row[k]), word[: at[k]] + chr(letters[letter[k]]) + word[at[k] + 1 :]


def candidates(vocabulary: DataFrame, filters: Filters, letters: str) -> DataFrame:
    """word, n, near: the edits of every word that may be words."""
    held = vocabulary.sparkSession.sparkContext.broadcast(filters)
    codes = np.array([ord(c) for c in letters], np.uint32)

    def edits(frames: Iterator) -> Iterator:
        import pyarrow as pa

        filters = held.value
        for frame in frames:
            column, counts = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            for places, group in by_length(column, PROBES // len(codes)):
                rows: list[tuple[str, int, str]] = []
                size = 0
                for row, near in probe(group, filters, codes):
                    i = int(places[row])
                    rows.append((column[i], counts[i], near))
                    size += len(near)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["word", "n", "near"])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["word", "n", "near"])

    return vocabulary.mapInArrow(edits, "word string, n bigint, near string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of words (word, n; distinct) that differ by one edit, once.

    ``vocabulary`` must be a written table; an empty one gives no pairs.
    """
    length = F.least(F.char_length("word"), F.lit(LAST_SHARD)).alias("shard")
    counts = {r["shard"]: r["n"] for r in vocabulary.groupBy(length).agg(F.count("*").alias("n")).collect()}
    letters = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()))
    n_slices = max(1, -(-sum(counts.values()) * BITS_PER_WORD // (8 * FILTER_BYTES)))
    right = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = vocabulary.sparkSession.createDataFrame([], "word string, n bigint, near string")
    if letters:
        for s in range(n_slices):
            found = found.union(candidates(vocabulary, build(vocabulary, counts, n_slices, s), letters))
    return found.join(right, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form. A form is RATIO times as frequent at least, so 18 steps suffice; 5 jumps make 32."""
    linked = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(5):
        further = linked.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = linked.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = stage(moved, "spelling-roots")
        linked = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return linked


def group_spellings(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents (``words`` says which).

    n_near counts the words one edit away. The form is the most frequent of them (ties: the first in code-point order) if it is at
    least RATIO times as frequent as the word, else null; the root is the end of the chain of forms, the word itself if it has none.
    No words give an empty table.
    """
    vocabulary = stage(words(docs), "spelling-words")
    pairs = near_words(vocabulary)
    # most frequent first, then the smallest
    both = F.array(
        F.struct(F.col("word"), F.col("n"), (-F.col("near_n")).alias("minus"), F.col("near")),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), (-F.col("n")).alias("minus"), F.col("word").alias("near")),
    )
    seen = pairs.select(F.inline(both))
    alone = vocabulary.select("word", "n", F.lit(None).cast("bigint").alias("minus"), F.lit(None).cast("string").alias("near"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("minus", "near")))
    grouped = seen.union(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    strong = -F.col("best.minus") >= RATIO * F.col("n")
    table = grouped.select("word", "n", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    table = stage(table, "spelling-forms")
    found = table.join(roots(table.filter(F.col("form").isNotNull())), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
