"""The best documents for each query text, by accumulator-limited term-at-a-time scoring.

The documents are read once into rows of (doc_id, length, query terms in it with their counts); a written table of these
rows is the index of a query set. Every task scores the whole query set over its own documents, a block of them at a
time: a query's terms come rarest first, a document gets an accumulator when a term first adds to it, and as soon as all the
remaining terms together could not lift a fresh document to the k-th best score, no accumulators are made any more and the
remaining terms only update those that exist. The k-th best score counts what the task's earlier blocks have
found. Tasks hand on their k best per query; scores are exact, so the k best of these are the k best of all.

No posting list is ever in one place: a term that is in every document is split by documents like any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, stage

#: Text of the queries that one pass over the documents may carry.
QUERY_BYTES = 32 << 20
#: Documents and postings that are scored at a time.
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 1 << 21
#: First of two rankings: the candidates of a query are dealt over so many groups.
SPREAD = 64
_EDGE = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of separators become spaces, A-Z becomes a-z, all others stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """Terms of a UTF-8 text with their counts."""
    counts: Counter[bytes] = Counter()
    for part in slices(text, _EDGE):
        counts.update(part.translate(_FOLD).split())
    return counts


class Queries:
    """The terms of a set of queries, numbered; what the tasks need of it is a few arrays."""

    def __init__(self, items: dict[object, set[bytes]]) -> None:
        self.ids = list(items)
        self.number = {t: i for i, t in enumerate(sorted(set().union(*items.values())))} if items else {}
        self.terms = [np.array(sorted(self.number[t] for t in items[i]), np.int64) for i in self.ids]

    def weigh(self, df: np.ndarray, documents: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Weights of the terms, and every query's terms rarest first."""
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        return weights, [terms[np.lexsort((terms, df[terms]))] for terms in self.terms]


def read_queries(items: DataFrame) -> Iterator[Queries]:
    """The query set in groups of about QUERY_BYTES of text, by a hash of the id; rows of one id are one query."""
    rows = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // QUERY_BYTES)
    for g in range(groups):
        terms: dict[object, set[bytes]] = {}
        for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toLocalIterator():
            terms.setdefault(r["item_id"], set()).update(term_counts(bytes(r["text"] or b"")))
        yield Queries(terms)


def index(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (of the queries' terms only) of every document with a term."""
    number = queries.number

    def count(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for frame in frames:
            ids, lengths, terms, counts = [], [], [], []
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                found = term_counts(text.as_py() or b"")
                if found:
                    mine = found.keys() & number.keys()
                    ids.append(doc_id)
                    lengths.append(found.total())
                    terms.append([number[t] for t in mine])
                    counts.append([found[t] for t in mine])
            columns = pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "n", "terms", "counts"])

    read = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    return read.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


class Best:
    """The k best (score, id) of one query so far: highest score first, then lowest id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """A score below this is not among the k best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


class Block:
    """The postings of some documents: per term the documents that hold it and what it adds to their scores."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, count: np.ndarray, norm: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        term, self.doc, count = term[order], doc[order], count[order]
        self.add = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * norm[self.doc]))
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.add, self.starts[held])
        self.size = len(norm)

    def score(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, their exact scores, accumulators made): all that can be among the k best are there."""
        terms = terms[self.most[terms] > 0]
        # what the terms from each place on can add at most
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0)
        sums = np.zeros(self.size, np.int64)
        creating, made = True, 0
        for j, t in enumerate(terms):
            doc, add = self.doc[self.starts[t] : self.starts[t + 1]], self.add[self.starts[t] : self.starts[t + 1]]
            if creating and rest[j] < max(floor, int(sums.max(initial=0))):
                kth = int(np.partition(sums, -k)[-k]) if self.size >= k else 0
                # a fresh document ends below the k-th best; one that ties with it may still come first, so not at equality
                creating = rest[j] >= max(floor, kth)
                made = int(np.count_nonzero(sums))
            if creating:
                sums[doc] += add
            else:
                old = sums[doc]
                sums[doc] = np.where(old > 0, old + add, 0)
        found = np.flatnonzero(sums > 0)
        if len(found) > k:
            # all that tie with the k-th stay; ids decide later
            found = found[sums[found] >= np.partition(sums[found], -k)[-k]]
        return found, sums[found], made if not creating else int(np.count_nonzero(sums))


def score_blocks(rows: DataFrame, queries: Queries, weights: np.ndarray, order: list[np.ndarray], documents: int, total: int, k: int, id_type: str) -> DataFrame:
    """item_id, doc_id, score: the k best of every task for every query."""

    def best(frames: Iterator) -> Iterator:
        import pyarrow as pa

        bests = [Best(k) for _ in order]

        def take(ids: list, lengths: list, terms: list, counts: list) -> None:
            norm = 10 + 90 * np.array(lengths, np.int64) * documents // total
            sizes = [len(x) for x in terms]
            doc = np.repeat(np.arange(len(ids)), sizes)
            flat = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (terms, counts))
            term, count = flat
            block = Block(term, doc, count, norm, weights)
            null = np.array([i is None for i in ids], bool)
            plain = np.array([0 if i is None else i for i in ids], np.int64)
            for query, mine in zip(order, bests):
                found, scores, _ = block.score(query, k, mine.floor)
                if len(found):
                    mine.add(scores, plain[found], null[found])

        held: tuple[list, ...] = ([], [], [], [])
        postings = 0
        for frame in frames:
            columns = [frame.column(c) for c in ("doc_id", "n", "terms", "counts")]
            for row in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3]):
                terms, counts = (x.values.to_numpy(zero_copy_only=False) for x in row[2:])
                for column, value in zip(held, (*row[:2], terms, counts)):
                    column.append(value)
                postings += len(terms)
                if len(held[0]) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    take(*held)
                    held, postings = ([], [], [], []), 0
        if held[0]:
            take(*held)
        items = [(i, None if n else int(d), int(s)) for i, b in zip(queries.ids, bests) for s, d, n in zip(b.scores, b.ids, b.null)]
        if items:
            columns = [pa.array(c) if j == 0 else pa.array(c, pa.int64()) for j, c in enumerate(zip(*items))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(best, f"item_id {id_type}, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    Documents without a term (null, empty or blank texts among them) count nowhere. Equal scores rank by ascending doc_id,
    null ids last; repeated rows are documents of their own and all have a rank. Rows of ``items`` with one id, or without an
    id, are one query; one without a term finds nothing. No documents or no items give an empty result. Other columns
    are not read. Per term and query the driver holds one number; queries beyond QUERY_BYTES of text take further passes.
    """
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {id_type}, doc_id bigint, score bigint")
    for queries in read_queries(items):
        rows = stage(index(docs, queries), "lexical-index")
        documents, total = rows.agg(F.count("*"), F.sum("n")).first()
        if not documents or not queries.number:
            continue
        df = np.zeros(len(queries.number), np.int64)
        for t, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = n
        weights, order = queries.weigh(df, documents)
        found = found.union(score_blocks(rows, queries, weights, order, documents, total, k, id_type))
    first = Window.partitionBy("item_id", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    last = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    some = found.withColumn("part", F.spark_partition_id() % SPREAD).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
