"""Ranked search against scoring every document for every query."""

import collections
import math
import random
import re

import numpy as np
import pytest

from corrobora.llm import lexical

from .test_corpus import SCHEMA, awkward, prose

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id bigint, text string, extra string, doc_id bigint"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def every_score(rows, items, k=10):
    docs = [(i, collections.Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    total = sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    queries = collections.defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms(t))
    out = []
    for item, wanted in queries.items():
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, rows, items, k=10):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in lexical.search(docs, asked, k).collect()), key=repr)


def test_awkward_rows(spark):
    rows = awkward()
    items = [(i, prose(random.Random(i), 12)) for i in range(8)]
    items += [(8, None), (9, ""), (10, "no such-term Zzz"), (11, "NO ID here ü"), (None, "bade fi"), (None, "go"), (1, "bade"), (12, "ÜÜ Ü é 12 x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    got = sorted((tuple(r) for r in lexical.search(docs, asked).collect()), key=repr)
    assert got == every_score([r[:2] for r in rows], items)


@pytest.mark.parametrize("block", [3, 40, 16_384])
def test_blocks_and_ties(spark, monkeypatch, block):
    rng = random.Random(block)
    # few distinct texts, so that many scores tie at the k-th place
    texts = [prose(rng, rng.randint(3, 30)) for _ in range(25)]
    rows = [(rng.randint(1, 900), rng.choice(texts)) for _ in range(600)] + [(None, texts[0])] * 3
    items = [(i, " ".join(rng.sample(rng.choice(texts).split(), 3)) + " " + prose(rng, 10)) for i in range(20)]
    # read where the function is made, so that the tasks see them
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    for k in (1, 4):
        assert search(spark, rows, items, k) == every_score(rows, items, k)


def test_block_scores_are_exact_with_few_accumulators():
    rng = np.random.default_rng(3)
    size, vocabulary = 5000, 60
    share = 1 / np.arange(1, vocabulary + 1)
    held = rng.random((size, vocabulary)) < share
    doc, term = np.nonzero(held)
    count = rng.integers(1, 5, len(doc))
    norm = rng.integers(10, 400, size)
    df = held.sum(0)
    weights = np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * int(n) + 1))) for n in df])
    block = lexical.Block(term, doc, count, norm, weights)
    full = np.zeros((size, vocabulary), np.int64)
    full[doc, term] = weights[term] * ((10**9 * count) // (1000 * count + 8 * norm[doc]))
    made_in_all = 0
    for _ in range(40):
        query = rng.choice(vocabulary, 12, replace=False)
        query = query[np.lexsort((query, df[query]))]
        scores = full[:, query].sum(1)
        for floor in (0, int(np.sort(scores)[-10])):
            found, got, made = block.score(query, 10, floor)
            made_in_all += made
            assert (got == scores[found]).all()
            least = max(np.sort(scores)[-10], 1)
            assert set(np.flatnonzero(scores >= least)) <= set(found)
    # most documents hold some term of a query, few get an accumulator
    assert made_in_all < 0.5 * 80 * size


def test_queries_in_groups(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40)) for i in range(200)]
    items = [(i, prose(rng, 9)) for i in range(40)]
    whole = search(spark, rows, items)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 700)
    assert search(spark, rows, items) == whole == every_score(rows, items)


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", "", 0)], ITEMS)
    assert lexical.search(docs, some).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), asked).count() == 0


def test_long_text_is_counted_in_slices():
    text = " ".join(f"Word{i % 501}-é" for i in range(300_000))
    assert {t.decode(): n for t, n in lexical.term_counts(text.encode()).items()} == collections.Counter(terms(text))
