"""Spelling groups against comparing all words with all words."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from corrobora.llm import spelling

from .test_corpus import SCHEMA, awkward

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def vocabulary(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts):
    out, form = [], {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        if others and -others[0][0] >= 10 * n:
            form[w] = others[0][1]
        out.append((w, n, len(others)))
    rows = []
    for w, n, k in out:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, k, counts[form[w]] if w in form else None))
    return sorted(rows)


def found(spark, rows, partitions=4):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    return sorted(tuple(r) for r in spelling.group_spellings(docs).collect())


def corpus(seed, stems=25):
    """Words with misspelled variants at frequencies that make chains of forms."""
    rng = random.Random(seed)
    alphabet = "abcdeéÀß÷"
    pool = []
    for _ in range(stems):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 10)))
        for n in (rng.choice([2000, 300]), 30, 30, 3, 2, 2):
            pool += [word.upper() if rng.random() < 0.3 else word] * n
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k:], word[:k] + rng.choice(alphabet) + word[k + 1 :]])
    rng.shuffle(pool)
    return [(rng.randint(0, 400), " ".join(pool[i : i + 60])) for i in range(0, len(pool), 60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = corpus(seed)
    want = by_hand(vocabulary(rows))
    assert any(r[1] and r[2] != r[1] for r in want), "no chain of forms in the fixture"
    assert found(spark, rows) == want


def test_filters_in_ranges_and_small_buffers(spark, monkeypatch):
    rows = corpus(3)
    want = by_hand(vocabulary(rows))
    monkeypatch.setattr(spelling, "FILTER_BYTES", 150)
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    assert found(spark, rows) == want


def test_awkward_rows(spark):
    rows = awkward() + awkward() + [(50, "Éclairs éclairs ×÷×÷×÷× ×÷×÷×÷× " * 2, "", "", 0, 0, 0, "")]
    # runs far beyond the last filter of its own
    rows += [(60 + i, "a" * 90 + " " + "a" * 91 + " " + "a" * 45 + "b" + "a" * 45 + " " + "ü" * 4000 + " " + "ü" * 4001, "", "", 0, 0, 0, "") for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in spelling.group_spellings(docs).collect())
    assert got == by_hand(vocabulary([r[:2] for r in rows]))
    assert any(len(r[0]) > 4000 for r in got)


def test_no_words(spark):
    assert spelling.group_spellings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(spark, [(1, "short one"), (2, None)]) == []


def test_filters_hold_all_words_and_few_others():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(9)) for _ in range(40_000)}
    inside, outside = sorted(words)[::2], sorted(words)[1::2]
    filters = spelling.Filters({9: len(inside)}, 1, 0)
    h = spelling.Spelled(inside).hashes
    for k in range(4):
        np.bitwise_or.at(filters.lanes[k], filters.place(9, h), spelling._bits(h, k))
    assert len(filters.may_hold(9, h)) == len(inside)
    assert len(filters.may_hold(9, spelling.Spelled(outside).hashes)) < 0.003 * len(outside)
    # what a probe is given as hash of an edit is the hash of the edited word
    word = "spellings"
    one = spelling.Spelled([word])
    every = spelling.Filters({8: 1, 9: 2}, 1, 0)
    every.lanes[:] = np.uint64(2**64 - 1)
    letters = np.array([ord(c) for c in "abcdefghijklmnopqrstuvwxyz"], np.uint32)
    edits = [e for _, e in spelling.probe(one, every, letters)]
    deleted = {word[:i] + word[i + 1 :] for i in range(9)}
    replaced = {word[:i] + c + word[i + 1 :] for i in range(9) for c in "abcdefghijklmnopqrstuvwxyz" if c > word[i]}
    assert sorted(edits) == sorted(deleted | replaced)
