"""Quality rules and a boosted-tree verdict on document statistics.

Base rules and statistics are computed from every whole text. The verdict comes from gradient-boosted
trees that are fitted on a bounded sample of labelled documents (``TRAIN_ROWS``) and flattened
into arrays of nodes, so that a batch of documents is scored by a few numpy steps per level of
depth. Chosen statistics can only lower the score as they grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WORD_RE, text_of

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_NO_SYMBOLS = str.maketrans("", "", SYMBOLS)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "letter_share",
    "digit_share", "upper_share", "long_share", "words_per_line", "top_share",
]
#: Statistics of which more can never raise the score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "top_share")
TRAIN_ROWS = 20_000


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the model's statistics of one whole text (null: empty)."""
    text = text or ""
    words = WORD_RE.findall(text)
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    lengths = sizes[ids]
    chars = int(lengths.sum())
    lines = [x for x in text.split("\n") if WORD_RE.search(x)]
    dup_lines = len(lines) - len(set(lines))
    symbols = len(text) - len(text.translate(_NO_SYMBOLS))
    repeated = 0
    if n >= 3:
        pair = ids[:-2] * len(known) + ids[1:-1]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64) * len(known) + ids[2:]
        _, where, times = np.unique(code, return_inverse=True, return_counts=True)
        again = times[where] > 1
        marked = np.zeros(n, bool)
        for shift in range(3):
            marked[shift : n - 2 + shift] |= again
        repeated = int(marked.sum())
    counts = np.bincount(ids)
    letters = digits = uppers = 0
    for word, times in zip(known, counts.tolist()):
        if word.isalpha():
            letters += times * len(word)
        else:
            letters += times * sum(map(str.isalpha, word))
            digits += times * sum(map(str.isdigit, word))
        if not word.islower():
            uppers += times * sum(map(str.isupper, word))
    stats = [
        float(np.log1p(n)), chars / n, symbols / chars, dup_lines / len(lines), repeated / n, len(known) / n, letters / chars,
        digits / chars, uppers / chars, float((lengths > 20).mean()), n / len(lines), float(counts.max()) / n,
    ]
    return [n, chars, symbols, dup_lines, repeated], stats


@dataclass
class Trees:
    """Flattened trees: node k tests ``feature[k] <= cut[k]``, goes to ``left[k]`` or ``right[k]``; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, falling: set[int], rounds: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 64, penalty: float = 1.0, least: float = 2.0,
) -> Trees:
    """Second-order boosting of the log loss over binned statistics.

    A split on a falling statistic is taken only if the right leaf is not above the left one, and its
    midpoint bounds both subtrees, so the sum of the trees is monotonic.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int, low: float, high: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, np.inf, at, at, value * rate])
        best = None
        if left_depth and len(rows) > 1:
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.bincount(codes[rows, j], g[rows], len(e) + 1).cumsum()[:-1]
                hl = np.bincount(codes[rows, j], h[rows], len(e) + 1).cumsum()[:-1]
                vl = np.clip(-gl / (hl + penalty), low, high)
                vr = np.clip(-(gs - gl) / (hs - hl + penalty), low, high)
                gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                ok = (hl >= least) & (hs - hl >= least) & ((vr <= vl) if j in falling else True)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best:
            _, j, k, vl, vr = best
            goes = codes[rows, j] <= k
            middle = (vl + vr) / 2
            bounds = ((middle, high), (low, middle)) if j in falling else ((low, high), (low, high))
            a = grow(rows[goes], g, h, left_depth - 1, *bounds[0])
            b = grow(rows[~goes], g, h, left_depth - 1, *bounds[1])
            nodes[at] = [j, float(edges[j][k]), a, b, 0.0]
        return at

    def model() -> Trees:
        f, c, l, r, v = (np.array(col) for col in zip(*nodes)) if nodes else (np.zeros(0),) * 5
        return Trees(f.astype(int), c.astype(float), l.astype(int), r.astype(int), v.astype(float), np.array(roots, int), depth, start)

    every = np.arange(len(y))
    for _ in range(rounds if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-total))
        first = len(nodes)
        roots.append(grow(every, p - y, p * (1 - p), depth, -np.inf, np.inf))
        tree = model()
        tree.roots, tree.start = np.array([first]), 0.0
        total += tree.raw(x)
    return model()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from at most ``rows`` labelled documents, those with the smallest hash of their id.

    Null labels, ids and texts are left out; of several labels of a document the highest counts. None if nothing is left.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # a left-semi join first, so that labels of documents that are gone take no place in the sample
    there = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id")
    picked = marks.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stats = [statistics(t)[1] for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["quality"].astype(float), "x": stats})

    # at most ``rows`` narrow rows are broadcast and at most as many rows of statistics come back
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    got = sample.mapInPandas(batches, "doc_id bigint, y double, x array<double>").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    x = np.array(got["x"].tolist(), float)
    return fit(x, got["y"].to_numpy() > 0, {FEATURES.index(f) for f in FALLING})


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, the base counts, base_failed, score and kept for every document.

    Base rules: fewer than 50 words fail, and so do texts of which more than half of the words lie in a
    three-word window that occurs twice. Others are kept if the trees' score reaches ``threshold`` (without trees
    all are). Null text counts as empty and fails; repeated rows are judged alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType(
        [docs.schema[c] for c in carry] + [T.StructField(c, T.LongType()) for c in BASE]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )
    # a carried text is read where it is, not sent twice
    at = carry.index("text") if "text" in carry else len(carry)

    def batches(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in frames:
            texts = batch.column(at).to_pylist()
            both = [statistics(t) for t in texts]
            base = np.array([b for b, _ in both], np.int64).reshape(-1, len(BASE))
            stats = np.array([s for _, s in both], float).reshape(-1, len(FEATURES))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            score = shared.value.score(stats) if shared.value is not None else np.ones(len(stats))
            new = [pa.array(base[:, i]) for i in range(len(BASE))] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carry))] + new, names=list(schema.names))

    columns = [F.col(c).alias(f"in_{i}") for i, c in enumerate(carry)]
    return docs.select(*columns, *([] if at < len(carry) else [text_of()])).mapInArrow(batches, schema)
