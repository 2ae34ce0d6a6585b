"""Decision trees grown level by level from histograms.

Features are cut into bins by training quantiles. For a level every task adds its rows up into cells (tree, node, feature,
bin) of gradient and weight; the cells of all tasks are summed by key, and the best cut of each node is found among its bins.
So a level is one pass over the rows for all trees, and what leaves the tasks is bounded by trees x nodes x features x bins.
A bagged forest and boosting are the same growth with other gradients.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.draws import POISSON_TABLE, draws16, row_state
from ..session import staged
from .features import training_quantiles

#: Cells of one task's histogram; trees are grown in groups that stay below.
CELLS = 1 << 22


@dataclass(frozen=True)
class Tree:
    """A complete binary tree as arrays: the children of node i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node where each row ends; a missing number goes left."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(int(math.log2(len(self.feature) + 1))):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] >= self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def importance(self, features: int) -> np.ndarray:
        out = np.bincount(self.feature[self.feature >= 0], self.gain[self.feature >= 0], features)
        return out / out.sum() if out.sum() > 0 else out


@dataclass(frozen=True)
class Ensemble:
    """Mean of bagged trees, or the chance from a sum of boosted ones."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    boosted: bool
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.sum([t.value[t.nodes(x)] for t in self.trees], axis=0) if self.trees else np.zeros(len(x))
        return 1 / (1 + np.exp(-(self.base + total))) if self.boosted else total / max(len(self.trees), 1)

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., prediction, score): the chance of class 1, and 1 where it exceeds one half."""

        def scored(frames: Iterator) -> Iterator:
            import pyarrow as pa

            for frame in frames:
                score = self.score(_matrix(frame, self.features))
                columns = [frame.column(c) for c in keep] + [pa.array((score > 0.5).astype(float)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "prediction", "score"])

        kept = df.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features)])
        schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
        return kept.mapInArrow(scored, schema + ", prediction double, score double")

    def importances(self) -> list[tuple[str, float, int]]:
        """(feature, share of the gain, rank): shares are taken within each tree, then averaged."""
        each = [t.importance(len(self.features)) for t in self.trees]
        mean = np.mean(each, axis=0) if each else np.zeros(len(self.features))
        order = sorted(range(len(self.features)), key=lambda i: (-mean[i], self.features[i]))
        return [(self.features[i], float(mean[i]), r + 1) for r, i in enumerate(order)]


def _matrix(frame, features: Sequence[str]) -> np.ndarray:
    columns = [frame.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))]
    return np.column_stack(columns) if columns else np.zeros((frame.num_rows, 0))


def _best_cuts(cells: DataFrame, penalty: float, least: float) -> list:
    """Per (tree, node): totals, and the cut of most gain if any cut has some (ties: first feature, then lowest bin)."""
    # a node's bins of one feature: bounded by the number of bins
    order = Window.partitionBy("tree", "node", "feature").orderBy("bin")
    sums = cells.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = {"gl": F.sum("g").over(before), "hl": F.sum("h").over(before), "gt": F.sum("g").over(every), "ht": F.sum("h").over(every)}
    sides = sums.withColumns(named).withColumns({"gr": F.col("gt") - F.col("gl"), "hr": F.col("ht") - F.col("hl")})
    part = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + penalty)
    gain = F.when((F.col("hl") >= least) & (F.col("hr") >= least), part("gl", "hl") + part("gr", "hr") - part("gt", "ht"))
    ranked = sides.withColumn("gain", F.when(gain > 1e-9, gain))
    cut = F.struct((-F.col("gain")).alias("lost"), "feature", "bin", "gl", "hl", "gr", "hr")
    best = ranked.groupBy("tree", "node").agg(F.min(F.when(F.col("gain").isNotNull(), cut)).alias("cut"), F.max("gt").alias("gt"), F.max("ht").alias("ht"))
    return best.collect()


def _allowed(tree: int, node: int, features: int, some: int | None) -> np.ndarray:
    """The features that a node may be cut by: a fixed draw by tree and node."""
    out = np.ones(features, bool)
    if some is not None and some < features:
        order = sorted(range(features), key=lambda f: hashlib.md5(f"{tree}|{node}|{f}".encode()).hexdigest())
        out[order[some:]] = False
    return out


def _grow(rows: DataFrame, cuts: list[np.ndarray], depth: int, numbers: Sequence[int], gradients, some: int | None, penalty: float, least: float, step: float) -> list[Tree]:
    """Trees of the given numbers; ``gradients(x, y, state)`` gives (g, h) with one column per tree."""
    features, bins = len(cuts), max((len(c) for c in cuts), default=0) + 1
    trees = [Tree.empty(depth) for _ in numbers]
    open_nodes = [{0} for _ in numbers]
    names = [f"c{i}" for i in range(features)]
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        mask = np.array([[_allowed(n, first + k, features, some) for k in range(width)] for n in numbers])

        def cells(frames: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros((2, len(trees), features, width * bins))
            for frame in frames:
                x = _matrix(frame, names)
                g, h = gradients(x, frame.column("_y").to_numpy(zero_copy_only=False), frame.column("_s"))
                code = [np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f], "right")) for f, c in enumerate(cuts)]
                for t, tree in enumerate(trees):
                    node = tree.nodes(x) - first
                    # rows whose node was closed on an earlier level end above this one
                    here = np.flatnonzero((node >= 0) & (h[:, t] > 0))
                    for f in range(features):
                        at = node[here] * bins + code[f][here]
                        total[0, t, f] += np.bincount(at, g[here, t], width * bins)
                        total[1, t, f] += np.bincount(at, h[here, t], width * bins)
            t, f, at = np.nonzero(total[1])
            node, code = np.divmod(at, bins)
            kept = mask[t, node, f]
            t, f, at, node, code = (v[kept] for v in (t, f, at, node, code))
            columns = t, node + first, f, code, total[0, t, f, at], total[1, t, f, at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "feature", "bin", "g", "h"])

        found = rows.mapInArrow(cells, "tree bigint, node bigint, feature bigint, bin bigint, g double, h double")
        following: list[set[int]] = [set() for _ in trees]
        for r in _best_cuts(found, penalty, least):
            tree, node, cut = trees[r["tree"]], r["node"], r["cut"]
            if node not in open_nodes[r["tree"]]:
                continue
            if level == 0:
                tree.value[node] = step * r["gt"] / (r["ht"] + penalty)
            if cut is not None:
                tree.feature[node], tree.cut[node], tree.gain[node] = cut["feature"], cuts[cut["feature"]][cut["bin"] - 1], -cut["lost"]
                for child, g, h in ((2 * node + 1, cut["gl"], cut["hl"]), (2 * node + 2, cut["gr"], cut["hr"])):
                    tree.value[child] = step * g / (h + penalty)
                    following[r["tree"]].add(child)
        open_nodes = following
    return trees


def _prepared(train: DataFrame, label: str, features: Sequence[str], row_id: Sequence[str], bins: int, indicators: Sequence[str], seed: int) -> tuple[DataFrame, list[np.ndarray]]:
    rows = staged(
        train.filter(F.col(label).isNotNull()).select(
            *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("_y"), row_state(*row_id, seed=seed).alias("_s")
        )
    )
    cuts = []
    for i, c in enumerate(features):
        found = [1.0] if c in indicators else training_quantiles(rows, f"_x{i}", [k / bins for k in range(1, bins)])
        cuts.append(np.array(sorted({q for q in found if q is not None})))
    return rows, cuts


def bagged_forest(
    train: DataFrame, label: str, features: Sequence[str], row_id: Sequence[str], trees: int = 200, depth: int = 8, bins: int = 32,
    indicators: Sequence[str] = (), some: int | None = None, least: float = 1.0, seed: int = 0,
) -> Ensemble:
    """Trees over Poisson-bagged rows, split by Gini decrease; a leaf's value is its share of class 1.

    Bags are functions of the row ids, so a recomputed task draws the same. ``indicators`` are 0/1 columns, ``some`` the number of
    features that a node may choose from. Rows without a label are left out; missing numbers go left. No rows give trees of value 0.
    """
    rows, cuts = _prepared(train, label, features, row_id, bins, indicators, seed)
    at_once = max(1, CELLS // (2 ** (depth - 1) * max(len(features), 1) * (bins + 1)))
    grown: list[Tree] = []
    for start in range(0, trees, at_once):
        numbers = range(start, min(start + at_once, trees))

        def bag(x: np.ndarray, y: np.ndarray, state) -> tuple[np.ndarray, np.ndarray]:
            pair = np.array(state.to_pylist(), np.int64).reshape(-1, 2)
            w = POISSON_TABLE.take(draws16(pair[:, 0], pair[:, 1], numbers[-1] + 1)[:, numbers[0] :])
            return w * y[:, None], w

        grown += _grow(rows, cuts, depth, numbers, bag, some, 0.0, least, 1.0)
    return Ensemble(tuple(features), tuple(grown), False)


def boosted_forest(
    train: DataFrame, label: str, features: Sequence[str], row_id: Sequence[str], rounds: int = 100, depth: int = 3, step: float = 0.1, bins: int = 32,
    indicators: Sequence[str] = (), penalty: float = 1.0, least: float = 1e-3, seed: int = 0,
) -> Ensemble:
    """Trees fitted one after another to the gradient of the log loss, leaves by a Newton step; one pass per round and level."""
    rows, cuts = _prepared(train, label, features, row_id, bins, indicators, seed)
    n, share = rows.agg(F.count("*"), F.avg("_y")).first()
    base = math.log(share / (1 - share)) if n and 0 < share < 1 else 0.0
    grown: list[Tree] = []
    for k in range(rounds if n else 0):
        so_far = Ensemble(tuple(features), tuple(grown), True, base)

        def residual(x: np.ndarray, y: np.ndarray, state) -> tuple[np.ndarray, np.ndarray]:
            p = so_far.score(x)
            return (y - p)[:, None], (p * (1 - p))[:, None]

        grown += _grow(rows, cuts, depth, [k], residual, None, penalty, least, step)
    return Ensemble(tuple(features), tuple(grown), True, base)


def importance_table(model: Ensemble, like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(model.importances(), "feature string, importance double, rank int")
