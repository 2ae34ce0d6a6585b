"""Near copies by order MinHash.

A text is the sequence of its five-word shingles, each labelled with how many equal ones came
before it. Every one of ``SKETCHES`` hash functions picks the ``TUPLE`` shingles with the smallest
values and keeps them in text order; texts with an equal tuple are candidates, which is sensitive to the
order of the text and so to edits. Candidates are verified by a banded alignment of their shingle sequences:
similarity is the length of the longest common subsequence over that of the union.

Equal texts are one text from the start. Within a bucket of candidates a few leaders meet all others. What then is left of
buckets that are not connected meets by rare shingles: texts as alike as asked share one among their rarest, so texts
that have only a common passage in common never meet, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD_RE, stage, text_of

WORDS = 5
SKETCHES = 24
TUPLE = 4
SIMILARITY = 0.8
#: Of ``SKETCHES`` first minima so many must agree before texts are aligned; at similarity 0.8 fewer do once in millions of pairs.
AGREE = 8
#: The smallest shingle hashes of a text that are kept to estimate similarity before texts are fetched, and how far (in standard
#: deviations at similarity 0.8) an estimate may fall short.
LOWEST = 128
DEVIATIONS = 5.0
LEADERS = 3
_ODD = np.array([xxhash.xxh64_intdigest(b"order-minhash", seed=i) | 1 for i in range(SKETCHES)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words, remembered while there are at most ``size``."""

    def __init__(self, size: int = 500_000) -> None:
        self.size, self.known = size, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.size:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the labelled five-word shingles in text order; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(WORDS, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : n - k + 1 + i]) * _STEP
    out = _mixed(out + np.uint64(n if n < WORDS else 0))
    order = np.argsort(out, kind="stable")
    ordered = out[order]
    same = ordered[1:] == ordered[:-1]
    if same.any():
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        nth = np.arange(len(out)) - np.repeat(starts, np.diff(np.append(starts, len(out))))
        out[order] = _mixed(ordered + _STEP * nth.astype(np.uint64))
    return out


def sketch(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one key per sketch, the first minimum of each, 32 bits)."""
    n = len(seq)
    values = seq[None, :] * _ODD[:, None]
    if n > TUPLE:
        at = np.argpartition(values, TUPLE - 1, axis=1)[:, :TUPLE]
        least = np.take_along_axis(values, at, 1).min(1)
        at.sort(axis=1)
    else:
        at = np.tile(np.arange(n), (SKETCHES, 1))
        least = values.min(1)
    keys = _ODD.copy()
    for j in range(at.shape[1]):
        keys = _mixed((keys ^ seq[at[:, j]]) * _STEP)
    return keys.view(np.int64), (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _increasing(positions: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if not len(positions) or (np.diff(positions) > 0).all():
        return len(positions)
    import bisect

    tails: list[int] = []
    for p in positions.tolist():
        i = bisect.bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Longest common subsequence over union of two shingle sequences; 0.0 where it is below ``least``.

    Labels make the shingles of a text distinct, so common ones are pairs of positions and the longest
    increasing run of them is the alignment. Positions further apart than ``least`` allows are outside the band.
    """
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m) or not n:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least * (n + m - len(i)):
        return 0.0
    # common subsequence c with c / (n + m - c) >= least leaves at most so many unmatched on one side
    band = n + m - 2 * int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    inside = np.abs(i - j) <= band
    order = np.argsort(i[inside])
    common = _increasing(j[inside][order])
    found = common / (n + m - common)
    return found if found >= least - 1e-12 else 0.0


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text), n (shingles), keys, mins, low for every document, whole texts."""

    def batches(frames: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in frames:
            keys, mins, sizes, lows = [], [], [], []
            for text in batch.column(2):
                seq = shingles(hashes(WORD_RE.findall(text.as_py())))
                k, m = sketch(seq) if len(seq) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                keys.append(k)
                mins.append(m)
                sizes.append(len(seq))
                lows.append((np.sort(seq)[:LOWEST] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int32())), pa.array(lows, pa.binary())],
                names=["doc_id", "node", "n", "keys", "mins", "low"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text_of()).alias("node"), text_of().alias("text"))
    return slim.mapInArrow(batches, "doc_id bigint, node string, n bigint, keys array<bigint>, mins array<int>, low binary")


def likely(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether two texts can have this similarity, by their smallest shingle hashes.

    Up to the smaller of the last values of cut lists both sets are known in full: an even sample of the union, or all of it.
    """
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    last = min((v[-1] for v in (x, y) if len(v) == LOWEST), default=None)
    if last is not None:
        x, y = x[x <= last], y[y <= last]
    union = len(np.union1d(x, y))
    slack = 0.01 if last is None else DEVIATIONS * np.sqrt(least * (1 - least) / max(1, union))
    return len(np.intersect1d(x, y)) >= (least - slack) * union


def _verified(pairs: DataFrame, sides: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs that pass the minima and the smallest hashes, and then the alignment of their whole texts."""
    spark = pairs.sparkSession
    both = pairs.join(sides.toDF("a", "n_a", "mins_a", "low_a"), "a").join(sides.toDF("b", "n_b", "mins_b", "low_b"), "b")
    agree = F.size(F.filter(F.zip_with("mins_a", "mins_b", lambda x, y: x == y), lambda x: x))
    near = both.filter((F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")) & (agree >= AGREE)).select("a", "b", "low_a", "low_b")

    def estimate(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in frames:
            keep = [likely(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = stage(near.mapInArrow(estimate, "a string, b string"), "near-candidates")
    if near.isEmpty():
        return spark.createDataFrame([], "a string, b string, similarity double")
    ends = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "node")
    wanted = texts.join(ends, "node", "left_semi")

    def align(frames: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in frames:
            found = []
            last, seq = None, None
            for key, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if key != last:
                    last, seq = key, shingles(hashes(WORD_RE.findall(x.as_py())))
                found.append(similarity(seq, shingles(hashes(WORD_RE.findall(y.as_py())))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    text_a, text_b = wanted.toDF("a", "text_a"), wanted.toDF("b", "text_b")
    joined = near.select("a", "b").join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(align, "a string, b string, similarity double").filter("similarity > 0")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a < b, similarity of different texts that are near copies: enough of them to connect all that are.

    In each bucket the texts that meet most others come first, as the source of many copies does. The first few are compared
    with all others of the bucket. What follows are the texts of buckets that still hold two components: those of different
    components that share one of their rarest shingles are compared.
    """
    spread = nodes.filter("n > 0").select("node", F.posexplode("keys").alias("sketch", "key"))
    spread = spread.select("node", F.xxhash64("sketch", "key").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = stage(spread.join(shared, "key"), "near-buckets")
    many = met.groupBy("node").agg(F.sum(F.col("size") - 1).alias("many"))
    order = F.struct((-F.col("many")).alias("few"), "node")
    # what the rounds need of the texts in buckets, fetched once
    sides = stage(nodes.join(many, "node", "left_semi").select("node", "n", "mins", "low"), "near-sides")
    ours = nodes.join(many, "node", "left_semi").select("node", F.col("doc_id").alias("id"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("own_id"), F.md5(text_of()).alias("digest"), text_of().alias("text"))
    # one document stands for all with its text
    met_texts = rows.join(ours, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("node")))
    texts = stage(met_texts.select("node", "text").dropDuplicates(["node"]), "near-texts")
    left = stage(met.join(many, "node").select("key", order.alias("turn")), "near-ordered")
    first = Window.partitionBy("key").orderBy("turn")
    heads = left.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= LEADERS)
    heads = stage(heads.select("key", F.col("turn").alias("head")), "near-leaders")
    pairs = left.join(heads, "key").filter(F.col("turn") > F.col("head")).select(
        F.least("turn.node", "head.node").alias("a"), F.greatest("turn.node", "head.node").alias("b")
    )
    led = stage(_verified(pairs.distinct(), sides, texts), "near-links")
    rest = left.join(heads.select("key", F.col("head").alias("turn")), ["key", "turn"], "left_anti").select("key", F.col("turn.node").alias("node"))
    rest = stage(rest.join(components(led), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-rest")
    apart = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    open_ = stage(rest.join(apart, "key", "left_semi").select("node", "root").distinct(), "near-left")
    if open_.isEmpty():
        return led
    others = _verified(rare_pairs(open_, texts), sides, texts)
    return led.union(stage(others, "near-links")).dropDuplicates(["a", "b"])


def rare_pairs(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """a < b: every pair of these texts (node, root) of different roots whose shingle sets can be similar, once.

    Sets as similar as ``SIMILARITY`` share one of their rarest elements, among a fifth of the larger set and a ninth of the
    smaller one, and the first that they share leaves enough behind it in both (prefix and position filter of
    set joins, without loss). Shingles of a passage that many texts have are not rare, so they pair no one unless they are most of both.
    """

    def sets(frames: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in frames:
            # the list of a text at a time: what a task holds is bounded by its longest text
            for i, text in enumerate(batch.column(1)):
                seq = shingles(hashes(WORD_RE.findall(text.as_py()))).view(np.int64)
                mine = [pa.array([batch.column(0)[i].as_py()] * len(seq), pa.int64()), pa.array([len(seq)] * len(seq), pa.int64()), pa.array(seq)]
                yield pa.RecordBatch.from_arrays(mine, names=["id", "n", "shingle"])

    ours = open_.select("node", "root", F.xxhash64("node").alias("id"))
    spread = texts.join(ours, "node").select("id", "text").mapInArrow(sets, "id bigint, n bigint, shingle bigint")
    held = spread.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).filter("df > 1")
    # what a text has alone is rarest of all: it takes the first places
    of_text = held.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    longest = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1 - alone
    near_first = of_text.filter(longest > 0).select("id", "n", alone.alias("alone"), "shared", longest.cast("int").alias("longest"))
    firsts = near_first.select("id", "n", "alone", F.posexplode(F.slice("shared", 1, F.col("longest"))).alias("at", "it"))
    firsts = firsts.select("id", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("behind"), F.col("it.shingle").alias("shingle"))
    firsts = stage(firsts.join(ours, "id").select("node", "root", "n", "behind", "shingle"), "near-rare")
    small, large = (firsts.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "behind")]) for x in "sl")
    needed = SIMILARITY / (1 + SIMILARITY)
    small = small.filter(F.col("behind_s") >= 2 * needed * F.col("n_s") - 1e-9)
    sizes = (F.struct("n_s", "node_s") < F.struct("n_l", "node_l")) & (F.col("n_s") >= SIMILARITY * F.col("n_l") - 1e-9)
    enough = F.least("behind_s", "behind_l") >= needed * (F.col("n_s") + F.col("n_l")) - 1e-9
    met = small.join(large, "shingle").filter(sizes & enough & (F.col("root_s") != F.col("root_l")))
    return met.select(F.least("node_s", "node_l").alias("a"), F.greatest("node_s", "node_l").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): the smallest node it is connected to.

    Each round takes the smallest root among the neighbours and then the root's root, so long chains
    shorten by halves. Nothing but one flag a round reaches the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "near-edges")
    roots = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "near-roots")
    while True:
        heard = both.join(roots.toDF("other", "heard"), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        lower = roots.join(heard, "node").select("node", "root", F.least("root", "heard").alias("next"))
        lower = stage(lower, "near-lower")
        jumped = lower.join(lower.select(F.col("node").alias("next"), F.col("next").alias("over")), "next", "left")
        new = stage(jumped.select("node", "root", F.least("next", F.coalesce("over", "next")).alias("next")), "near-roots")
        changed = new.filter("next <> root")
        roots = new.select("node", F.col("next").alias("root"))
        if changed.isEmpty():
            return roots


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches of all documents; node, doc_id, n_equal, n, root, n_links of every different text)."""
    rows = stage(sketches(docs), "near-sketches")
    nodes = stage(
        rows.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("n_equal"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("mins").alias("mins"), F.first("low").alias("low"),
        ), "near-nodes",
    )
    edges = stage(links(docs, nodes), "near-all-links")
    roots = components(edges)
    degree = edges.select("a").union(edges.select("b")).groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "node")
    placed = nodes.select("node", "doc_id", "n_equal", "n").join(roots, "node", "left").join(degree, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    return rows, placed


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_equal for every document.

    class_id is the smallest doc_id among all documents connected by equality or by links of similarity
    0.8 or more; n_links counts the different texts that the document's text was found to be near when the classes were
    made, n_equal the documents with its text, itself included. Null and empty texts, and texts of white space only, are in classes of their own. Repeated rows are
    equal texts. Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    rows, placed = _placed(docs)
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    of_node = placed.join(smallest, "root").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_equal")
    of_node = stage(of_node, "near-classes")
    out = rows.select("doc_id", "node", "n").join(of_node, "node")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links",
        F.when(alone, F.lit(1)).otherwise(F.col("n_equal")).cast("bigint").alias("n_equal"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """doc_id, node: one document of each class, the one with the smallest id and then the smallest digest of its text.

    Null ids come last, so one of them survives only where a class has no other. Texts without a word are in
    classes of their own. Rows equal in id and text are one document.
    """
    rows, placed = _placed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    leads = placed.filter("n > 0").groupBy("root").agg(F.min(order).alias("lead")).select("lead.doc_id", "lead.node")
    return leads.union(rows.filter("n = 0").select("doc_id", "node").distinct())
