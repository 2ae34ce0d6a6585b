"""SentencePiece encoding and decoding as a relational lattice.

The normalised text is cut wherever no piece of the model spans the cut, so a best segmentation of
the parts is one of the text. Each distinct part is encoded once: its substrings up to the longest piece are
exploded and joined to the piece table, the matches are the edges of a lattice, and a fold over the
part's positions keeps the best way to each (Viterbi). The lattice of a part has many rows with the part as their key, so
parts longer than a bound, such as a run of one letter, are folded within a task, with the scores of the last positions only. Characters outside the table become byte pieces.

The lattice is made of the most frequent parts, a bounded number, and their ids are sent to all tasks. A task folds the other
parts where they occur, by the same rules and many of them side by side, so neither texts nor parts cross a shuffle to meet their ids.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import parallelism
from .common import kept, most_frequent, stage, text_of

SPACE = "▁"
#: Parts sent to every task: at most so many, each of at most ``FREQUENT_CHARS`` characters.
FREQUENT = 1 << 17
FREQUENT_CHARS = 48
#: Longer parts are folded within a task, position by position.
LATTICE_CHARS = 48
#: Bytes of words and their ids that a Python process remembers.
MEMORY = 48 << 20
#: Characters of texts whose new words are learned together.
TOGETHER = 1 << 19
#: Words that are cut, and parts that are folded, side by side.
SIDE_BY_SIDE = 1 << 14
#: As the library does: an unknown character costs this much more than the rarest piece.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """Pieces by id; ``kinds``: n normal, b byte, c control or unknown."""

    names: tuple[str, ...]
    kinds: str
    longest: int

    def __reduce__(self) -> tuple:
        # what can be derived does not travel with the tasks
        return Pieces, (self.names, self.kinds, self.longest)

    def score(self, place: int) -> float:
        """Log-probability of the place-th normal piece, by Zipf's law for a table in order of frequency."""
        return -math.log(place + 2.0)

    @functools.cached_property
    def normal(self) -> dict[str, tuple[int, float]]:
        ids = [i for i, k in enumerate(self.kinds) if k == "n"]
        return {self.names[i]: (i, self.score(place)) for place, i in enumerate(ids)}

    @functools.cached_property
    def starts(self) -> dict[str, tuple[int, float] | None]:
        """Every beginning of a normal piece; its id and score where it is one."""
        return self.beginnings()

    def beginnings(self) -> dict[str, tuple[int, float] | None]:
        return {p[:i]: None for p in self.normal for i in range(1, len(p))} | self.normal

    @functools.cached_property
    def unknown(self) -> float:
        return min(s for _, s in self.normal.values()) - UNKNOWN_PENALTY

    @functools.cached_property
    def byte_ids(self) -> list[int]:
        found = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == "b"}
        return [found[b] for b in range(256)]

    @functools.cached_property
    def told(self) -> tuple[list[str], np.ndarray]:
        """(what each id stands for by itself, the byte of each byte piece, -1 for others)."""
        codes = np.array([int(n[3:5], 16) if k == "b" else -1 for n, k in zip(self.names, self.kinds)], np.int16)
        return [n if k == "n" else chr(c) if 0 <= c < 0x80 else "" for n, k, c in zip(self.names, self.kinds, codes.tolist())], codes

    @functools.cached_property
    def key(self) -> str:
        return hashlib.md5("\0".join((*self.names, self.kinds)).encode("utf-8", "surrogatepass")).hexdigest()


@functools.lru_cache(2)
def load(path: str) -> Pieces:
    """Piece table of a SentencePiece model file with byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = "".join("b" if sp.is_byte(i) else "c" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n" for i in range(n))
    names = tuple(sp.id_to_piece(i) for i in range(n))
    return Pieces(names, kinds, max(len(p) for p, k in zip(names, kinds) if k == "n"))


_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def chunks(text: str | None) -> list[str]:
    """The normalised text (a leading space, spaces as the space mark) cut before each run of spaces."""
    return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


def words_of(text: str | None) -> list[str]:
    """The chunks without the space mark that each of them begins with."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " ":
        return [c[1:] for c in chunks(text)]
    return text.split(" ")


class Trie:
    """The beginnings of the normal pieces as numbered states: cuts words and folds parts, many side by side.

    Holds arrays only, a few megabytes, as a Python process keeps it from task to task.
    """

    def __init__(self, pieces: Pieces) -> None:
        starts = pieces.beginnings()
        # states that lead on come first, those that do to several at the front; 0 is none, and no beginning
        inner = Counter(p[:-1] for p in starts if len(p) > 1)
        state = {p: i for i, p in enumerate(sorted(starts, key=lambda p: -min(inner[p], 2)), 1)}
        self.inner, self.forks = len(inner) + 1, sum(n > 1 for n in inner.values()) + 1
        letters = sorted({c for p in inner for c in p} | {p[-1] for p in starts if len(p) > 1})
        place = {c: i for i, c in enumerate(letters, 1)}
        # characters beyond the last one in a piece are as good as that place
        self.end = max(ord(p[-1]) for p in starts) + 1
        self.letters = np.zeros(self.end + 1, np.uint16)
        self.letters[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = np.min_scalar_type(len(state))
        self.first = np.zeros(self.end + 1, number)
        self.next = np.zeros((self.forks, len(letters) + 1), number)
        self.only, self.after = np.zeros(self.inner, np.uint16), np.zeros(self.inner, number)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        self.ids = np.full(len(state) + 1, -1, np.int32)
        self.scores = np.full(len(state) + 1, pieces.unknown)
        for p, i in state.items():
            if len(p) == 1:
                self.first[ord(p)] = i
            else:
                if (before := state[p[:-1]]) < self.forks:
                    self.next[before, place[p[-1]]] = i
                else:
                    self.only[before], self.after[before] = place[p[-1]], i
                self.beside[place[p[-2]], place[p[-1]]] = True
            if starts[p] is not None:
                self.ids[i], self.scores[i] = starts[p]

    def _follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        fork = state < self.forks
        return np.where(fork, self.next[state * fork, letter], self.after[state] * (self.only[state] == letter))

    def _places(self, texts: list[str]) -> np.ndarray:
        return np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), self.end)

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(parts of all words behind a space mark, how many of each): cut between characters that no piece has side by side."""
        chunks = [SPACE + w for w in words]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        letters = self.letters[self._places(chunks)]
        new = np.ones(len(letters) + 1, bool)
        new[1:-1] = ~self.beside[letters[:-1], letters[1:]]
        new[ends - sizes] = True
        at = np.flatnonzero(new)
        edges, text = at.tolist(), "".join(chunks)
        return [text[a:b] for a, b in zip(edges, edges[1:])], np.diff(np.searchsorted(at, np.append(0, ends)))

    def fold(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in turn, how many of each), as ``fold_part`` gives them; one position of all parts per step."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        text = self._places(parts)
        letters = self.letters[text]
        # the longest first, so that the parts that reach a position are the first ones
        order = np.argsort(-sizes, kind="stable")
        size = sizes[order]
        char = (np.cumsum(sizes) - sizes)[order]
        node = char + order
        scores = np.full(len(text) + len(parts), -np.inf)
        back, ids = np.zeros(len(scores), np.int32), np.zeros(len(scores), np.int32)
        scores[node] = 0.0

        def offer(ends: np.ndarray, score: np.ndarray, depth: int, state: np.ndarray) -> None:
            better = score >= scores[ends]
            ends = ends[better]
            scores[ends], back[ends], ids[ends] = score[better], depth, self.ids[state[better]]

        for k in range(int(size[0]) if len(parts) else 0):
            reached = int(np.searchsorted(-size, -k))
            at, to, left = char[:reached] + k, node[:reached] + k, size[:reached] - k
            so_far, state = scores[to], self.first[text[at]]
            offer(to + 1, so_far + self.scores[state], 1, state)
            depth = 1
            while True:
                on = np.flatnonzero((state > 0) & (state < self.inner) & (left > depth))
                if not len(on):
                    break
                at, to, left, so_far = at[on], to[on], left[on], so_far[on]
                state = self._follow(state[on], letters[at + depth])
                depth += 1
                hit = np.flatnonzero(self.ids[state] >= 0)
                offer(to[hit] + depth, so_far[hit] + self.scores[state[hit]], depth, state[hit])
        # the ways back, the last piece of every part first
        rows, begin, to, steps = order, node, node + size, []
        while len(rows):
            steps.append((rows, ids[to]))
            to = to - back[to]
            on = np.flatnonzero(to > begin)
            rows, begin, to = rows[on], begin[on], to[on]
        counts = np.zeros(len(parts), np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        last = np.cumsum(counts) - 1
        out = np.zeros(int(counts.sum()), np.int32)
        for k, (rows, found) in enumerate(steps):
            out[last[rows] - k] = found
        return out, counts


def trie(pieces: Pieces) -> Trie:
    """The trie of this Python process."""
    return kept(f"trie {pieces.key}", lambda: Trie(pieces))


def _some(items: list, size: int) -> Iterator[list]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def part_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """part, n: how often each part occurs in the whole texts; counted within tasks before the shuffle."""

    def batches(frames: Iterator) -> Iterator:
        import pyarrow as pa

        cut = trie(pieces).cut
        # counts of few texts at a time: Spark adds them up before the shuffle
        for batch in _slices(frames, 2500):
            found: Counter = Counter()
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
            parts: dict[str, int] = {}
            so_far = parts.get
            for words in _some(list(found), SIDE_BY_SIDE):
                cuts, of = cut(words)
                for part, n in zip(cuts, np.repeat([found[w] for w in words], of).tolist()):
                    parts[part] = so_far(part, 0) + n
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.string()), pa.array(parts.values(), pa.int64())], ["part", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(batches, "part string, n bigint")
    return rows.groupBy("part").agg(F.sum("n").alias("n"))


def fold_part(pieces: Pieces, part: str) -> np.ndarray:
    """Ids of the best segmentation, -1 for a character without a piece, as the lattice gives them.

    Time grows with the length; ties go to the shorter last piece, as the later starts are tried later.
    """
    known, unknown, n = pieces.starts.get, (-1, pieces.unknown), len(part)
    scores, sizes, ids = array("d", [-math.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
    scores[0] = 0.0
    for start in range(n):
        so_far, end = scores[start], start + 1
        hit = known(part[start:end], unknown)
        deeper = hit is not unknown
        if hit is None:
            hit = unknown
        while True:
            if hit is not None and so_far + hit[1] >= scores[end]:
                scores[end], sizes[end], ids[end] = so_far + hit[1], end - start, hit[0]
            end += 1
            if not deeper or end > n:
                break
            hit = known(part[start:end], unknown)
            if hit is unknown:
                break
    out, at = [], n
    while at:
        out.append(ids[at])
        at -= sizes[at]
    return np.array(out[::-1], np.int32)


def encode_parts(parts: DataFrame, pieces: Pieces) -> DataFrame:
    """Add ids, the best segmentation of each distinct part.

    The table of pieces is as large as the model file, so it is broadcast. The parts of the lattice are dealt out by part
    and stay where they are: the lattice is grouped by part again. Ties go to the shorter last piece, then the smaller id.
    """
    spark = parts.sparkSession
    counted = stage(parts.select("part", "n"), "piece-counts")

    def folded(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _slices(frames, 50):
            ids = [fold_part(pieces, p.as_py()) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["part", "n", "ids"])

    long = counted.filter(F.length("part") > LATTICE_CHARS).repartition(parallelism(spark), "part").mapInArrow(folded, "part string, n bigint, ids array<int>")
    # each part becomes some fifty substrings in the same task, so there are many small tasks
    parts = counted.filter(F.length("part") <= LATTICE_CHARS).repartition(4 * parallelism(spark), "part")
    rows = [(p, i, s) for p, (i, s) in pieces.normal.items()]
    lookup = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double"))
    start = F.expr(f"explode(sequence(1, length(part)))")
    placed = parts.select("part", "n", start.alias("start"))
    spread = placed.select("part", "n", "start", F.explode(F.expr(f"sequence(1, least({pieces.longest}, length(part) - start + 1))")).alias("size"))
    edges = spread.withColumn("piece", F.substring("part", F.col("start"), F.col("size"))).join(lookup, "piece", "left")
    # a character without a piece of its own is an edge too; its id is -1
    edges = edges.filter(F.col("id").isNotNull() | (F.col("size") == 1))
    edge = F.struct(
        (F.col("start") - 1).alias("from"), "size", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(pieces.unknown)).alias("score")
    )
    ends = edges.groupBy("part", "n", (F.col("start") + F.col("size") - 1).alias("end")).agg(F.collect_list(edge).alias("edges"))
    words = ends.groupBy("part", "n").agg(F.array_sort(F.collect_list(F.struct("end", "edges"))).alias("ends"))
    # scores: best way to each of the last positions; ways: the last edge of the best way to every position
    fold = f"""aggregate(ends, named_struct('scores', array(0D), 'ways', CAST(array() AS array<struct<s: double, size: int, id: int>>)),
      (acc, e) -> named_struct(
        'scores', slice(concat(acc.scores, array(array_max(transform(e.edges, x -> element_at(acc.scores, -x.size) + x.score)))),
                        greatest(1, size(acc.scores) + 2 - {pieces.longest + 1}), {pieces.longest + 1}),
        'ways', concat(acc.ways, array(array_max(transform(e.edges, x ->
            named_struct('s', element_at(acc.scores, -x.size) + x.score, 'size', -x.size, 'id', -x.id)))))),
      acc -> acc.ways)"""
    walk = """aggregate(sequence(1, size(ways)), named_struct('at', size(ways), 'ids', CAST(array() AS array<int>)),
      (acc, i) -> IF(acc.at = 0, acc, named_struct('at', acc.at + element_at(ways, acc.at).size,
        'ids', concat(acc.ids, array(-element_at(ways, acc.at).id)))),
      acc -> reverse(acc.ids))"""
    best = words.select("part", "n", F.expr(fold).alias("ways")).select("part", "n", F.expr(walk).alias("ids"))
    return best.union(long)


def _slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches of at most so many rows: what Python holds of a batch is bounded by a few texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _as_bytes(pieces: Pieces, part: str, ids: list[int]) -> list[int]:
    """Unknown characters (-1) replaced by their byte pieces."""
    if -1 not in ids:
        return ids
    out, at = [], 0
    for i in ids:
        if i == -1:
            out += [pieces.byte_ids[b] for b in part[at].encode("utf-8", "surrogatepass")]
            at += 1
        else:
            out.append(i)
            at += len(pieces.names[i])
    return out


class IdsOfWords:
    """Little-endian 32-bit ids of texts; each word's are remembered while memory lasts. ``frequent``: ids of parts at hand."""

    def __init__(self, pieces: Pieces, frequent: dict[str, bytes]) -> None:
        self.pieces, self.frequent, self.trie = pieces, frequent, trie(pieces)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _fold(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts; long ones are folded one by one."""
        short = [p for p in parts if len(p) <= LATTICE_CHARS]
        flat, counts = self.trie.fold(short)
        raw, ends = flat.astype("<i4").tobytes(), np.cumsum(counts)
        odd = set(np.searchsorted(ends, np.flatnonzero(flat < 0), "right").tolist())
        starts, ends, at = (4 * (ends - counts)).tolist(), (4 * ends).tolist(), 0
        for part in parts:
            if len(part) > LATTICE_CHARS:
                yield self._bytes(part, fold_part(self.pieces, part))
                continue
            ids = raw[starts[at] : ends[at]]
            yield self._bytes(part, np.frombuffer(ids, "<i4")) if at in odd else ids
            at += 1

    def _bytes(self, part: str, ids: np.ndarray) -> bytes:
        return np.array(_as_bytes(self.pieces, part, ids.tolist()), "<i4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if self.held > MEMORY // 2:
            # words not met again while the next half fills are forgotten
            self.older, self.known, self.held = self.known, {}, 0
        known, at_hand, join = self.known, self.frequent.get, b"".join
        missing = list(words.difference(known))
        met = list(map(self.older.get, missing))
        known.update((w, ids) for w, ids in zip(missing, met) if ids is not None)
        for new in _some([w for w, ids in zip(missing, met) if ids is None], SIDE_BY_SIDE):
            parts, counts = self.trie.cut(new)
            ids = list(map(at_hand, parts))
            rare = list(dict.fromkeys(p for p, i in zip(parts, ids) if i is None))
            folded = dict(zip(rare, self._fold(rare)))
            ids = [folded[p] if i is None else i for p, i in zip(parts, ids)]
            edges = [0, *np.cumsum(counts).tolist()]
            known.update(zip(new, [join(ids[a:b]) for a, b in zip(edges, edges[1:])]))
        # a key, a value and their place in the table take about 220 bytes beside what they hold
        self.held += 4 * sum(map(len, missing)) + 220 * len(missing)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of every text in turn; short texts learn their new words together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(words_of(text))
            size += len(text or "")
            if size > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, lists: list[list[str]]) -> Iterator[bytes]:
        self._learn(set().union(*lists))
        ids = self.known.__getitem__
        for words in lists:
            yield b"".join(map(ids, words))


def encode(docs: DataFrame, model: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ids (array of int) of every whole text; null and empty texts have no ids.

    ``carry`` may not include the text. Repeated rows and ids are kept, as every row is encoded where it is; the texts cross no
    shuffle. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = load(model)
    counts = stage(part_counts(docs, pieces), "piece-all-counts")
    top = encode_parts(most_frequent(counts.filter(F.length("part") <= FREQUENT_CHARS), "n", FREQUENT), pieces).select("part", "ids").toArrow()
    at_hand = zip(top["part"].to_pylist(), top["ids"].to_pylist())
    frequent = spark.sparkContext.broadcast({p: np.array(_as_bytes(pieces, p, i), "<i4").tobytes() for p, i in at_hand})

    def assemble(frames: Iterator) -> Iterator:
        import pyarrow as pa

        words, n = IdsOfWords(pieces, frequent.value), len(carry)
        for batch in _slices(frames):
            found = list(words.encode_all(text.as_py() for text in batch.column(n)))
            ends = np.cumsum([0] + [len(ids) // 4 for ids in found]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [lists], names=[*carry, "ids"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    whole = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(carry)], text_of().alias("text"))
    return whole.mapInArrow(assemble, f"{fields}, ids array<int>")


def decode_ids(pieces: Pieces, ids: list[int] | np.ndarray) -> str:
    """Text of ids: pieces side by side, bytes as UTF-8, space marks as spaces, without the leading one."""
    told, codes = pieces.told
    ids = np.asarray(ids, np.int64)
    high = np.flatnonzero(codes[ids] >= 0x80)
    out: list[str] = []
    at = 0
    # bytes beyond ASCII are read together with their neighbours, all else stands for itself
    for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1) if len(high) else ():
        out += map(told.__getitem__, ids[at : run[0]].tolist())
        out.append(codes[ids[run]].astype(np.uint8).tobytes().decode("utf-8", "replace"))
        at = run[-1] + 1
    out += map(told.__getitem__, ids[at:].tolist())
    return "".join(out).replace(SPACE, " ")[1:]


def decode(encoded: DataFrame, model: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ids and text: the ids turned back; no ids give the empty text."""
    pieces = load(model)

    def batches(frames: Iterator) -> Iterator:
        import pyarrow as pa

        last = len(carry)
        for batch in _slices(frames):
            texts = [decode_ids(pieces, ids.values.to_numpy()) if ids.is_valid else "" for ids in batch.column(last)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*carry, "ids", "text"])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry)
    return encoded.select(*carry, "ids").mapInArrow(batches, f"{fields}, ids array<int>, text string")
