"""Documents packed into sequences of at most ``capacity`` tokens, as few as best fit finds.

Pieces differ in nothing but their length, so the packing is planned on the counts per length and not on the pieces: at
most ``capacity`` numbers reach the driver, however many documents there are. The plan takes the lengths above a third of the
capacity first, of which a sequence holds two at most: the longest is matched with the longest partner that fits, which
gives as many pairs as any matching. Shorter pieces then go, longest first, into the smallest gap that takes them.
A run of the plan says where the n-th piece of a length goes. Every piece's number among those of its length comes from
its task's own count and the counts of the tasks before, so no task sees all pieces of a length.
"""

from __future__ import annotations

import bisect
import collections
import functools
import itertools
import json
import operator
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import kept, slices, stage

CAPACITY = 4096
END_ID = 1
#: Bytes of words and their ids that a Python process remembers.
MEMORY = 256 << 20
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: A piece's number among the pieces of its length stays below 2^48.
_RANK_BITS = 48


#: Characters that normalization leaves alone or lower-cases one by one, and that are letters, digits or signs for sure.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017e"
_ODD = re.compile("[^!-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u012f\u0131-\u017e\u2010-\u2027\u20ac]")
#: The tokenizer's own cutting of such lower-cased text, and the space between words.
_PARTS = re.compile(rf"[{_LETTERS}]+| |'(?:[stmd]|re|ve|ll)|[0-9]|[^{_LETTERS}0-9 ]+")
_BETWEEN = b"\xff" * 4
_CUTTING = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


@functools.lru_cache(1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _cuts_as_known(tokenizer) -> bool:
    """Whether ``_PARTS`` is how the tokenizer cuts plain words."""
    made = json.loads(tokenizer.to_str())
    before, cutting = ((made[k] or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    kinds = [x["type"] for x in before], [x["type"] for x in cutting]
    if kinds != _CUTTING[1:] or any(x["normalized"] for x in made["added_tokens"]) or made["post_processor"] or made["model"]["type"] != "BPE" or made["model"]["dropout"]:
        return False
    blanks = before[1]["pattern"] == {"Regex": "\\s+"} and before[1]["content"] == " "
    split = cutting[0]["pattern"] == {"Regex": _CUTTING[0]} and cutting[0]["behavior"] == "Removed" and cutting[0]["invert"]
    return blanks and split and not cutting[1]["add_prefix_space"] and not cutting[1]["use_regex"]


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class IdBytes:
    """Little-endian 32-bit ids of texts; each word's are remembered while memory lasts.

    Holds for tokenizers that drop white space, where the ids of a text are those of its words in turn.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model if _cuts_as_known(self.tokenizer) else None
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        size = max(self.tokenizer.get_vocab().values()) + 1
        raw = np.arange(size, dtype="<u4").tobytes()
        self.codes = [raw[at : at + 4] for at in range(0, 4 * size, 4)]
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {" ": _BETWEEN}
        self.held = self.held_parts = 0

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words that are not known."""
        if self.held > MEMORY // 2:
            # words not met again while the next half fills are forgotten
            self.older, self.known, self.held = self.known, {}, 0
        got = list(map(self.older.get, words))
        places = [k for k, ids in enumerate(got) if ids is None]
        if places:
            joined = b" ".join([words[k] for k in places]).decode("utf-8", "replace")
            texts, special = joined.split(" "), [x for x in self.special if x in joined]
            search = _ODD.search
            odd = [not (t.isascii() and t.isprintable()) and search(t) is not None for t in texts] if self.model else [True] * len(texts)
            if special:
                odd = [x or any(y in t for y in special) for x, t in zip(odd, texts)]
            for kind, ids in ((False, self._plain), (True, self._whole)):
                which = [k for k, x in zip(places, odd) if x is kind]
                if which:
                    for k, found in zip(which, ids([t for t, x in zip(texts, odd) if x is kind])):
                        got[k] = found
        self.known.update(zip(words, got))
        # a key, a value and their place in the table take about 200 bytes beside what they hold
        self.held += sum(map(len, words)) + sum(map(len, got)) + 200 * len(words)
        return got

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of words of plain characters: the model is given each of their parts once."""
        if self.held_parts > MEMORY // 4:
            self.parts, self.held_parts = {" ": _BETWEEN}, 0
        found = _PARTS.findall(" ".join(texts).lower())
        codes, letters, tokenize = self.codes, self.letters, self.model.tokenize
        new = list(set(found).difference(self.parts))
        spelt = [part if part.isascii() else part.encode().decode("latin-1").translate(letters) for part in new]
        ids = [b"".join([codes[token.id] for token in tokenize(x)]) for x in spelt]
        self.parts.update(zip(new, ids))
        self.held_parts += sum(map(len, new)) + sum(map(len, ids)) + 200 * len(new)
        # no id has four bytes of ones
        return b"".join(map(self.parts.__getitem__, found)).split(_BETWEEN)

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        # one text of all new words is encoded in half the time of a list; offsets say which word a token is from
        one = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        offsets = np.fromiter(map(operator.itemgetter(0), one.offsets), np.int64, len(one.ids))
        of = np.searchsorted(first, offsets, "right") - 1
        raw = np.array(one.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(of, minlength=len(texts))) * 4
        return (raw[a:b] for a, b in itertools.pairwise([0, *ends.tolist()]))

    def encode(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text in turn, a megabyte of it at a time."""
        for part in slices(text, _SPACE):
            yield from self._together([part])

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[Iterable[bytes]]:
        """The ids of every text, each to be taken before the next; short texts are looked up together."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > TOGETHER:
                yield from ((ids,) for ids in self._together(held))
                yield self.encode(text)
                held, size = [], 0
                continue
            held.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from ((ids,) for ids in self._together(held))
                held, size = [], 0
        yield from ((ids,) for ids in self._together(held))

    def _together(self, texts: list[bytes]) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return
        # each distinct word is looked up once; blanks at the ends of a text leave empty words, which have no ids
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = lists.values.dictionary_encode()
        edges = pa.array([0, len(words.dictionary)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(edges, words.dictionary.view(pa.large_binary())), pa.scalar(b" ", pa.large_binary()))
        distinct = joined[0].as_py().split(b" ")
        got = list(map(self.known.get, distinct))
        places = [k for k, ids in enumerate(got) if ids is None]
        if places:
            for k, ids in zip(places, self._learn([distinct[k] for k in places])):
                got[k] = ids
        del distinct, joined
        every = pa.array(got, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(every.buffers()[1], np.int64)[every.offset :][np.asarray(lists.offsets)].tolist()
        data = memoryview(every.buffers()[2] or b"")
        for start, end in itertools.pairwise(ends):
            yield bytes(data[start:end])


def encoder(path: str) -> IdBytes:
    """The process's own encoder; the tasks it runs one after another share what it remembers."""
    return kept(f"ids of {path}", lambda: IdBytes(path))


def cut(chunks: Iterable[bytes], size: int) -> Iterator[bytes]:
    """The bytes in pieces of ``size``; the last may be shorter, none is empty."""
    held = b""
    for chunk in chunks:
        held += chunk
        full = len(held) // size * size
        for at in range(0, full, size):
            yield held[at : at + size]
        held = held[full:]
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary) per piece; ``part`` and ``nth`` number the pieces of a length.

    A document is its ids and the end id; a null or empty text is the end id alone. Rows with null or equal ids are
    documents of their own. Other columns are not read.
    """
    ids_type = ", ids binary" if with_ids else ""
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(frames: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, encode_all = TaskContext.get().partitionId(), encoder(tokenizer).encode_all
        seen: collections.Counter[int] = collections.Counter()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
        rows: list[tuple] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for frame in frames:
            texts = (text.as_py() or b"" for text in frame.column(1))
            for doc_id, found in zip(frame.column(0).to_pylist(), encode_all(texts)):
                for number, ids in enumerate(cut(itertools.chain(found, [end]), 4 * capacity)):
                    length = len(ids) // 4
                    row = (doc_id, number, number * capacity, length, zlib.crc32(ids), part, seen[length])
                    rows.append((*row, ids) if with_ids else row)
                    seen[length] += 1
                    held += len(ids) if with_ids else 0
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()

    read = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ids_type
    return read.mapInArrow(cut_up, schema)


#: length, number of the first piece, pieces, first sequence, pieces per sequence, offset in it
Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the pieces of every length go. Each run is one step of the greedy, made for all equal pieces at once."""
    runs: list[Run] = []
    placed: collections.Counter[int] = collections.Counter()
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, placed[length], n, sequence, each, offset))
        placed[length] += n

    def leave(gap: int, sequence: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((sequence, n))

    left = dict(counts)
    large = sorted(length for length, n in counts.items() if n and 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            # the longest partner that fits; of its own length it takes two pieces
            at = bisect.bisect_right(large, min(length, capacity - length)) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == length):
                at -= 1
            if at < 0:
                n = left[length]
                place(length, n, sequences, 1, 0)
                left[length] = 0
                leave(capacity - length, sequences, n)
            elif large[at] == length:
                n = left[length] // 2
                place(length, 2 * n, sequences, 2, 0)
                left[length] -= 2 * n
                leave(capacity - 2 * length, sequences, n)
            else:
                partner = large[at]
                n = min(left[length], left[partner])
                place(length, n, sequences, 1, 0)
                place(partner, n, sequences, 1, length)
                left[length] -= n
                left[partner] -= n
                leave(capacity - length - partner, sequences, n)
            sequences += n
    for length in sorted((length for length, n in counts.items() if n and 3 * length <= capacity), reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                # no gap takes it: as many new sequences as the rest fills
                fresh = -(-n // (capacity // length))
                leave(capacity, sequences, fresh)
                sequences += fresh
                continue
            gap = sizes[at]
            sequence, open_ = gaps[gap].pop()
            each = min(gap // length, n)
            full = min(open_, n // each)
            place(length, full * each, sequence, each, capacity - gap)
            n -= full * each
            if open_ > full:
                gaps[gap].append((sequence + full, open_ - full))
            elif not gaps[gap]:
                del gaps[gap], sizes[at]
            leave(gap - each * length, sequence, full)
    return runs


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id (from 0, gapless) and offset; ``found`` must be a written table of ``pieces``.

    No sequence exceeds the capacity and each is gapless from 0. Pieces of one length are interchangeable: which of them
    goes where follows the order of the table's tasks. An empty table gives an empty one. Plan and counts are bounded by
    the capacity.
    """
    by_task = found.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    sooner = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("n").over(sooner), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    keys = runs[:, 0] << _RANK_BITS | runs[:, 1]
    columns = [c for c in found.columns if c not in ("part", "nth")]

    def put(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for frame in frames:
            length, rank = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first, _, sequence, each, offset = runs[np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1].T
            turn, place = np.divmod(rank - first, each)
            out = [frame.column(c) for c in columns] + [pa.array(sequence + turn), pa.array(offset + place * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in columns)
    ranked = found.join(before, ["part", "length"]).select(*columns, (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(put, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document (and its ids)."""
    return pack(stage(pieces(docs, tokenizer, capacity, end_id, with_ids), "pack-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, little-endian 32 bits) and the lengths of its pieces, from pieces packed with their ids."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda so_far, p: F.concat(so_far, p["ids"]))
    return held.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: p["length"]).alias("lengths"))
