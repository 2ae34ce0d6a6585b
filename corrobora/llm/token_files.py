"""Token ids in compressed binary files.

A file is a table of segments. A segment holds consecutive documents: their ids and lengths, and
the token ids cut into blocks of ``BLOCK`` ids. Every block is coded on its own, starts from a fresh
model and carries a checksum of its ids, so a damaged block harms no other.

The coder is a range coder (the variant whose state is one number, rANS). The chance of the next id mixes three predictions:
the id that last followed the two ids before it (order 2), the id that last followed the one before it (order 1), and
frequencies (order 0): those of groups of ids adapt within the block, those of the ids of a group are the segment's. How much
the first two weigh follows from how often predictions of the same confidence have come true in the block. A block's model
starts from the segment's frequencies, which stand in front of its blocks. The blocks of a segment are coded side by side, one id of each per step, in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import parallelism
from .common import kept, scratch, text_of
from .packing import encoder

END_ID = 2
BLOCK = 1024
#: Ids per segment, about; a longer document makes a longer segment.
SEGMENT = 1 << 21
#: Contexts of a block for each order, as a power of 2.
_CONTEXT_BITS = 10
#: Ids of a group, as a power of 2; likewise the totals of the kinds of predictions, of the groups and of the ids of a group.
GROUP_BITS = 12
_KIND_BITS, _CUM_BITS, _OWN_BITS = 16, 14, 15
_ORDER_0_BITS = np.uint64(_CUM_BITS + _OWN_BITS)
#: What the predictions leave to order 0 at least.
LEAST_FREE = 1 << 11
#: Chance that a prediction comes true at first, by confidence (0: nothing seen).
_TRUST = (0, 2000, 20000, 40000)
#: How slowly the trust and the groups adapt, as powers of 2.
_TRUST_RATE, _GROUP_RATE = 4, 7
#: The groups take in so many ids at a time, as a power of 2.
_TOLD = 3
#: Bytes of one array at most that outlive a segment.
_MOST_KEPT = 24 << 20
_TOTAL_BITS = np.uint64(_KIND_BITS + _CUM_BITS + _OWN_BITS)
_WORD = np.uint64(16)
_STATE_LOW = np.uint64(1 << 48)


def _room(name: str, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """An array of this Python process, used again by the next segment; it holds what it held. New memory costs as much as the work on it."""
    rooms = kept("rooms of token files", dict)
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if size > _MOST_KEPT:
        return np.empty(shape, dtype)
    if name not in rooms or len(rooms[name]) < size:
        rooms[name] = np.empty(size, np.uint8)
    return rooms[name][:size].view(dtype).reshape(shape)


class _Model:
    """The predictions for the next id of every block (one lane each). ``weights``: of the segment's ids at order 0."""

    def __init__(self, lanes: int, vocabulary: int, weights: np.ndarray) -> None:
        groups = (vocabulary - 1 >> GROUP_BITS) + 1
        self.edges = np.arange(groups + 1, dtype=np.int16)[:, None]
        whole = np.bincount(np.arange(vocabulary) >> GROUP_BITS, weights, groups).astype(np.int64)
        # every group keeps a share of one at least, as the frequencies it adapts to leave that much
        self.all = (1 << _CUM_BITS) - groups
        first = (np.append(0, np.cumsum(whole)) * self.all // whole.sum()).astype(np.int16)[:, None] + self.edges
        # a line per group: where its share starts in every lane
        self.cum = np.repeat(first, lanes, 1)
        self.flat, self.lanes, self.lane = self.cum.reshape(-1), lanes, np.arange(lanes)
        # lines for order 1 and order 2
        both = np.arange(2 * lanes).reshape(2, lanes)
        # lines of other lengths than powers of 2 share a cache better
        self.line = lanes + 16
        self.base, self.levels = self.lane + np.array([[0], [self.line << _CONTEXT_BITS]]), (both << 2).astype(np.int32)
        # per context, the lanes side by side, as they often meet the same one: the id that followed last, times 4, plus the confidence in it (0: nothing seen)
        self.seen = _room("seen", (2 * self.line << _CONTEXT_BITS,), np.int32)
        self.seen.fill(-4)
        # per lane and confidence: chance that the prediction comes true
        self.trust = np.tile(np.array(_TRUST, np.int32), 2 * lanes)
        self.at, self.past = self.base.copy(), np.zeros(lanes, np.uint32)
        self.step, self.later = np.empty_like(self.cum), np.empty(self.cum.shape, bool)
        self.told, self.n_told = np.zeros(self.cum.shape, np.int8), 0
        self.small = np.int8 if groups < 127 else np.int16
        self.small_edges = self.edges.astype(self.small)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of order 2 and of both orders in all; that of the same id goes to order 2."""
        entry = self.seen.take(self.at)
        self.said = entry >> 2
        entry &= 3
        self.sure = entry
        self.level = (self.levels + entry).astype(np.int64)
        self.chance = self.trust.take(self.level)
        free = (1 << _KIND_BITS) - LEAST_FREE
        second = self.chance[1] * (free >> 1)
        second >>= _KIND_BITS - 1
        # one at least each, so that whatever came true can be told
        second += 1
        both = free + 1 - second
        both *= self.chance[0] >> 1
        both >>= _KIND_BITS - 1
        both += 1
        both += second
        second += (both - second) * (self.said[0] == self.said[1]).astype(np.int32)
        return second, both

    @staticmethod
    def kind(second: np.ndarray, both: np.ndarray, hit: np.ndarray, is2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of what held: order 2 from 0, order 1 from second, order 0 from both. Products are faster than choices."""
        first = both - second
        start = both - first * hit
        start -= second * is2
        width = (1 << _KIND_BITS) - both
        width += (first - width) * hit
        width += (second - first) * is2
        return start, width

    def group(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of a group in every lane."""
        at = group.astype(np.int64)
        at *= self.lanes
        at += self.lane
        start = self.flat.take(at)
        at += self.lanes
        return start, self.flat.take(at)

    def find(self, place: np.ndarray) -> np.ndarray:
        """The group that holds the place in every lane."""
        return (self.cum[1:-1] <= place).view(np.int8).sum(0, dtype=self.small).astype(np.int64)

    def update(self, ids: np.ndarray, group: np.ndarray, hit: np.ndarray) -> None:
        """``hit``: whether each order's id came true, 1 or 0; overwritten."""
        # confidence 1 for another id, one more than before up to 3 for the same
        confidence = np.minimum(self.sure, 2)
        confidence *= hit
        confidence += (ids << 2) + 1
        self.seen[self.at] = confidence
        hit <<= 16 - _TRUST_RATE
        hit += self.chance
        self.chance >>= _TRUST_RATE
        hit -= self.chance
        self.trust[self.level] = hit
        np.greater(self.small_edges, group.astype(self.small), out=self.later)
        self.told += self.later.view(np.int8)
        self.n_told += 1
        if self.n_told == 1 << _TOLD:
            step = self.step
            np.multiply(self.told, np.int16(self.all >> _TOLD), out=step)
            step[-1] = self.all
            step += self.edges
            step -= self.cum
            step >>= _GROUP_RATE - _TOLD
            self.cum += step
            self.told[:] = self.n_told = 0
        mixed = ids.astype(np.uint32)
        mixed *= np.uint32(0x9E3779B1)
        self.past += mixed
        self.at[0], self.at[1] = mixed >> 32 - _CONTEXT_BITS, self.past >> 32 - _CONTEXT_BITS
        self.at *= self.line
        self.at += self.base
        np.multiply(mixed, np.uint32(0x85EBCA77), out=self.past)


def _shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur and their shares of a power of 2, one at least."""
    used = np.flatnonzero(counts)
    return used, _in_total(counts[used], 1 << max(12, (8 * len(used)).bit_length()))


def _in_total(counts: np.ndarray, total: int) -> np.ndarray:
    """Shares of the total, one at least."""
    shares = 1 + counts * (total - len(counts)) // counts.sum()
    shares[np.argsort(-shares, kind="stable")[: total - shares.sum()]] += 1
    return shares


def _spread(used: np.ndarray, shares: np.ndarray, vocabulary: int) -> np.ndarray:
    every = np.zeros(vocabulary, np.int64)
    every[used] = shares
    return every


def _pack_shares(used: np.ndarray, shares: np.ndarray) -> bytes:
    # alike bytes stand together
    planes = np.stack([np.diff(used, prepend=0), shares]).astype("<u4").view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
    packed = zlib.compress(planes.tobytes(), 6)
    return np.array([len(packed)], "<u4").tobytes() + packed


def _unpack_shares(payload: bytes, vocabulary: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, shares, bytes read)."""
    size = 4 + int.from_bytes(payload[:4], "little")
    try:
        planes = np.frombuffer(zlib.decompress(payload[4:size]), np.uint8).reshape(2, 4, -1)
    except (zlib.error, ValueError) as damage:
        raise ValueError("the frequencies of a segment are damaged") from damage
    steps, shares = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(2, -1).astype(np.int64)
    used, total = np.cumsum(steps), int(shares.sum())
    if not len(used) or used[-1] >= vocabulary or total & total - 1 or total > 1 << 32 or size > len(payload):
        raise ValueError("the frequencies of a segment are damaged")
    return used, shares, size


def _own_shares(used: np.ndarray, shares: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(share << _OWN_BITS | start of every id within its group, the id less its group's first at every place of every group)."""
    own = np.zeros(vocabulary, np.uint32)
    id_at = np.zeros(((vocabulary - 1 >> GROUP_BITS) + 1, 1 << _OWN_BITS), np.uint16)
    edges = np.searchsorted(used >> GROUP_BITS, np.arange(len(id_at) + 1))
    for at, a, b in zip(id_at, edges[:-1], edges[1:]):
        if a < b:
            share = _in_total(shares[a:b], 1 << _OWN_BITS)
            own[used[a:b]] = share << _OWN_BITS | np.cumsum(share) - share
            at[:] = np.repeat(used[a:b] & (1 << GROUP_BITS) - 1, share)
    return own, id_at.reshape(-1)


def _turned(lines: np.ndarray) -> np.ndarray:
    """The transpose, made of pieces that a processor's cache holds."""
    out = _room("turned", lines.shape[::-1], lines.dtype)
    for a in range(0, len(lines), 64):
        for b in range(0, lines.shape[1], 64):
            out[b : b + 64, a : a + 64] = lines[a : a + 64, b : b + 64].T
    return out


def encode_blocks(ids: np.ndarray, vocabulary: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(payload, 16-bit words per block, crc32 per block) of the ids cut into blocks."""
    n = len(ids)
    lanes = -(-n // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int32), np.zeros(0, np.int64)
    padded = _room("padded", (lanes * BLOCK,), np.int32)
    padded[:n], padded[n:] = ids, 0
    symbols = _turned(padded.reshape(lanes, BLOCK))
    used, shares = _shares(sum(np.bincount(x.ravel(), minlength=vocabulary) for x in np.split(symbols, 16)))
    model = _Model(lanes, vocabulary, _spread(used, shares, vocabulary))
    # the model goes from the first ids to the last, the coder back: it is told what the model said of every id
    kinds = _room("kinds", (BLOCK, 2, lanes), np.int32)
    groups = _room("groups", (BLOCK, 2, lanes), np.int16)
    hits = _room("hits", (BLOCK, lanes), np.int8)
    for column, kind, edges, hit in zip(symbols, kinds, groups, hits):
        second, both = model.predict()
        group = column >> GROUP_BITS
        edges[0], edges[1] = model.group(group)
        true = (model.said == column).astype(np.int32)
        known = true[0] | true[1]
        hit[:] = known
        kind[0], kind[1] = model.kind(second, both, known, true[1])
        model.update(column, group, true)
    del model
    own, _ = _own_shares(used, shares, vocabulary)
    room = 3 * BLOCK + 4
    out = _room("out", (lanes * room,), np.uint16)
    place = np.arange(1, lanes + 1) * room
    state = np.full(lanes, _STATE_LOW)
    total, least, four = np.uint64(1 << int(_TOTAL_BITS)), np.uint64(64) - _TOTAL_BITS, np.uint64(4)
    # what is coded last is decoded first
    for at in range(BLOCK, 0, -8):
        some = slice(at - 8, at)
        low, kind = kinds[some, 0].astype(np.uint64), kinds[some, 1].astype(np.uint64)
        first = groups[some, 0].astype(np.uint64)
        group = groups[some, 1].astype(np.uint64) - first
        start = own.take(symbols[some]).astype(np.uint64)
        width = start >> np.uint64(_OWN_BITS)
        start &= np.uint64((1 << _OWN_BITS) - 1)
        width *= group
        start *= group
        first <<= np.uint64(_OWN_BITS)
        start += first
        hit = hits[some].astype(np.uint64)
        miss = hit ^ np.uint64(1)
        width *= miss
        start *= miss
        hit <<= _ORDER_0_BITS
        width += hit
        width *= kind
        start *= kind
        low <<= _ORDER_0_BITS
        start += low
        for begin, wide in zip(start[::-1], width[::-1]):
            # most put out one word or none; a word put where the next one goes does no harm
            over = state >> least >= wide
            out[place - 1] = state.astype(np.uint16)
            place -= over.astype(np.int64)
            state >>= over.astype(np.uint64) << four
            rows = np.flatnonzero(state >> least >= wide)
            while len(rows):
                full = state[rows]
                place[rows] = to = place[rows] - 1
                out[to] = full.astype(np.uint16)
                full >>= _WORD
                state[rows] = full
                rows = rows[full >> least >= wide[rows]]
            turns = state // wide
            turns *= total - wide
            state += turns
            state += begin
    for shift in range(0, 64, 16):
        place -= 1
        out[place] = (state >> np.uint64(shift)).astype(np.uint16)
    sizes = np.arange(1, lanes + 1) * room - place
    words = b"".join(out[end - size : end].astype("<u2").tobytes() for end, size in zip(range(room, lanes * room + 1, room), sizes.tolist()))
    raw = np.asarray(ids).astype("<u4")
    sums = np.array([zlib.crc32(raw[i : i + BLOCK]) for i in range(0, n, BLOCK)], np.int64)
    return _pack_shares(used, shares) + words, sizes.astype(np.int32), sums


def decode_blocks(payload: bytes, sizes: np.ndarray, sums: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """The n ids back; ValueError names the blocks whose checksum does not hold."""
    lanes = len(sizes)
    if not lanes:
        return np.zeros(0, np.int64)
    used, shares, size = _unpack_shares(payload, vocabulary)
    words = np.frombuffer(payload, "<u2", (len(payload) - size) // 2, size)
    words = np.append(words, np.zeros(4, np.uint16))
    place = np.cumsum(sizes, dtype=np.int64) - sizes
    state = np.zeros(lanes, np.uint64)
    for _ in range(4):
        state = state << _WORD | words.take(place, mode="clip")
        place += 1
    own, id_at = _own_shares(used, shares, vocabulary)
    model = _Model(lanes, vocabulary, _spread(used, shares, vocabulary))
    four = np.uint64(4)
    mask, own_mask = (np.uint64((1 << int(x)) - 1) for x in (_TOTAL_BITS, _OWN_BITS))
    columns = _room("columns", (BLOCK, lanes), np.int32)
    for column in columns:
        second, both = model.predict()
        slot = state & mask
        kind = (slot >> _ORDER_0_BITS).astype(np.int32)
        hit, is2 = (kind < both).astype(np.int32), (kind < second).astype(np.int32)
        low, high = model.kind(second, both, hit, is2)
        width, start = high.astype(np.uint64), low.astype(np.uint64)
        start <<= _ORDER_0_BITS
        # the place within the kind, then within the group
        within = slot - start
        within //= width
        group = model.find((within >> np.uint64(_OWN_BITS)).astype(np.int16))
        first, last = model.group(group)
        last -= first
        first, wide = first.astype(np.uint64), last.astype(np.uint64)
        first <<= np.uint64(_OWN_BITS)
        within -= first
        within //= wide
        within &= own_mask
        within += group.view(np.uint64) << np.uint64(_OWN_BITS)
        group <<= GROUP_BITS
        group += id_at.take(within.view(np.int64))
        share = own.take(group, mode="clip").astype(np.uint64)
        first += wide * (share & own_mask)
        share >>= np.uint64(_OWN_BITS)
        wide *= share
        known = hit.astype(np.uint64)
        miss = known ^ np.uint64(1)
        first *= miss
        wide *= miss
        known <<= _ORDER_0_BITS
        wide += known
        first *= width
        start += first
        wide *= width
        state >>= _TOTAL_BITS
        state *= wide
        state += slot
        state -= start
        # most take in one word or none
        less = (state < _STATE_LOW).astype(np.uint64)
        state <<= less << four
        state |= words.take(place, mode="clip") * less
        place += less.view(np.int64)
        rows = np.flatnonzero(state < _STATE_LOW)
        for _ in range(2 if len(rows) else 0):
            next_ = place[rows]
            more = state[rows] << _WORD
            more |= words.take(next_, mode="clip")
            state[rows] = more
            place[rows] = next_ + 1
            rows = rows[more < _STATE_LOW]
            if not len(rows):
                break
        column[:] = group
        column += (model.said[0] - column) * hit
        column += (model.said[1] - model.said[0]) * is2
        model.update(column, column >> GROUP_BITS, (model.said == column).astype(np.int32))
    ids = _turned(columns).ravel()[:n]
    raw = ids.astype("<u4")
    # a state that has not come back to where the coder began tells of damage that no id shows
    broken = [i for i, good in enumerate((state == _STATE_LOW).tolist()) if not good or zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK]) != int(sums[i])]
    if broken:
        raise ValueError(f"checksum does not hold in blocks {broken[:20]}")
    return raw


SEGMENTS = (
    "part int, segment int, vocabulary int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, payload binary, "
    "block_words array<int>, block_crc32 array<bigint>"
)


def write_ids(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode every document and write the segments to ``path`` in ascending doc_id order.

    Null ids come first, equal ids in the order of their texts' hashes. A null or empty text is its end id alone. Rows
    are dealt to parts by ranges of doc_id; part and segment number give the order of the file.
    """
    spark = docs.sparkSession
    digest = F.xxhash64(text_of())
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"), digest.alias("digest"))
    order = [F.asc_nulls_first("doc_id"), F.col("digest")]
    ranged = slim.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)

    def segments(frames: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), encoder(tokenizer)
        vocabulary = len(words.codes)
        end = np.array([END_ID], "<u4").tobytes()
        ids: list[int | None] = []
        parts: list[bytes] = []
        number = held = 0

        def full():
            every = np.frombuffer(b"".join(parts), "<u4")
            payload, sizes, sums = encode_blocks(every, vocabulary)
            row = {"part": part, "segment": number, "vocabulary": vocabulary, "doc_ids": list(ids), "lengths": [len(x) // 4 for x in parts],
                   "n_ids": len(every), "payload": payload, "block_words": sizes.tolist(), "block_crc32": sums.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("vocabulary", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                            ("n_ids", pa.int64()), ("payload", pa.binary()), ("block_words", pa.list_(pa.int32())), ("block_crc32", pa.list_(pa.int64()))])
        for batch in frames:
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, found in zip(batch.column(0).to_pylist(), words.encode_all(texts)):
                ids.append(doc_id)
                parts.append(b"".join(found) + end)
                held += len(parts[-1]) // 4
                if held >= SEGMENT:
                    yield full()
                    ids.clear()
                    parts.clear()
                    number, held = number + 1, 0
        if parts:
            yield full()

    out = ranged.drop("digest").mapInArrow(segments, SEGMENTS)
    out.write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the file, decoded and checked."""
    file = spark.read.schema(SEGMENTS).parquet(path)

    def documents(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in frames:
            for row in batch.to_pylist():
                args = np.array(row["block_words"]), np.array(row["block_crc32"]), row["n_ids"], row["vocabulary"]
                raw = decode_blocks(row["payload"], *args).astype("<u4", copy=False)
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - row["lengths"]
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[k]] * len(ends), pa.int32()) for k in ("part", "segment")]
                    + [pa.array(x, pa.int64()) for x in (row["doc_ids"], starts, row["lengths"], sums)],
                    names=["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    found = file.mapInArrow(documents, "part int, segment int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    # sums over one row per part, then over the segments of a part
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = file.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    sooner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    heads = file.select("part", "segment", F.coalesce(F.sum("n_ids").over(sooner), F.lit(0)).alias("segment_start")).join(parts, "part")
    placed = found.join(heads, ["part", "segment"])
    start = F.col("part_start") + F.col("segment_start") + F.col("within")
    return placed.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids to a new file in the shared folder and read them back."""
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
