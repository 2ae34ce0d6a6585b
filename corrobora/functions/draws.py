"""Random numbers by counting: a row's id gives 64 bits, and every further draw mixes them with its number.

The same draws come out of a column expression and of numpy arrays, do not depend on partitions or retries, and need
32-bit integer arithmetic only, so any engine can repeat them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from .scalars import as_col

# Multipliers of a published 32-bit mixing function, and the odd number that spaces the counters.
_FIRST, _SECOND, _SPACE = 0x7FEB352D, 0x846CA68B, 0x9E3779B9
_MASK = 0xFFFFFFFF

#: Smallest 16-bit draw that gives a Poisson(1) count of 1, 2, ...: probabilities are kept to 2^-16.
POISSON_STEPS = [
    s for k in range(10) if (s := math.ceil(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) <= 65535
]


def row_state(*parts: Column | str, seed: int | str = 0) -> Column:
    """array(high, low): two 32-bit numbers fixed by the row's id and the seed (first 16 digits of an md5)."""
    digest = F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts], F.lit(str(seed))))
    return F.array(*[F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9)])


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value computed once; without it every step would double the expression."""
    return F.transform(F.array(x), use)[0]


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _times(x: Column, by: int) -> Column:
    """Product modulo 2^32 from halves, so that no 64-bit product overflows."""

    def halves(v: Column) -> Column:
        upper = F.shiftleft((F.shiftright(v, 16) * _long(by)).bitwiseAND(_long(0xFFFF)), 16)
        return (v.bitwiseAND(_long(0xFFFF)) * _long(by) + upper).bitwiseAND(_long(_MASK))

    return _let(x, halves)


def _mix(x: Column) -> Column:
    x = _let(x, lambda v: _times(v.bitwiseXOR(F.shiftright(v, 16)), _FIRST))
    x = _let(x, lambda v: _times(v.bitwiseXOR(F.shiftright(v, 15)), _SECOND))
    return _let(x, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def draw16(state: Column, number: Column) -> Column:
    """16-bit draw ``number`` of a row: two draws share a 32-bit word."""
    step = _times(F.shiftright(number, 1).cast("bigint"), _SPACE)
    word = _mix(state[1].bitwiseXOR(_mix((state[0] + step).bitwiseAND(_long(_MASK)))))
    return _let(word, lambda w: F.when(number % 2 == 0, F.shiftright(w, 16)).otherwise(w.bitwiseAND(_long(0xFFFF))))


def poisson_count(draw: Column) -> Column:
    return _let(draw, lambda d: sum(((d >= s).cast("int") for s in POISSON_STEPS), F.lit(0)))


def _mix_array(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(_FIRST)
    x ^= x >> np.uint32(15)
    x *= np.uint32(_SECOND)
    x ^= x >> np.uint32(16)
    return x


def draws16(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """The draws 0 to n - 1 of every row, one line per row."""
    steps = np.arange(-(-n // 2), dtype=np.uint32) * np.uint32(_SPACE)
    words = _mix_array(np.asarray(high).astype(np.uint32)[:, None] + steps)
    words ^= np.asarray(low).astype(np.uint32)[:, None]
    words = _mix_array(words)
    out = np.empty((len(words), 2 * words.shape[1]), np.uint16)
    out[:, 0::2] = words >> np.uint32(16)
    out[:, 1::2] = words & np.uint32(0xFFFF)
    return out[:, :n]


#: Poisson(1) count of every 16-bit draw.
POISSON_TABLE = np.searchsorted(np.array(POISSON_STEPS), np.arange(65536), side="right").astype(np.float64)


# ---- draws of 32 bits: an md5 of (id, block of four draws, seed) per four draws ------------

#: Smallest 32-bit draw that gives a Poisson(1) count of 1, 2, ...
POISSON_STEPS_32 = [
    s for k in range(9) if (s := math.ceil(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) < 2**32
]

_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
_MD5_ADD = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_MD5_TURN = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_MD5_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def _md5_words(words: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four words of the md5 of many messages of one block each, given as their 16 little-endian words (arrays that broadcast to the shape)."""
    a, b, c, d = _MD5_START[:, None, None].copy()
    free, turned = [np.empty(shape, np.uint32) for _ in range(5)], np.empty(shape, np.uint32)
    for i in range(64):
        word = words[_MD5_WORD[i]] + _MD5_ADD[i]
        left, right = np.uint32(_MD5_TURN[i]), np.uint32(32 - _MD5_TURN[i])
        # steps before the first word that differs from block to block are done once per row
        whole = np.broadcast_shapes(a.shape, b.shape, c.shape, d.shape, word.shape) == shape
        f = _md5_mix(i, b, c, d, free.pop() if whole else None)
        f = np.add(f, a, out=f if whole else None)
        f = np.add(f, word, out=f if whole else None)
        up = np.left_shift(f, left, out=turned if whole else None)
        f >>= right
        f |= up
        f += b
        if a.shape == shape:
            free.append(a)
        a, d, c, b = d, c, b, f
    return [x + s for x, s in zip((a, b, c, d), _MD5_START)]


def _md5_mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray | None) -> np.ndarray:
    if i < 16:
        f = np.bitwise_and(np.bitwise_xor(c, d, out=out), b, out=out)
        return np.bitwise_xor(f, d, out=out)
    if i < 32:
        f = np.bitwise_and(np.bitwise_xor(b, c, out=out), d, out=out)
        return np.bitwise_xor(f, c, out=out)
    if i < 48:
        return np.bitwise_xor(np.bitwise_xor(b, c, out=out), d, out=out)
    f = np.bitwise_or(np.invert(d, out=out), b, out=out)
    return np.bitwise_xor(f, c, out=out)


class Digests:
    """Draws of rows, four from each md5 of ``id|block|seed``, as in ``poisson_weights``; what does not depend on the ids is made once.

    The ids given together have one length in bytes. Messages of up to 55 bytes are digested as arrays, longer ones one by one.
    """

    def __init__(self, n_blocks: int, seed: int | str) -> None:
        self.tails = [f"|{k}|{seed}".encode() for k in range(n_blocks)]
        self.longest = max(map(len, self.tails))
        self.blocks: dict[int, list[np.ndarray]] = {}

    def _words(self, size: int) -> list[np.ndarray]:
        """The 16 words of every block's message after an id of so many bytes, without the id; one column if all blocks have the same."""
        if size not in self.blocks:
            ends = [(bytes(size) + t + b"\x80").ljust(56, b"\0") + (8 * (size + len(t))).to_bytes(8, "little") for t in self.tails]
            words = np.frombuffer(b"".join(ends), "<u4").reshape(1, -1, 16)
            self.blocks[size] = [x[:, :1] if (x == x[0, 0]).all() else np.ascontiguousarray(x) for x in np.moveaxis(words, 2, 0)]
        return self.blocks[size]

    def draws(self, ids: Sequence[str]) -> Sequence[np.ndarray]:
        """The first, second, third and fourth draw of every block, one line per row."""
        heads = [i.encode() for i in ids]
        size = len(heads[0])
        if size + self.longest > 55:
            digests = b"".join(hashlib.md5(h + t).digest() for h in heads for t in self.tails)
            return np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(heads), -1, 4).transpose(2, 0, 1)
        rows = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(-1, 16)
        words = [rows[:, w : w + 1] | block if 4 * w < size else block for w, block in enumerate(self._words(size))]
        return [x.byteswap(inplace=True) for x in _md5_words(words, (len(heads), len(self.tails)))]

    def counts(self, ids: Sequence[str]) -> list[np.ndarray]:
        """Poisson(1) counts of the draws."""
        return [poisson_counts(draws) for draws in self.draws(ids)]


def digest_draws(ids: Sequence[str], n: int, seed: int | str) -> np.ndarray:
    """The draws 0 to n - 1 of every id, one line per row: draw 4 b + k is the k-th of block b."""
    return np.stack(Digests(-(-n // 4), seed).draws(ids), axis=-1).reshape(len(ids), -1)[:, :n]


def poisson_counts(draws: np.ndarray) -> np.ndarray:
    """Poisson(1) count of every 32-bit draw."""
    out = np.zeros(draws.shape, np.uint8)
    for s in POISSON_STEPS_32:
        out += (draws >= np.uint32(s)).view(np.uint8)
    return out


def sql_state(parts: Sequence[str], seed: int | str) -> str:
    """The row's state in SQL: columns high and low."""
    digest = "md5(" + " || '|' || ".join([*(f"({p})" for p in parts), f"'{seed}'"]) + ")"
    return ", ".join(f"('0x' || substr({digest}, {at}, 8))::BIGINT::UBIGINT AS {name}" for at, name in ((1, "high"), (9, "low")))


def sql_draws(name: str, source: str, number: str, keep: str) -> list[str]:
    """``keep``, ``number`` and ``draw`` of a source that has high, low and the numbers: products of 32 bits fit 64."""
    out = [f"{name}_0 AS (SELECT {keep}, {number}, low, (high + (({number}) // 2)::UBIGINT * {_SPACE}::UBIGINT) % 4294967296::UBIGINT AS x FROM {source})"]
    at = 0
    for half in range(2):
        for shift, by in ((16, _FIRST), (15, _SECOND), (16, None)):
            mixed = f"xor(x, x >> {shift}::UBIGINT)" + (f" * {by}::UBIGINT % 4294967296::UBIGINT" if by else "")
            if by is None and half == 0:
                mixed = f"xor(low, {mixed})"
            out.append(f"{name}_{at + 1} AS (SELECT {keep}, {number}, low, {mixed} AS x FROM {name}_{at})")
            at += 1
    out.append(f"{name} AS (SELECT {keep}, {number}, CASE WHEN ({number}) % 2 = 0 THEN x >> 16::UBIGINT ELSE x & 65535::UBIGINT END AS draw FROM {name}_{at})")
    return out


def sql_poisson(draw: str) -> str:
    return "(" + " + ".join(f"({draw} >= {s})::INT" for s in POISSON_STEPS) + ")"
