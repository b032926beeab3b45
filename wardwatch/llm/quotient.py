"""Counting quotient filters over whole keys: compact, sorted, lossless, mergeable.

A key is a row of unsigned numbers, its lanes, of ``widths`` bits each. An invertible
permutation of all its bits spreads it evenly; the top ``block`` bits of the first lane say
which shard it belongs to, the next ``slots`` bits are the quotient and all other bits are
the remainder. A filter keeps

* one *occupied* bit per quotient and one *run end* bit per entry, which together place
  every entry under its quotient;
* the remainder of each entry, without the bits the quotient already says;
* one counter byte per entry; larger counts stand in a short list of their own.

As the remainder is whole and the permutation has an inverse, keys come back exactly and
no two keys are ever counted as one. Entries are in order of the permuted key, so filters
of several shards are merged by merging sorted runs.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

ODD_A, ODD_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
INVERSE_A, INVERSE_B = pow(ODD_A, -1, 1 << 64), pow(ODD_B, -1, 1 << 64)
HEAD = struct.Struct("<BBBIII")  # lanes, block bits, slot bits, block, entries, large counts; widths follow


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def _unshift(x: np.ndarray, by: int, width: int) -> np.ndarray:
    """The inverse of x ^= x >> by."""
    out, s = x.copy(), by
    while s < width:
        out ^= out >> np.uint64(s)
        s *= 2
    return out


def _shifts(width: int) -> list[int]:
    return [max(1, width // 2), max(1, width // 2 - 3), max(1, width // 2 - 1)]


def _spread(x: np.ndarray, width: int) -> np.ndarray:
    a, b, c = (np.uint64(s) for s in _shifts(width))
    x = ((x ^ (x >> a)) * np.uint64(ODD_A)) & _mask(width)
    x = ((x ^ (x >> b)) * np.uint64(ODD_B)) & _mask(width)
    return x ^ (x >> c)


def _gather(x: np.ndarray, width: int) -> np.ndarray:
    a, b, c = _shifts(width)
    x = (_unshift(x, c, width) * np.uint64(INVERSE_B)) & _mask(width)
    x = (_unshift(x, b, width) * np.uint64(INVERSE_A)) & _mask(width)
    return _unshift(x, a, width)


def _turns(x: np.ndarray, widths: Sequence[int]):
    """(lane, what its neighbour adds to it), twice round; the same backwards undoes it."""
    lanes = len(widths)
    for r in range(2 * lanes):
        yield r % lanes, lambda r=r: _spread(x[:, (r + 1) % lanes] + np.uint64(r + 1), 64) & _mask(widths[r % lanes])


def permuted(keys: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """A bijection of keys: every lane in turn takes in a function of its neighbour, and
    each lane is mixed at the end."""
    x = keys.copy()
    if len(widths) > 1:
        for lane, added in _turns(x, widths):
            x[:, lane] ^= added()
    for j, w in enumerate(widths):
        x[:, j] = _spread(x[:, j], w)
    return x


def restored(x: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """The inverse of ``permuted``."""
    keys = x.copy()
    for j, w in enumerate(widths):
        keys[:, j] = _gather(keys[:, j], w)
    if len(widths) > 1:
        for lane, added in reversed(list(_turns(keys, widths))):
            keys[:, lane] ^= added()
    return keys


def counted(x: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in order, their summed counts). Sorting runs that are sorted already
    merges them."""
    if counts is None:
        counts = np.ones(len(x), np.int64)
    if not len(x):
        return x, counts
    order = np.argsort(x[:, 0], kind="stable")
    x = x[order]
    if x.shape[1] > 1:
        same = x[1:, 0] == x[:-1, 0]
        if (same & (x[1:, 1:] != x[:-1, 1:]).any(axis=1)).any():
            order = order[(again := np.lexsort(x.T[::-1]))]
            x = x[again]
    first = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
    return x[first], np.add.reduceat(counts[order], np.flatnonzero(first))


class QuotientFilter:
    """The entries of one block: permuted keys in order, with counts."""

    def __init__(self, x: np.ndarray, counts: np.ndarray, widths: Sequence[int], block_bits: int, block: int):
        self.x, self.counts, self.widths, self.block_bits, self.block = x, counts, tuple(widths), block_bits, block

    @classmethod
    def merged(cls, filters: Sequence[QuotientFilter]) -> QuotientFilter:
        x, counts = counted(np.concatenate([f.x for f in filters]), np.concatenate([f.counts for f in filters]))
        return cls(x, counts, filters[0].widths, filters[0].block_bits, filters[0].block)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys as they were given, counts)."""
        return restored(self.x, self.widths), self.counts

    def to_bytes(self) -> bytes:
        n = len(self.x)
        slot_bits = min(max(0, (n - 1).bit_length()), self.widths[0] - self.block_bits)
        rest = self.widths[0] - self.block_bits - slot_bits
        quotient = ((self.x[:, 0] >> np.uint64(rest)) if rest < 64 else np.zeros(n, np.uint64)) & _mask(slot_bits)
        occupied = np.zeros(1 << slot_bits, bool)
        occupied[quotient.astype(np.int64)] = True
        run_end = np.ones(n, bool)
        run_end[:-1] = quotient[1:] != quotient[:-1]
        kept = [(self.x[:, 0] & _mask(rest), rest), *((self.x[:, j], w) for j, w in enumerate(self.widths) if j)]
        remainders = [np.ascontiguousarray(lane.astype("<u8")).view(np.uint8).reshape(n, 8)[:, : -(-w // 8)] for lane, w in kept]
        large = self.counts >= 255
        parts = [
            HEAD.pack(len(self.widths), self.block_bits, slot_bits, self.block, n, int(large.sum())),
            bytes(self.widths),
            np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(),
            np.concatenate(remainders, axis=1).tobytes(),
            np.where(large, 255, self.counts).astype(np.uint8).tobytes(),
            self.counts[large].astype("<i8").tobytes(),
        ]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, body: bytes) -> QuotientFilter:
        lanes, block_bits, slot_bits, block, n, n_large = HEAD.unpack_from(body)
        widths = tuple(body[HEAD.size : HEAD.size + lanes])
        at = HEAD.size + lanes

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(body, np.uint8, size, at - size)

        rest = widths[0] - block_bits - slot_bits
        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << slot_bits) // 8)), count=1 << slot_bits))
        run_end = np.unpackbits(take(-(-n // 8)), count=n)
        sizes = [-(-w // 8) for w in (rest, *widths[1:])]
        rows = take(n * sum(sizes)).reshape(n, sum(sizes))
        counts = take(n).astype(np.int64)
        counts[counts == 255] = take(8 * n_large).view("<i8")
        x = np.zeros((n, lanes), np.uint64)
        column = 0
        for j, size in enumerate(sizes):
            padded = np.zeros((n, 8), np.uint8)
            padded[:, :size] = rows[:, column : column + size]
            x[:, j] = padded.view("<u8").reshape(n)
            column += size
        run = np.cumsum(run_end, dtype=np.int64) - run_end
        if slot_bits:
            x[:, 0] |= occupied[run].astype(np.uint64) << np.uint64(rest)
        if block_bits:
            x[:, 0] |= np.uint64(block << (widths[0] - block_bits))
        return cls(x, counts, widths, block_bits, block)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys as they were given; 0 for those not held."""
        x, held = permuted(keys, self.widths), self.x
        found = np.zeros(len(x), np.int64)
        left = np.searchsorted(held[:, 0], x[:, 0], "left")
        right = np.searchsorted(held[:, 0], x[:, 0], "right")
        while True:
            open_ = np.flatnonzero((left < right) & (found == 0))
            if not len(open_):
                return found
            hit = (held[left[open_]] == x[open_]).all(axis=1)
            found[open_[hit]] = self.counts[left[open_[hit]]]
            left[open_[~hit]] += 1


def filters_of(x: np.ndarray, counts: np.ndarray, widths: Sequence[int], block_bits: int) -> list[QuotientFilter]:
    """Distinct sorted permuted keys, cut into the filters of their blocks."""
    if not len(x):
        return []
    block_bits = min(block_bits, widths[0])
    block = x[:, 0] >> np.uint64(widths[0] - block_bits) if block_bits else np.zeros(len(x), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = [*starts[1:].tolist(), len(x)]
    return [QuotientFilter(x[a:b], counts[a:b], widths, block_bits, int(block[a])) for a, b in zip(starts.tolist(), ends, strict=True)]
