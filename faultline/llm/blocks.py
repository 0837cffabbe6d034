"""Vectorised hashing of texts and words, and packing of sorted keys."""

from __future__ import annotations

import numpy as np

_MIX = np.random.default_rng(20).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of the polynomial hashes and their inverses modulo 2^64.
_ROOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BACK = tuple(pow(r, -1, 1 << 64) for r in _ROOTS)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Of eight little-endian bytes, the first ones.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit keys, so that every bit depends on all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(values: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``n`` consecutive 64-bit values, by prefix sums."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_ROOTS[seed], len(values)), out=total[1:])
    out = total[n:] - total[:-n]
    return scramble(out * _powers(_BACK[seed], len(out)))


def spread(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bytes as random 64-bit values."""
    return _MIX[seed][raw]


def words(raw: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words between ASCII white space.

    Eight bytes at a time are mixed into a word's state by a bijection that is
    not linear, so no two words have equal hashes by the way they are built.
    """
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[0::2], edge[1::2]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(raw) + 1, "<u8", buffer=padded, strides=(1,))  # the eight bytes from each position on
    length = ends - starts
    state = np.full(len(starts), np.uint64(_ROOTS[seed]))
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = length[todo] - at
        state[todo] = scramble(state[todo] ^ (lanes[starts[todo] + at] & _MASKS[np.minimum(left, 8)]))
        todo, at = todo[left > 8], at + 8
    return starts, ends, scramble(state + length.astype(np.uint64) * np.uint64(_ROOTS[1 - seed]))


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the (leftmost) minimum of every ``w`` consecutive values."""
    if len(x) < w:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        a, b, left, right = x[:-step], x[step:], at[:-step], at[step:]
        first = a <= b
        x, at, have = np.where(first, a, b), np.where(first, left, right), have + step
    return at


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane, so that the
    shuffle's compression removes the empty planes."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueeze(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64)


def in_sorted(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def pieces(raw: bytes, limit: int = 1 << 20) -> list[bytes]:
    """A long text in parts that end at white space (or where there is none)."""
    if len(raw) <= limit:
        return [raw]
    out, start = [], 0
    while len(raw) - start > limit:
        stop = max(raw.rfind(c, start, start + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if stop <= start:
            found = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := raw.find(c, start + limit)) >= 0]
            stop = min(found, default=len(raw))
        out.append(raw[start:stop])
        start = stop
    return [*out, raw[start:]]


def word_hashes(texts: list[bytes], seed: int = 0, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the count of each text."""
    counts = np.zeros(len(texts), np.int64)
    found, block, owners, size = [np.zeros(0, np.uint64)], [], [], 0

    def flush() -> None:
        nonlocal block, owners, size
        if block:
            starts, _, h = words(np.frombuffer(b"\n".join(block), np.uint8), seed)
            begin = np.cumsum([0] + [len(p) + 1 for p in block[:-1]])
            per = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
            np.add.at(counts, owners, per)
            found.append(h)
        block, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for p in pieces(text, limit):
            block.append(p)
            owners.append(i)
            size += len(p)
            if size >= limit:
                flush()
    flush()
    return np.concatenate(found), counts
