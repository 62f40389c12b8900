"""Monotone sequences in Elias-Fano form, read by numpy for many queries at once, and arrays in memory-mapped files."""

from __future__ import annotations

import json

import numpy as np

from folioflow.llm.common import local_path, read_file

_EVERY = 32  # set and clear bits of the upper half whose places are kept
_BLOCK = 256  # bits of the upper half before which the ones are counted
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: place of the k-th set bit of each byte
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _s = np.flatnonzero(_BYTE_BITS[_b])
    _SELECT[_b, : len(_s)] = _s


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one file: length of the head, head (names, types, sizes, places), arrays at multiples of 8."""
    head, body, at = {}, [], 0
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = (x.dtype.str, len(x), at)
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def from_file(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped where the folder is mounted, else read."""
    path = local_path(uri)
    raw = np.memmap(path, np.uint8, "r") if path else np.frombuffer(read_file(uri), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {k: np.frombuffer(raw, t, n, 8 + size + at) for k, (t, n, at) in head.items()}


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays for a non-decreasing sequence: low bits packed, upper bits in unary, places of some of its ones and zeros."""
    values = values.astype(np.uint64)
    n = len(values)
    base = int(values[0]) if n else 0
    top = (int(values[-1]) - base) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    rest = values - np.uint64(base)
    low = np.zeros((n, width), np.uint8)
    for k in range(width):
        low[:, k] = (rest >> np.uint64(k)).astype(np.uint8) & 1
    low = np.packbits(low.ravel(), bitorder="little")
    low = np.concatenate([low, np.zeros(16 - len(low) % 8, np.uint8)]).view(np.uint64)
    ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = n + (top >> width) + 1
    bits = np.zeros((size // _BLOCK + 2) * _BLOCK, np.uint8)
    bits[ones] = 1
    zeros = np.flatnonzero(bits == 0)[::_EVERY]
    before = np.cumsum(bits.reshape(-1, _BLOCK).sum(1, dtype=np.int64))
    kind = np.uint32 if len(bits) < 1 << 32 else np.uint64
    return {
        f"{name}.head": np.asarray([n, width, base, top >> width], np.uint64),
        f"{name}.low": low,
        f"{name}.high": np.packbits(bits, bitorder="little").view(np.uint64),
        f"{name}.ones": ones[::_EVERY].astype(kind),
        f"{name}.zeros": zeros.astype(kind),
        f"{name}.before": np.concatenate([[0], before[:-1]]).astype(np.int64),
    }


def _place(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th (from 0) set bit of each word."""
    at = np.zeros(len(words), np.int64)
    for half in (32, 16, 8):
        count = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        over = r >= count
        at += over * half
        r = r - over * count
        words = words >> (over * np.uint64(half))
    return at + _SELECT[words.astype(np.uint8), r]


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        head = arrays[f"{name}.head"]
        self.n, self.width, self.base, self.last = int(head[0]), int(head[1]), np.uint64(head[2]), int(head[3])
        self.low, self.words, self.ones, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones", "zeros"))
        ones = arrays[f"{name}.before"]
        self.before = {True: ones, False: np.arange(len(ones)) * _BLOCK - ones}
        self.mask = np.uint64((1 << self.width) - 1)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        return (self.low[word] >> off | (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off)) & self.mask

    def _bits(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits of the upper half from each place on."""
        word, off = at >> 6, (at & 63).astype(np.uint64)
        return self.words[word] >> off | (self.words[word + 1] << np.uint64(1)) << (np.uint64(63) - off)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit of the upper half: word by word from the last kept place on, or,
        where the next one is far away, from the start of its block."""
        kept = self.ones if one else self.zeros
        near = k // _EVERY
        at, left = kept[near].astype(np.int64), k % _EVERY
        far = np.flatnonzero(kept[np.minimum(near + 1, len(kept) - 1)] - at > _BLOCK)
        if len(far):
            block = np.searchsorted(self.before[one], k[far], "right") - 1
            at[far], left[far] = block * _BLOCK, k[far] - self.before[one][block]
        out, open_ = at, np.arange(len(k))
        while len(open_):
            words = self._bits(at)
            if not one:
                words = ~words
            count = np.bitwise_count(words).astype(np.int64)
            here = count > left
            out[open_[here]] = at[here] + _place(words[here], left[here])
            there = ~here
            open_, at, left = open_[there], at[there] + 64, left[there] - count[there]
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        upper = (self._select(i, True) - i).astype(np.uint64)
        return (upper << np.uint64(self.width) | self._lows(i)) + self.base

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x in the sequence, -1 where it isn't there: the upper part by select, the rest in its bucket."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        x = x.astype(np.uint64)
        upper = ((x - self.base) >> np.uint64(self.width)).astype(np.int64)
        live = np.flatnonzero((x >= self.base) & (upper <= self.last) & (upper >= 0))
        low = (x[live] - self.base) & self.mask
        h = upper[live]
        at = np.zeros(len(live), np.int64)
        some = np.flatnonzero(h)
        at[some] = self._select(h[some] - 1, False) + 1
        bits = self._bits(at)
        size = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)  # the ones that follow
        more = np.flatnonzero(size == 64)
        size[more] = self._select(h[more], False) - at[more]
        some = np.flatnonzero(size)
        live, low, lo = live[some], low[some], (at - h)[some]
        hi = end = lo + size[some]
        open_, lo, hi = np.arange(len(live)), lo.copy(), hi.copy()
        l, r, key = lo, hi, low
        while len(open_):
            mid = (l + r) >> 1
            less = self._lows(mid) < key
            l, r = np.where(less, mid + 1, l), np.where(less, r, mid)
            lo[open_] = l
            still = np.flatnonzero(l < r)
            open_, l, r, key = open_[still], l[still], r[still], key[still]
        ok = np.flatnonzero(lo < end)
        ok = ok[self._lows(lo[ok]) == low[ok]]
        out[live[ok]] = lo[ok]
        return out
