"""Monotone sequences in Elias-Fano form, in memory-mapped files, searched in bulk.

A value is cut into low bits, kept side by side, and a high part, kept in unary: the
bitmap has a one for each value and a zero for each step of the high part. A directory
of the ones before every 64 bits finds the n-th one or zero. All searches take arrays.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

CHUNK = 1 << 16


def save(path: str, arrays: dict[str, np.ndarray], facts: dict) -> None:
    """One file of arrays. It appears whole or not at all, however often it is written."""
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = [at, array.dtype.str, len(array)]
        at += -(-array.nbytes // 8) * 8
    head = json.dumps({"places": places, "facts": facts}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        out.write(np.int64(len(head)).tobytes() + head)
        for array in arrays.values():
            out.write(array.tobytes())
            out.write(b"\0" * (-array.nbytes % 8))
    os.replace(draft, path)


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    whole = np.memmap(path, np.uint8, "r")
    size = int(whole[:8].view(np.int64)[0])
    head = json.loads(bytes(whole[8:8 + size]))
    start = 8 + size
    arrays = {
        name: whole[start + at:start + at + n * np.dtype(kind).itemsize].view(kind)
        for name, (at, kind, n) in head["places"].items()}
    return arrays, head["facts"]


def encoded(values: np.ndarray, top: int) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and facts of a sorted sequence of numbers from 0 to ``top``."""
    n = len(values)
    bits = min(57, max(0, (top // max(n, 1)).bit_length() - 1))
    values = values.astype(np.uint64)
    low = np.zeros(n * bits // 8 + 16, np.uint8)
    for k in range(0, n if bits else 0, CHUNK):  # a chunk ends on a whole byte
        part = values[k:k + CHUNK]
        raw = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8)
        cut = np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")
        low[k * bits // 8:k * bits // 8 + len(cut)] = cut
    high = (values >> np.uint64(bits)).astype(np.int64)
    length = n + (top >> bits) + 2
    marks = np.zeros(-(-length // 64) * 64, bool)
    marks[high + np.arange(n)] = True
    words = np.packbits(marks, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    kind = np.uint32 if n < 1 << 32 else np.int64
    return {"low": low, "high": words, "ones": ones.astype(kind)}, {"n": n, "bits": bits, "top": int(top)}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], facts: dict, name: str = ""):
        low, self.high, self.ones = (arrays[name + k] for k in ("low", "high", "ones"))
        self.n, self.bits, self.top = facts["n"], facts["bits"], facts["top"]
        self.low = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        self.zeros = None

    def _inside(self, block: np.ndarray, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the ``rank``-th one or zero of each 64-bit word, byte by byte."""
        word = np.asarray(self.high[block])
        if not ones:
            word = ~word
        raw = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(raw), axis=1, dtype=np.int64)
        byte = (upto <= rank[:, None]).sum(axis=1)
        rows = np.arange(len(raw))
        rest = rank - np.where(byte > 0, upto[rows, byte - 1], 0)
        return block * 64 + byte * 8 + PLACE[raw[rows, byte], rest]

    def _run(self, start: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many ones stand from some places on, each after the zero before ``high``."""
        word = np.asarray(self.high[np.minimum(start >> 6, len(self.high) - 1)])
        rest = ~(word >> (start & 63).astype(np.uint64))
        lowest = rest & (~rest + np.uint64(1))
        run = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero((start & 63) + run >= 64)  # it may go on in the next word
        if len(far):
            run[far] = self.zero(high[far]) - start[far]
        return run

    def one(self, rank: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.ones, rank.astype(self.ones.dtype), side="right") - 1
        return self._inside(block, rank - self.ones[block].astype(np.int64), True)

    def zero(self, rank: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        block = np.searchsorted(self.zeros, rank, side="right") - 1
        return self._inside(block, rank - self.zeros[block], False)

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def at(self, place: np.ndarray) -> np.ndarray:
        """The values at some places."""
        high = (self.one(place) - place).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.lows(place)

    def find(self, value: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, or -1: its successor within first <= place < end."""
        out = np.full(len(value), -1, np.int64)
        ok = np.flatnonzero(value <= np.uint64(self.top)) if self.n else np.zeros(0, np.int64)
        if not len(ok):
            return out
        value = value[ok]
        high = (value >> np.uint64(self.bits)).astype(np.int64)
        start = np.where(high > 0, self.zero(np.maximum(high - 1, 0)) + 1, 0)
        lo = start - high
        hi = lo + self._run(start, high)
        if first is not None:
            lo, hi = np.maximum(lo, first[ok]), np.minimum(hi, end[ok])
        want = value & np.uint64((1 << self.bits) - 1)
        stop, active = hi.copy(), np.flatnonzero(lo < hi)
        while len(active):
            middle = (lo[active] + hi[active]) >> 1
            less = self.lows(middle) < want[active]
            lo[active[less]] = middle[less] + 1
            hi[active[~less]] = middle[~less]
            active = active[lo[active] < hi[active]]
        inside = np.flatnonzero(lo < stop)
        hit = inside[self.lows(lo[inside]) == want[inside]]
        out[ok[hit]] = lo[hit]
        return out


def _places() -> np.ndarray:
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        for k, place in enumerate(p for p in range(8) if byte >> p & 1):
            table[byte, k] = place
    return table


#: Place of the k-th one of each byte.
PLACE = _places()
