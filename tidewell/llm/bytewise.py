"""Words of a whole Arrow batch of texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_SPREAD = np.random.default_rng(20240607).integers(1, 2**63, 4096, dtype=np.uint64) | _U(1)
#: A to Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mixed(x * _GOLD + y)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); null counts as empty."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The runs of bytes in `inside` (256 booleans): bytes (in lower case) without what lies between, begin of each, row of each."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, breaks: np.ndarray | None = None):
        data, at = raw(texts)
        on = inside[data]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        before = np.concatenate([[False], on[:-1]])
        start = np.flatnonzero(on & (~before | first[:-1]))
        after = np.concatenate([on[1:], [False]])
        end = np.flatnonzero(on & (~after | first[1:])) + 1
        self.rows = len(texts)
        self.row = np.searchsorted(at, start, side="right") - 1
        self.size = end - start
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = LOWER[data[on]]
        #: Whether a word can't follow the one before: another row, or a byte of `breaks` between them.
        self.broken = np.ones(len(start), bool)
        if len(start):
            self.broken[1:] = self.row[1:] != self.row[:-1]
            if breaks is not None:
                n = np.concatenate([[0], np.cumsum(breaks[data], dtype=np.int32)])[start]
                self.broken[1:] |= n[1:] != n[:-1]

    def __len__(self) -> int:
        return len(self.size)

    def strings(self) -> pa.StringArray:
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(self.at.astype(np.int32)), pa.py_buffer(self.bytes))

    def hashes(self) -> np.ndarray:
        return hashes(self.bytes, self.at)


def hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; none of them is empty."""
    size = np.diff(at)
    if not len(size):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    value = (data.astype(np.uint64) + _U(1) + (place >> 12).astype(np.uint64)) * _SPREAD[place & 4095]
    return mixed(np.add.reduceat(value, at[:-1]) + size.astype(np.uint64) * _GOLD)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the sum of whole values of each, a place of each)"""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[begin], np.add.reduceat(values[order], begin) if len(s) else values[:0], order[begin]
