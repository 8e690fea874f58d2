"""Vectorised reading of UTF-8 text: tokens of a slice of documents, and hashes of any of its substrings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from loamline.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Hashes:
    """Hashes of substrings of ``data``: a polynomial over 64-bit words, from one running sum, then mixed."""

    _up, _down = powers(1), powers(1)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes._up) < n:
            Hashes._up, Hashes._down = powers(n), powers(n, _INVERSE)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[data] * Hashes._up[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * Hashes._down[starts])


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts in them (and the end). Null: empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]
