"""Words of many texts at once, as 64-bit fingerprints.

A word is a run of bytes other than the ASCII white space. Texts stay in their Arrow
buffer; boundaries and hashes come from a few numpy passes over it, so no word becomes
a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_ARE_SPACE = np.zeros(256, bool)
_ARE_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BYTES = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTES = _BYTES[_LOWERED]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of a run of texts: text i has words ``bounds[i]`` to ``bounds[i + 1]``."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buffer: np.ndarray
    offsets: np.ndarray  # where each text, with one line feed after it, begins in the buffer


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Fingerprints of ascending, disjoint byte spans, by differences of a running polynomial."""
    table = _LOWER_BYTES if lower else _BYTES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(max(b - a, PIECE_BYTES))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[buffer[a:b]] * up[: b - a], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * down[s]
        i = j
    return mix(out)


def spans(buffer: np.ndarray, outside: np.ndarray = _ARE_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer; ``outside`` says which bytes are in none."""
    space = np.ones(len(buffer) + 2, bool)
    space[1:-1] = outside[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def slices(
    texts: pa.Array | pa.ChunkedArray, lower: bool = True, outside: np.ndarray = _ARE_SPACE, size: int = SLICE_BYTES
) -> Iterator[Words]:
    """The words of all texts, in runs of about ``size`` bytes; null is an empty text. The bytes ``outside`` are in no word."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(chunk).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(chunk):
            done = int(sizes[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, done + size, "right")))
            run = chunk.slice(at, upto - at)
            run = pc.binary_join_element_wise(run, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
            offsets = np.frombuffer(run.buffers()[1], np.int64, len(run) + 1, run.offset * 8)
            data = run.buffers()[2]
            buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            buffer = buffer[offsets[0] : offsets[-1]]
            starts, ends = spans(buffer, outside)
            bounds = np.searchsorted(starts, offsets - offsets[0])
            yield Words(at, hash_spans(buffer, starts, ends, lower), bounds, starts, ends, buffer, offsets - offsets[0])
            at = upto
