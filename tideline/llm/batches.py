"""Runs of texts of a bounded size, so that a worker holds little more than one text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 4 << 20


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(position, texts) for consecutive texts of about ``size`` bytes together; null becomes empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield at, texts.slice(at, upto - at)
        at = upto
