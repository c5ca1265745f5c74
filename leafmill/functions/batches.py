"""Arrow batches of a task cut into short pieces, so that a task's Python holds little beside the batch that Spark hands it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc

#: Bytes of a piece's first column, and what a row counts beside its own; a row is never cut.
PIECE, _ROW = 1 << 20, 64


def pieces(batches: Iterator, most: int = PIECE) -> Iterator:
    """The batches' rows in order, in pieces of about ``most`` bytes; batches are arrays of texts or bytes, or tuples that start with one."""
    for b in batches:
        first = b[0] if isinstance(b, tuple) else b
        ends = np.cumsum(pc.fill_null(pc.binary_length(first), 0).to_numpy(zero_copy_only=False).astype(np.int64) + _ROW)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield tuple(x.slice(at, to - at) for x in b) if isinstance(b, tuple) else b.slice(at, to - at)
            at = to
