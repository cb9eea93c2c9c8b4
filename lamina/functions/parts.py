"""Arrow batches in parts."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

#: Rows that a worker takes at once, and bytes of them (one text at least).
TEXTS, BYTES = 1000, 4 << 20


def in_parts(batches, *columns: str):
    """The batches in slices of TEXTS rows or BYTES in the columns at most, so that no worker holds
    the objects of a whole batch."""
    for batch in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch[c]), 0), dtype=np.int64) for c in columns)
        if not len(batch):
            yield batch
        ends, a = np.cumsum(sizes), 0
        while a < len(batch):
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, side="right"))
            b = min(max(b, a + 1), a + TEXTS, len(batch))
            yield batch.slice(a, b - a)
            a = b
