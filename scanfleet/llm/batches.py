"""Arrow batches in slices, so that a Python worker's memory follows a few rows rather than a whole batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that a worker turns at a time, and bytes from which a slice is ended sooner.
ROWS, BYTES = 512, 4 << 20


def slices(batches: Iterable[pa.Array], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.Array]:
    """The batches in order, cut into slices of at most ``rows`` rows and about ``most`` bytes each."""
    for batch in batches:
        step = max(1, min(rows, rows if not batch.nbytes else most * len(batch) // batch.nbytes))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)
