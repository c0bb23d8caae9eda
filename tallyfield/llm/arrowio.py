"""Helpers of the operators that run Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows whose texts a worker holds as Python strings at a time.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows; empty ones are left out."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
