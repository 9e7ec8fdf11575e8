"""Arrow batches in small slices, so that what a task holds as Python objects stays small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 512


def sliced(batches, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
