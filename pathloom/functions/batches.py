"""Groups of rows in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(parts: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The rows of parts, cut so that no group lies in two batches. place: column with a row's number in its group, from 1 on; groups follow each other."""
    held: list[pa.RecordBatch] = []

    def joined() -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for part in parts:
        begins = np.flatnonzero(part.column(place).to_numpy() == 1)
        if len(begins):
            held.append(part.slice(0, begins[-1]))
            yield from joined()
            held = []
            part = part.slice(begins[-1])
        held.append(part)
    yield from joined()
