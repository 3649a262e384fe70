"""Walk over sorted Arrow batches of a task and hand out one group of equal keys at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal ``keys``; the input must be sorted (or clustered) by them.

    Only the group at hand is kept, so memory is bounded by the largest group.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols))
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)
