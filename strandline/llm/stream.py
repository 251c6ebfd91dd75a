"""Groups of a sorted partition as a stream, for ``mapInArrow`` after ``repartition`` and ``sortWithinPartitions``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``n_keys`` columns (integers, not null)."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = bool(held) and last != tuple(int(k[0]) for k in keys)
        last = tuple(int(k[-1]) for k in keys)
        at = 0
        for c in np.flatnonzero(new).tolist():
            if c > at:
                held.append(batch.slice(at, c - at))
            yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def gathered(batches: Iterator[pa.RecordBatch], n_keys: int, sized: str, limit: int) -> Iterator[pa.Table]:
    """Runs of whole groups whose ``sized`` column (binary) holds ``limit`` bytes or a little more."""
    held, total = [], 0
    for g in groups(batches, n_keys):
        held.append(g)
        total += sum(c.nbytes for c in g[sized].chunks)
        if total >= limit:
            yield pa.concat_tables(held)
            held, total = [], 0
    if held:
        yield pa.concat_tables(held)
