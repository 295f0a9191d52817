"""Pieces of files in order, split by split: a file is never in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def stretches(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """``(new, rows)``: the task's rows in order, cut where a key changes; ``new`` unless the keys are those of the rows before."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
            here = tuple(batch.column(k)[a].as_py() for k in keys)
            yield here != before, batch.slice(a, b - a)
            before = here
