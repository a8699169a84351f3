"""Groups of rows inside a task whose partition is sorted by their keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def keyed_groups(batches, keys: int):
    """Yield (batch, starts): batches of whole groups and where each group starts. The first ``keys`` columns
    are the (non-null) key. Only a group that a batch cuts is carried over to the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.stack([whole.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        if len(start) > 1:
            yield whole.slice(0, start[-1]), start[:-1]
        held = whole.slice(start[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)
