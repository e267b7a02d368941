"""Runs of rows with one key, for mapInArrow over partitions sorted by that key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_key(n: int, one):
    """For mapInArrow: one(key, columns) for each run of rows equal in the first n columns, all of them integers.

    columns are the others by name, as Arrow arrays. A run may span batches; only one run is held at a time. Small results of many runs
    leave together."""

    def run(batches):
        done, rows = [], 0
        for b in each(batches):
            done.append(b)
            rows += b.num_rows
            if rows >= 2000 or len(done) >= 1000:
                yield together(done)
                done, rows = [], 0
        if done:
            yield together(done)

    def together(done):
        return done[0] if len(done) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*(b.columns for b in done))], schema=done[0].schema)

    def each(batches):
        key, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in range(n)])
            cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [b.num_rows]))
            for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                now = tuple(keys[:, at].tolist())
                if now != key and parts:
                    yield from one(key, _joined(parts, n))
                    parts = []
                key = now
                parts.append(b.slice(at, end - at))
        if parts:
            yield from one(key, _joined(parts, n))

    return run


def _joined(parts: list[pa.RecordBatch], n: int) -> dict:
    names = parts[0].schema.names
    return {names[i]: parts[0].column(i) if len(parts) == 1 else pa.concat_arrays([p.column(i) for p in parts]) for i in range(n, len(names))}


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
