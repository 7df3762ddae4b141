"""Rows with texts, written once in blocks that later jobs read again and name by number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import returned, staged, text_bytes

#: Text of a block in bytes, or one longer text.
BLOCK_BYTES = 2 << 20


def cut(batches, size: int = BLOCK_BYTES):
    """The rows of a task as record batches of about `size` bytes of text."""
    import pyarrow as pa

    held, filled = [], 0
    for b in returned(batches):
        ends, lo = np.cumsum(np.diff(text_bytes(b.column("text"))[1])), 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = min(b.num_rows, int(np.searchsorted(ends, before + size - filled)) + 1)
            held.append(b.slice(lo, hi - lo))
            filled += int(ends[hi - 1] - before)
            lo = hi
            if filled >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, filled = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def written(docs: DataFrame, tag: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Written (block, size, n, rows): bytes of text, number of rows, and the rows packed. Block numbers are told apart, not gapless."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        first = TaskContext.get().partitionId() << 32
        for number, rows in enumerate(cut(batches, size), first):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=how) as out:
                out.write_batch(rows)
            columns = [pa.array([number]), pa.array([int(text_bytes(rows.column("text"))[1][-1])], pa.int64()), pa.array([rows.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "size", "n", "rows"])

    return staged(docs.mapInArrow(run, "block long, size long, n long, rows binary"), tag)


def opened(blob: bytes):
    """The rows of a block as a record batch."""
    import pyarrow as pa

    return pa.ipc.open_stream(blob).read_next_batch()


def each(batches):
    """(row of the table, its rows as a record batch) for each block of a task's batches; the row without what is packed."""
    for b in batches:
        names = [c for c in b.schema.names if c != "rows"]
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in names}, opened(b.column("rows")[i].as_py())
    returned([])
