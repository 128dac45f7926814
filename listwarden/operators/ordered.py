"""Tables in the order of a whole-number column, with little to shuffle.

Rows with long texts cross the shuffle of a sort one by one, each compressed with its neighbours
of the moment at best. Here the rows of a task that go to the same part are packed first:
one block of columns, compressed as a whole. A block is opened where its part is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one part, which is sorted by one task; equal values are in one part.
PART_ROWS = 100_000
#: Bytes of rows that a task holds before they are packed.
HELD_BYTES = 64 << 20
#: Parts beyond this get more rows instead: the driver knows where each part ends.
MAX_PARTS = 100_000


def sorted_table(df: DataFrame, by: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``df.orderBy(by)`` for a column of whole numbers; nulls come first."""
    names, by = df.columns, f"c{df.columns.index(by)}"
    table = df.toDF(*[f"c{at}" for at in range(len(names))])  # Python functions take no dots in names
    parts = min(MAX_PARTS, -(-table.count() // part_rows))
    ends = _ends(table, by, parts) if parts > 1 else []
    packed = table.mapInArrow(_packing(by, ends, HELD_BYTES), "part int, rows binary")
    dealt = packed.repartitionById(len(ends) + 1, "part").select("rows")
    return dealt.mapInArrow(_opening(), table.schema).sortWithinPartitions(by).toDF(*names)


def _ends(df: DataFrame, by: str, parts: int) -> list[int]:
    """The last value of each part but the last one: quantiles, so parts are about equal."""
    shares = F.array(*[F.lit(at / parts) for at in range(1, parts)])
    found = df.agg(F.percentile_approx(by, shares, F.lit(max(10_000, 20 * parts)))).first()[0]
    return sorted(set(found or []))


def _packing(by: str, ends: list[int], held_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        limits, held, size = np.array(ends, dtype="int64"), {}, 0

        def blocks():
            for part in sorted(held):
                sink = pa.BufferOutputStream()
                whole = pa.Table.from_batches(held[part]).combine_chunks()
                with pa.ipc.new_stream(sink, whole.schema, options=options) as stream:
                    stream.write_table(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()])],
                    ["part", "rows"])

        for batch in batches:
            values = batch.column(batch.schema.get_field_index(by)).cast(pa.int64())
            known = values.fill_null(np.iinfo("int64").min).to_numpy()
            part = np.searchsorted(limits, known, side="left")
            order = np.argsort(part, kind="stable")
            moved, part = batch.take(pa.array(order)), part[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            for start, end in zip(starts, [*starts[1:], len(part)]):
                held.setdefault(int(part[start]), []).append(moved.slice(start, end - start))
            size += moved.nbytes
            if size >= held_bytes:
                yield from blocks()
                held, size = {}, 0
        yield from blocks()

    return pack


def _opening():
    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for block in batch.column(0):
                with pa.ipc.open_stream(block.as_buffer()) as stream:
                    yield from stream

    return open_blocks
