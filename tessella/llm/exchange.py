"""Rows moved between tasks as compressed Arrow blobs, some thousands of rows each, by a bucket number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import tidy

#: Bytes that a task gathers before it sends what it has for its fullest buckets.
GATHERED = 48_000_000
#: Bytes of rows in a blob at most, but for a single row: a batch of blobs, which goes to Python at once, is bounded with it.
BLOB_BYTES = 256_000


def packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def send(batches: Iterator[tuple[np.ndarray, pa.RecordBatch]], kind: int = 0) -> Iterator[pa.RecordBatch]:
    """(bucket of each row, rows) -> record batches of (bucket, kind, blob)."""
    held: dict[int, list] = {}
    size = 0

    def flush():
        for bucket in sorted(held):
            t = pa.Table.from_batches(held[bucket]).combine_chunks()
            rows = max(1, BLOB_BYTES * t.num_rows // max(1, t.nbytes))
            for b in t.to_batches(max_chunksize=rows):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([packed(b)], pa.binary())], names=["bucket", "kind", "blob"])
        held.clear()

    for buckets, b in batches:
        if not b.num_rows:
            continue
        buckets = np.asarray(buckets)
        order = np.argsort(buckets.astype(np.uint16) if buckets.max() < 65536 else buckets, kind="stable")
        b = b.take(pa.array(order))
        values, begin = np.unique(buckets[order], return_index=True)
        for v, i, j in zip(values.tolist(), begin.tolist(), [*begin[1:].tolist(), b.num_rows]):
            held.setdefault(v, []).append(b.slice(i, j - i))
        size += b.nbytes
        if size > GATHERED:
            yield from flush()
            size = 0
    yield from flush()


#: Columns of what send() gives.
SENT = "bucket int, kind int, blob binary"


def receive(sent: DataFrame, each: Callable[[int, dict[int, pa.Table]], Iterator[pa.RecordBatch]], schema: str, partitions: int) -> DataFrame:
    """Calls each(bucket, {kind: all its rows}) in the task that has the bucket; a bucket is one task's memory."""

    def run(batches):
        now, blobs = None, {}

        def joined():
            return {k: pa.concat_tables(v).combine_chunks() for k, v in blobs.items()}

        for b in batches:
            for bucket, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if bucket != now:
                    if blobs:
                        yield from each(now, joined())
                    now, blobs = bucket, {}
                blobs.setdefault(kind, []).append(unpacked(blob.as_buffer()))
        if blobs:
            yield from each(now, joined())

    return sent.select("bucket", "kind", "blob").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), schema)
