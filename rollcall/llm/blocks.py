"""Whole rows packed into compressed blocks of a few megabytes, so that what belongs to a row
can travel as (block, place) and rows can be fetched again at a third of their size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20


def squeezed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return zstandard.ZstdCompressor(level=6).compress(sink.getvalue().to_pybytes())


def unpacked(rows: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block`` and ``rows``: consecutive rows of about ``block_bytes`` in all.

    They are written once, as a table bucketed by block in the warehouse, so that later joins
    by block move only what comes to the blocks. Columns go by their place inside a block, so
    clashing names do no harm.
    """
    spark = docs.sparkSession

    def run(batches):
        parts, size, made = [], 0, 0

        def block():
            nonlocal parts, size, made
            made += 1
            number, rows = TaskContext.get().partitionId() << 32 | made, squeezed(pa.Table.from_batches(parts))
            parts, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows], pa.binary())], ["block", "rows"])

        for batch in batches:
            held = pa.RecordBatch.from_arrays(batch.columns, [str(i) for i in range(batch.num_columns)])
            step = max(1, held.num_rows * block_bytes // max(held.nbytes, 1))
            for at in range(0, held.num_rows, step):
                part = held.slice(at, step)
                parts.append(part)
                size += held.nbytes * part.num_rows // held.num_rows
                if size >= block_bytes:
                    yield block()
        if parts:
            yield block()

    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"blocks_{uuid.uuid4().hex}"
    made = docs.mapInArrow(run, "block long, rows binary").repartition(buckets, "block")
    made.write.bucketBy(buckets, "block").format("parquet").saveAsTable(name)
    return spark.table(name)


def each(blocks: DataFrame, work, schema, *columns: str) -> DataFrame:
    """``work(block number, rows, further columns...)`` gives record batches for each block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, rows, *rest = (c[i].as_py() for c in batch.columns)
                yield from work(number, unpacked(rows), *rest)

    return blocks.select("block", "rows", *columns).mapInArrow(run, schema)
