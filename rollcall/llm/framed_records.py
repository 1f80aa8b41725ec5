"""Token ids in files of length-delimited records with masked checksums, and an offset index.

A record is a frame: the length of the body (8 bytes), the masked CRC-32 of those 8 bytes,
the body, the masked CRC-32 of the body, and a line feed. The body is the document's id
(signed 64 bits; the smallest value stands for null), the bytes per token id (2 where the
vocabulary allows, else 4), and the token ids, all little-endian. The mask rotates the checksum by 15 bits and adds a constant, so that a
checksum of bytes that hold checksums stays sound. The line feed is what Spark's text sink
puts after a row: the files are written by that sink, through its commit protocol, to any
file system Spark writes to.

Files are in ascending document order, by number and within each. The index is made from the
files that were committed, and has for each record file, offset, length and the number of ids
before it, so a reader can fetch any record alone, in any order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.llm.shared import shared_folder
from rollcall.llm.words import encoder

MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
ROWS_PER_FILE = 5000
INDEX = "doc_id long, number long, part long, path string, offset long, length long, n_tokens long"


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(zlib.crc32(length))) + body + struct.pack("<I", masked(zlib.crc32(body)))


def body_at(data: bytes, offset: int) -> memoryview:
    """The body of the frame at ``offset``; a wrong checksum is an error."""
    length, check = struct.unpack_from("<QI", data, offset)
    body = memoryview(data)[offset + 12:offset + 12 + length]
    if masked(zlib.crc32(data[offset:offset + 8])) != check or len(body) != length \
            or struct.unpack_from("<I", data, offset + 12 + length)[0] != masked(zlib.crc32(body)):
        raise ValueError(f"damaged record at {offset}")
    return body


def narrow_body(doc: int | None, ids: bytes, width: int) -> bytes:
    """The body of ids that have ``width`` bytes already."""
    return struct.pack("<qB", NULL_ID if doc is None else doc, width) + ids


def body(doc: int | None, ids: bytes, width: int) -> bytes:
    """The body of ids in 32 bits."""
    return narrow_body(doc, np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes(), width)


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> None:
    """Encodes every text, appends ``end_id`` and writes the records in ascending doc_id order.

    A null id comes first; among rows with one id the text decides, and equal rows are all
    written. A null or empty text is the end id alone. An empty table gives no records.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encode = encoder(tokenizer.value)
        end = end_id.to_bytes(encode.width, "little")
        for batch in batches:
            ids, at = encode(batch.column(1))
            frames = [framed(narrow_body(doc, ids[at[i]:at[i + 1]].tobytes() + end, encode.width))
                      for i, doc in enumerate(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id") \
        .sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")) \
        .write.option("maxRecordsPerFile", ROWS_PER_FILE).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path, number of the task and of its file, content; no file is larger than its record limit allows."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(
        "path", F.regexp_extract(name, r"^part-(\d+)-", 1).cast("long").alias("number"),
        F.regexp_extract(name, r"-c(\d+)\.[^/]*$", 1).cast("long").alias("part"), "content")


def write_index(spark: SparkSession, folder: str, index_folder: str) -> None:
    """One row per record of the committed files: INDEX and ``start``, the ids before it in all files."""

    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3

    def scan(batches):
        for batch in batches:
            for path, number, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                offset, rows = 0, []
                while offset < len(data):
                    length, = struct.unpack_from("<Q", data, offset)
                    doc, width = struct.unpack_from("<qB", data, offset + 12)
                    rows.append((None if doc == NULL_ID else doc, number, part, path, offset, length, (length - 9) // width))
                    offset += length + 17
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, kind in zip(zip(*rows[at:at + 10_000]), kinds)],
                        ["doc_id", "number", "part", "path", "offset", "length", "n_tokens"])

    own = f"{index_folder}/records"
    _files(spark, folder).mapInArrow(scan, INDEX).write.parquet(own)
    records = spark.read.schema(INDEX).parquet(own)
    files = records.groupBy("number", "part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("number", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("number", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("number", "part").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    records.join(starts, ["number", "part"]).select(
        *records.columns, (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")
    ).write.parquet(f"{index_folder}/index")


def read_index(spark: SparkSession, index_folder: str) -> DataFrame:
    return spark.read.schema(INDEX + ", start long").parquet(f"{index_folder}/index")


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start and ``ids`` (bytes) of the records that ``index`` names, checksums verified.

    ``index`` may be any selection; within a file records come in the order of a hash, as a
    shuffled reader takes them, by their offsets.
    """
    wanted = index.groupBy("number", "part").agg(F.sort_array(F.collect_list(
        F.struct(F.xxhash64("doc_id", "offset").alias("draw"), "offset", "start"))).alias("at"))
    files = _files(spark, folder).join(wanted, ["number", "part"]).select("content", "at.offset", "at.start")

    def fetch(batches):
        for batch in batches:
            for data, offsets, starts in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(0, len(offsets), 1000):
                    bodies = [bytes(body_at(data, o)) for o in offsets[at:at + 1000]]
                    docs, widths = zip(*[struct.unpack_from("<qB", b) for b in bodies])
                    ids = [np.frombuffer(b, f"<u{w}", offset=9).astype("<u4").tobytes() for b, w in zip(bodies, widths)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if d == NULL_ID else d for d in docs], pa.int64()),
                         pa.array(starts[at:at + 1000], pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "ids"])

    return files.mapInArrow(fetch, "doc_id long, start long, ids binary")


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes records and index of all documents, then reads every record back through the index."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "records")
    write_records(docs, tokenizer_path, end_id, f"{folder}/data")
    write_index(spark, f"{folder}/data", folder)
    return read_records(spark, f"{folder}/data", read_index(spark, folder))
