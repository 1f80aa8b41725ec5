"""Legacy web archives to WARC: ARC volumes are parsed, and their records written anew as WARC.

Both kinds of file are sequences of gzip members, one per record. They are written by Spark's
text sink, which puts rows out byte for byte, so they go through its commit protocol to any
file system; the separator it puts after a row is an empty gzip member, which readers pass over.

An ARC volume starts with a version block whose third line names the fields of the header
lines (five in version 1, ten in version 2); each record is a header line, a network document
of the declared length, and a line feed. Of records with equal payloads the one with the
largest page_id is kept as response and the others become revisits of it; small payloads are
always responses. The decision needs digests only, so payloads never leave their volume: the
second pass over a volume reads its decisions beside it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised, shared_folder

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

LEVEL = 6
VOLUME_BYTES = 8 << 20
RECORDS_PER_WARC = 2000
LEAST_SHARED_BYTES = 1000
# Up to so many decisions are sent to all tasks instead of moving volumes to them.
FEW_REVISITS = 100_000
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

# Bytes handed to a decompressor at once; what is over at a member's end is copied, so it stays small.
SLICE = 1 << 14
RECORD = "arc string, offset long, page_id long, payload_bytes long, digest string, record_id string"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file that hold something, one at a time, read in slices of ``SLICE`` bytes."""
    view, at = memoryview(data), 0
    while at < len(view):
        opener, parts = zlib.decompressobj(31), []
        while not opener.eof and at < len(view):
            parts.append(opener.decompress(view[at:at + SLICE]))
            at = min(at + SLICE, len(view))
        if not opener.eof:
            raise ValueError("a record is cut short")
        at -= len(opener.unused_data)
        if found := b"".join(parts):
            yield found


def write_members(rows: DataFrame, folder: str, per_file: int) -> None:
    """Writes the binary column ``value``, one gzip member a row."""
    rows.select(F.col("value").cast("string")).write.options(
        lineSep=member(b"").decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=per_file).text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


# ARC

def version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n\n".encode()
    extra = "200 - - 0 volume.arc " if version == 2 else ""
    return f"filedesc://volume.arc 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """A header line, the HTTP response, a line feed. A null html is an empty payload; a null id is left out."""
    payload = (html or "").encode()
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    document = "\r\n".join(head).encode() + b"\r\n\r\n" + payload
    place = "%20".join((url or "").split()) or "no-url:"
    extra = "200 - - 0 volume.arc " if version == 2 else ""
    return f"{place} 0.0.0.0 {date} text/html {extra}{len(document)}\n".encode() + document + b"\n"


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000") -> None:
    """Pages as ARC volumes of about ``VOLUME_BYTES``, version 1 and 2 in turn; a file is a volume."""

    def run(batches):
        volume, held, version = [], 0, 1
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if not volume:
                    volume = [member(version_block(version, date))]
                record = arc_record(version, page_id, url, html, date)
                volume.append(member(record))
                held += len(record)
                if held >= VOLUME_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(volume)], pa.binary())], ["value"])
                    volume, held, version = [], 0, 3 - version
        if volume:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(volume)], pa.binary())], ["value"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value binary")
    write_members(rows, folder, 1)


def arc_records(path: str, data: bytes) -> Iterator[dict]:
    """The records of a volume: header fields by name, ``offset`` (which record), HTTP ``head`` and ``payload``."""
    fields: list[str] = []
    for offset, block in enumerate(members(data)):
        line, _, rest = block.partition(b"\n")
        length = int(line.rsplit(b" ", 1)[1])
        document = rest[:length]
        if len(document) != length:
            raise ValueError(f"{path}: record {offset} is shorter than it says")
        if not fields:
            fields = document.split(b"\n")[1].decode().split(" ")
            continue
        values = line.decode().rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"{path}: record {offset} has another version's header line")
        head, _, payload = document.partition(b"\r\n\r\n")
        yield dict(zip(fields, values)) | {"offset": offset, "head": head, "payload": payload}


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def page_of(head: bytes) -> int | None:
    found = http_field(head, b"x-page-id")
    return None if found is None else int(found)


def record_name(path: str, offset: int) -> str:
    """The same record of the same volume always gets the same identifier."""
    return f"urn:uuid:{uuid.uuid5(NAMES, f'{path}#{offset}')}"


def survey(volumes: DataFrame) -> DataFrame:
    """A small row per record, without payload."""

    def run(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(path, r["offset"], page_of(r["head"]), len(r["payload"]),
                         hashlib.sha1(r["payload"]).hexdigest(), record_name(path, r["offset"]))
                        for r in arc_records(path, data)]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     [f.split()[0] for f in RECORD.split(", ")])

    return volumes.mapInArrow(run, RECORD)


def revisits(records: DataFrame, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """arc, offset and ``refers_to`` (a record's identifier) of the records that repeat a payload.

    The response is the record with the largest page_id (a null is smallest), by identifier
    among equal ones; so each payload has exactly one.
    """
    large = records.where(F.col("payload_bytes") >= least)
    owners = large.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record_id")).alias("owner"))
    owners = owners.where("n > 1").select("digest", F.col("owner.record_id").alias("refers_to"))
    return large.join(owners, "digest").where(F.col("record_id") != F.col("refers_to")).select("arc", "offset", "refers_to")


def warc_record(record: dict, record_id: str, refers_to: str | None) -> bytes:
    """A response, or a revisit with the HTTP head alone; both digests are SHA-1 in base 32."""
    payload, head = record["payload"], record["head"] + b"\r\n\r\n"
    block = head if refers_to else head + payload
    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    date = record["Archive-date"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
             f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
             f"WARC-Target-URI: {record['URL']}", f"WARC-IP-Address: {record['IP-address']}",
             f"WARC-Payload-Digest: {sha1(payload)}", f"WARC-Block-Digest: {sha1(block)}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, work_folder: str) -> None:
    """Every record of the ARC volumes as a WARC record; ``work_folder`` holds the survey."""
    volumes = files(spark, arc_folder)
    survey(volumes).write.parquet(f"{work_folder}/survey")
    records = spark.read.schema(RECORD).parquet(f"{work_folder}/survey")
    repeated = materialised(revisits(records), "revisits")
    # A volume's decisions are at most as many as its records.
    decided = repeated.groupBy(F.col("arc").alias("path")).agg(
        F.collect_list("offset").alias("offsets"), F.collect_list("refers_to").alias("refer"))
    if repeated.count() <= FEW_REVISITS:
        decided = F.broadcast(decided)
    paired = volumes.join(decided, "path", "left").select("path", "content", "offsets", "refer")

    def run(batches):
        for batch in batches:
            for path, data, offsets, refer in zip(*(c.to_pylist() for c in batch.columns)):
                of = dict(zip(offsets or [], refer or []))
                out = [member(warc_record(r, record_name(path, r["offset"]), of.get(r["offset"])))
                       for r in arc_records(path, data)]
                for at in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(out[at:at + 1000], pa.binary())], ["value"])

    write_members(paired.mapInArrow(run, "value binary"), warc_folder, RECORDS_PER_WARC)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string, url string, date string"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives; a response whose payload doesn't fit its digest is an error."""
    names = [f.split()[0] for f in READ.split(", ")]
    kinds = [pa.int64(), pa.int64()] + [pa.string()] * 6

    def run(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for record in members(data):
                    head, _, rest = record.partition(b"\r\n\r\n")
                    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    block = rest[:int(field["Content-Length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = field["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: {field['WARC-Record-ID']} is damaged")
                    length = len(payload) if kind == "response" else int(http_field(http, b"content-length"))
                    rows.append((page_of(http), length, digest, kind, field["WARC-Record-ID"],
                                 field.get("WARC-Refers-To"), field["WARC-Target-URI"], field["WARC-Date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files(spark, folder).mapInArrow(run, READ)


def archived_and_read(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back with the page that each revisit refers to.

    One row per page row, repeated rows included; an empty table gives none.
    """
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession, "archives")
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", folder)
    read_warc(spark, f"{folder}/warc").write.parquet(f"{folder}/read")
    records = spark.read.schema(READ).parquet(f"{folder}/read")
    owners = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    same = records.where("refers_id is null").select(*records.columns, F.lit(None).cast("long").alias("refers_to"))
    return same.unionByName(records.where("refers_id is not null").join(owners, "refers_id", "left"))
