"""WARC archives, index first: records are written with their offset, length, URL and digest, and read back by coalesced byte ranges.

Every record is a gzip member of its own, so any of them can be read alone. Archives and index lie in the shared folder; archive
files are opened through pyarrow's file systems by the folder's own URI, as Spark has no reader of byte ranges.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import few_ids, slices
from pagesieve.session import cut_lineage, shared_folder

#: Payloads of at least so many bytes are written once; later ones refer to it.
LEAST_SHARED = 1000
#: An archive file is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Ranges no further apart than this are read at once, up to so many bytes (a longer record alone).
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
GZIP_LEVEL = 6

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {id}, url string, file string, offset long, length long, payload_digest string, record_type string, record_id string, target_id string, refers_to {id}"
READ = "page_id {id}, url string, record_type string, record_id string, target_id string, refers_to {id}, payload_bytes long, payload_digest string"


def record_id(*parts: Column) -> Column:
    """A URN made from what the record holds, so that every attempt of every task gives the same."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cuts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, payload_digest, record_type, record_id, target_id, refers_to)``: what is to be written.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the one with the largest page_id is the response (ties: each), the others
    revisit it. Payloads are compared by SHA-256 and length, in narrow rows combined before the shuffle; only those that occur more
    than once meet the pages again.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8").alias("payload")
    )
    equal = F.when(F.octet_length("payload") >= LEAST_SHARED, F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload")))
    keyed = rows.withColumn("equal", equal)
    shared = keyed.where("equal IS NOT NULL").groupBy("equal").agg(F.count("*").alias("n"), F.max("page_id").alias("holder"))
    shared = few_ids(cut_lineage(shared.where("n > 1 AND holder IS NOT NULL").select("equal", "holder")))
    met = keyed.join(shared, "equal", "left").withColumn("payload_digest", F.sha1("payload"))
    revisits = F.coalesce(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.lit(False))
    # the response of a shared payload is known to its revisits by page and payload alone, whatever its URL
    own = F.when(~revisits, record_id(F.lit(RESPONSE), F.col("page_id"), F.coalesce("equal", F.concat("payload_digest", F.lit("@"), F.coalesce("url", F.lit(""))))))
    return met.select(
        "page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest", F.when(revisits, REVISIT).otherwise(RESPONSE).alias("record_type"),
        F.coalesce(own, record_id(F.lit(REVISIT), F.col("page_id"), F.col("equal"), F.col("url"))).alias("record_id"),
        F.when(revisits, record_id(F.lit(RESPONSE), F.col("holder"), F.col("equal"))).alias("target_id"),
        F.when(revisits, F.col("holder")).alias("refers_to"),
    )


def header_safe(url: str | None) -> str:
    """The URL with blanks and control characters escaped, as a header field holds one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def with_fields(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record; a field without a value is left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))] if value)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def info_bytes(name: str, date: str) -> bytes:
    """The record that opens every file."""
    fields = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return with_fields(fields, b"format: WARC File Format 1.1\r\n")


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC/1.1 record with its HTTP message; a revisit has the message's head alone."""
    payload = row["payload"] or b""
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = message + payload
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", header_safe(row["url"])),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
    ]
    if row["record_type"] == REVISIT:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["target_id"])]
    return with_fields(fields, block)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields of one record and the payload of its HTTP message."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("no whole WARC record")
    return fields, block.partition(b"\r\n\r\n")[2]


def gzip_member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def arrow_schema(ddl: str, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl.format(id=kind)))


def writer(root: str, date: str, schema: pa.Schema, archive_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a task's records to files of this attempt's own; rows of an attempt that fails never reach the index."""
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in slices(batches, "payload"):
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        member = gzip_member(info_bytes(name, date))
                        out.write(member)
                        at = len(member)
                    member = gzip_member(record_bytes(row, date))
                    out.write(member)
                    rows.append({"file": name, "offset": at, "length": len(member)} | {k: row[k] for k in schema.names if k in row})
                    at += len(member)
                yield batch_of(rows, schema)
        finally:
            if out is not None:
                out.close()

    return run


def write_warc(
    pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record for every row of ``pages`` below ``root``; returns the index, a written table, one row per record.

    ``root/archive`` holds the files, ``root/index`` the table. A file of a failed attempt may be left over; no index row names it.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = pages.schema[page_id].dataType.simpleString()
    schema = arrow_schema(INDEX, kind)
    records = plan_records(pages, page_id, url, html)
    records.mapInArrow(writer(f"{root}/archive", date, schema, archive_bytes), INDEX.format(id=kind)).write.parquet(f"{root}/index")
    return records.sparkSession.read.schema(INDEX.format(id=kind)).parquet(f"{root}/index")


def ranges(rows: Iterator[dict], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[dict]]]:
    """``(file, begin, end, rows)``: index rows in order of file and offset, those that lie near one another taken together."""
    near: list[dict] = []
    end = 0
    for row in rows:
        stop = row["offset"] + row["length"]
        if near and (row["file"] != near[0]["file"] or row["offset"] > end + gap or stop - near[0]["offset"] > most):
            yield near[0]["file"], near[0]["offset"], end, near
            near = []
        end = max(end, stop) if near else stop
        near.append(row)
    if near:
        yield near[0]["file"], near[0]["offset"], end, near


def reader(root: str, schema: pa.Schema, with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        name, file = None, None
        for wanted, begin, end, rows in ranges(row for batch in batches for row in batch.to_pylist()):
            if wanted != name:
                if file is not None:
                    file.close()
                name, file = wanted, fs.open_input_file(f"{folder}/{wanted}")
            data = file.read_at(end - begin, begin)
            found = []
            for row in rows:
                at = row["offset"] - begin
                fields, payload = parse_record(zlib.decompress(data[at : at + row["length"]], 31))
                if fields["WARC-Record-ID"] != row["record_id"] or fields["WARC-Payload-Digest"] != f"sha1:{row['payload_digest']}":
                    raise ValueError(f"the index does not fit {wanted} at {row['offset']}")
                own = fields["WARC-Type"] == RESPONSE
                found.append({k: row[k] for k in ("page_id", "url", "refers_to")} | {
                    "record_type": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"], "target_id": fields.get("WARC-Refers-To"),
                    "payload_bytes": len(payload) if own else None, "payload_digest": hashlib.sha1(payload).hexdigest() if own else None,
                } | ({"payload": payload if own else None} if with_payload else {}))
            yield batch_of(found, schema)
        if file is not None:
            file.close()

    return run


def read_records(index: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """The records that rows of an index name, each as it lies in its archive: revisits have no payload, length or digest of their own.

    Rows are sorted by place and dealt out by ranges of places, so a file may be read by many tasks, each in coalesced ranges.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    ddl = READ + (", payload binary" if with_payload else "")
    ordered = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(reader(f"{root}/archive", arrow_schema(ddl, kind), with_payload), ddl.format(id=kind))


def read_pages(index: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """``read_records`` of the whole ``index`` with every revisit given the payload of the response it refers to."""
    records = cut_lineage(read_records(index, root, with_payload))
    own = ["payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]
    targets = records.where(F.col("target_id").isNotNull()).select(F.col("target_id").alias("record_id")).distinct()
    shared = records.where(F.col("record_type") == RESPONSE).join(few_ids(cut_lineage(targets)), "record_id", "left_semi")
    shared = shared.groupBy("record_id").agg(*[F.first(c).alias(c) for c in own])  # ties were written once each
    shared = shared if with_payload else few_ids(cut_lineage(shared))
    revisits = records.where(F.col("record_type") == REVISIT).drop(*own, "record_id")
    resolved = revisits.join(shared.withColumnRenamed("record_id", "target_id"), "target_id", "left")
    return records.where(F.col("record_type") == RESPONSE).drop("record_id", "target_id").unionByName(resolved.drop("target_id"))


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)`` of every page, out of the archives written for them.

    Null html is an empty payload, texts of any length are one record each. Repeated rows are a record each; where several rows share
    payload and the largest page_id, all of them are responses. A null page_id is smaller than any; equal payloads that have only
    null ids are all responses. Null or odd URLs are kept in the index and escaped in the record. No pages give no rows; other
    columns are ignored. Archives stay in the shared folder.
    """
    root = f"{shared_folder(pages.sparkSession).rstrip('/')}/pagesieve/{uuid.uuid4().hex}"
    index = write_warc(pages, root, page_id, url, html)
    return read_pages(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
