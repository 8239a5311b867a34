"""WARC archives: an index first, then coalesced byte-range reads of the selected records.

`write` puts one gzip member a record into one archive a task and returns the index: offset, length,
URL and digest of each record. The number of archives follows from the bytes, whatever the partitions
of the input or of shuffles: small partitions are written together. `read` takes any rows of an index, sorts them by archive and offset,
joins neighbouring ranges into one read each, and parses the records out of what it read.

Of records with equal payloads that with the smallest page id is a response and the others are
revisits that refer to it. Null html is an empty payload, a null url an empty one. Rows with a null page_id
are not written. Repeated page ids: each row is a record, and all rows of the smallest id are responses. Other columns are ignored. An empty table gives an empty index.

Archives lie in a shared folder, under names of their own for each task attempt; only archives of
attempts that succeeded are named in the index, so retries and lost executors leave no wrong record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._common import fresh_path, text_bytes

INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
INDEX_TYPES = {"archive": pa.string(), "offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
RECORD_TYPES = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
READ_BYTES = 4 << 20  # a coalesced read is at most so long, unless one record is longer
GAP_BYTES = 64 << 10  # unselected bytes that may be read along
ARCHIVE_BYTES = 16 << 20  # partitions are joined up to so many payload bytes an archive, but to no fewer than there are cores

_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"  # records carry no crawl time of their own


def _record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID, f'page/{page_id}')}>"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder: a URI, or a path of this machine.

    Spark's names of object stores are those of other libraries with another scheme; a store that Arrow can't
    reach is an error that names it.
    """
    if not re.match(r"\w+:/", folder):
        return fs.LocalFileSystem(), folder
    uri = re.sub(r"^s3[an]:", "s3:", folder)
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archives can't be written to {folder}: Arrow has no file system for it") from e


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as an Arrow batch, in which integers stay what they are beside nulls."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record: a response with its payload, or a revisit with headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one uncompressed record; a response's payload is checked against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To-Page-ID")
    return {
        "page_id": int(fields["WARC-Page-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": None if refers is None else int(refers), "payload": payload if kind == "response" else None,
    }


def assign(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to (null: a response) of every page.

    Copies are found from digests and lengths alone: the smallest page of each digest by partial
    aggregation, joined to the other pages of the digests that occur more than once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.filter("page_id is not null").withColumn("sha1", F.sha1("payload"))
    sized = rows.filter(F.octet_length("payload") >= least_bytes).select("page_id", "sha1")
    first = sized.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to <> last")
    copies = sized.join(first.drop("last"), "sha1").filter("page_id <> refers_to").distinct()
    return rows.join(copies, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", "refers_to")


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives below `folder` and return the index, itself a Parquet table in that folder.

    Each file has a cost of its own: on file systems of this machine Hadoop starts processes to set its permissions, which for
    a moment share all memory of the executor.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    archives = max(spark.sparkContext.defaultParallelism, -(-text_bytes(pages, "html") // archive_bytes))
    marked = assign(pages, least_bytes).coalesce(archives)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = name = None
        at = 0
        for batch in batches:
            out = []
            for page_id, sha1, url, payload, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "sha1", "url", "payload", "refers_to")), strict=True):
                if archive is None:
                    system, path = _place(folder)
                    system.create_dir(path, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    archive = system.open_output_stream(f"{path}/{name}", compression=None)
                digest = _base32(bytes.fromhex(sha1))
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, digest, refers)) + packer.flush()
                archive.write(member)
                out.append((name, at, len(member), page_id, url, digest, "response" if refers is None else "revisit", refers))
                at += len(member)
            yield _rows(out, INDEX_TYPES)
        if archive is not None:
            archive.close()

    marked.mapInArrow(store, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def read(index: DataFrame, read_bytes: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records of an index's rows.

    A window over each archive starts a new read where the gap is wide, or a read has grown long;
    each read is then one task row with its records' offsets.
    """
    by_offset = Window.partitionBy("folder", "archive").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(by_offset)
    rows = index.select("folder", "archive", "offset", "length")
    rows = rows.withColumn("piece", F.floor(F.col("offset") / read_bytes))
    rows = rows.withColumn("jump", F.when(before.isNull() | (F.col("offset") - before > gap), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("jump").over(by_offset))
    ranges = rows.groupBy("folder", "archive", "run", "piece").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"))
    ranges = ranges.repartition(max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive", "run", "piece")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, archive, parts in zip(*(batch[c].to_pylist() for c in ("folder", "archive", "parts")), strict=True):
                system, path = _place(folder)
                begin = parts[0]["offset"]
                with system.open_input_file(f"{path}/{archive}") as f:
                    data = f.read_at(parts[-1]["offset"] + parts[-1]["length"] - begin, begin)
                yield _rows([tuple(parse(zlib.decompress(data[p["offset"] - begin : p["offset"] - begin + p["length"]], 31)).values()) for p in parts], RECORD_TYPES)

    return ranges.mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back."""
    return read(write(pages)).drop("payload")

