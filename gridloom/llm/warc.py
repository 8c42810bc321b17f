"""WARC records in seekable Zstandard bundles.

A bundle is a complete ``.warc.zst`` file of some megabytes: WARC 1.1 records, grouped into
frames that can be decompressed on their own, then a skippable frame with the seek table (sizes and
checksums of the frames). Bundles are Parquet rows, so that any file system that Spark writes to will
do. Below ``path`` there are

* ``bundles``: bundle, data, and of its records, in order, record_ids, frames, offsets, lengths
* ``index``: record_id, bundle, frame, offset (within the decompressed frame), length, sorted by id

Of equal payloads the row with the smallest page_id is a response, the others revisit it and carry no
payload, neither into the archive nor through a shuffle after they are marked. Payloads are
compared by SHA-256; only narrow rows of digest and id are grouped, counted before they move.

Defined results: a null html is an empty payload. Rows without a page_id come after those with one.
Of rows that repeat page_id and payload one is the response. Payloads shorter than ``least`` bytes
are never revisited. Control characters and spaces in a url are percent-encoded, a null url has no header.
No pages give empty archives. Other columns are ignored. A record is held in memory whole, and may be
longer than a frame, which is then its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.llm.common import map_arrow, table, write_small_batches, written
from gridloom.session import scratch_folder

#: Decompressed bytes after which a frame is closed, compressed bytes after which a bundle is.
FRAME, BUNDLE, LEVEL = 128 * 1024, 4 * 1024 * 1024, 3
# Fixed values of the formats: seek table, record lines.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def seekable(frames: list[bytes], sizes: list[tuple[int, int]]) -> bytes:
    """Compressed frames with their seek table; ``sizes`` has decompressed size and checksum."""
    entries = b"".join(ENTRY.pack(len(f), size, check) for f, (size, check) in zip(frames, sizes, strict=True))
    tail = entries + FOOTER.pack(len(frames), WITH_CHECKSUMS, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(tail)) + tail


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """Start, compressed size, decompressed size and checksum of every frame."""
    count, flags, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
    start = len(data) - FOOTER.size - count * ENTRY.size
    if magic != SEEKABLE or flags != WITH_CHECKSUMS or struct.unpack_from("<I", data, start - 8)[0] != SKIPPABLE:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for entry in ENTRY.iter_unpack(data[start : len(data) - FOOTER.size]):
        out.append((at, *entry))
        at += entry[0]
    return out


def frame(data: bytes, entry: tuple[int, int, int, int]) -> bytes:
    """One frame of a bundle, decompressed alone."""
    at, packed, size, check = entry
    raw = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size or 1)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("a frame differs from its seek table")
    return raw


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items() if value is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parsed(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and the place after it."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a record")
    headers = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    return headers, raw[start:stop], stop + 4


def _page_record(row: dict, record_id: str, date: str) -> bytes:
    """The record of a page; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["html"] is None
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if row["url"] is None else UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", row["url"]),
        "WARC-Payload-Digest": f"sha1:{base32(row['sha1'])}",
        "WARC-Profile": SAME_PAYLOAD if revisit else None,
        "WARC-Refers-To": f"<urn:uuid:{response_id(row['sha'], row['first'])}>" if revisit else None,
        "X-Page-ID": row["page_id"],
        "X-Refers-To-Page-ID": row["first"] if revisit else None,
        "X-Payload-Length": row["size"],
        "Content-Type": "application/http; msgtype=response",
    }
    return record(headers, http if revisit else http + row["html"].encode())


def response_id(sha: str, page_id: int | None) -> str:
    """The identifier of the response that others revisit."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"response:{sha}:{page_id}"))


BUNDLE_SCHEMA = (
    "bundle string, data binary, record_ids array<string>, frames array<int>, offsets array<long>, lengths array<long>"
)


class _Bundle:
    """Frames and records of the bundle being filled."""

    def __init__(self) -> None:
        self.frames, self.sizes, self.buffer, self.held, self.bytes = [], [], [], 0, 0
        self.ids, self.places, self.packer = [], [], zstandard.ZstdCompressor(level=LEVEL)

    def add(self, record_id: str, raw: bytes, frame_bytes: int) -> None:
        if self.held and self.held + len(raw) > frame_bytes:
            self.close()
        self.ids.append(record_id)
        self.places.append((len(self.frames), self.held, len(raw)))
        self.buffer.append(raw)
        self.held += len(raw)

    def close(self) -> None:
        if self.held:
            raw = b"".join(self.buffer)
            self.frames.append(self.packer.compress(raw))
            self.sizes.append((len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(self.frames[-1])
            self.buffer, self.held = [], 0

    def row(self, name: str) -> dict:
        self.close()
        frames, offsets, lengths = zip(*self.places, strict=True)
        return {
            "bundle": [name], "data": [seekable(self.frames, self.sizes)], "record_ids": [self.ids],
            "frames": [list(frames)], "offsets": [list(offsets)], "lengths": [list(lengths)],
        }


def _marked(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html (null for revisits), sha, sha1, size and first (page_id of the response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    cleaned = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
    ).select(
        "*", F.sha2("html", 256).alias("sha"), F.sha1("html").alias("sha1"),
        F.octet_length("html").cast("long").alias("size"),
    )
    groups = (
        cleaned.filter(F.col("size") >= least).groupBy("sha", "page_id").agg(F.count("*").alias("n"))
        .groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("n").alias("rows"), F.max("n").alias("most"))
        .filter("rows > 1").select(F.col("sha").alias("of"), "first", (F.col("most") > 1).alias("tied"))
    )
    groups = written(groups, "payloads")
    joined = cleaned.join(groups, F.col("sha") == F.col("of"), "left")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", F.when(F.col("of").isNull() | own, F.col("html")).alias("html"),
               "sha", "sha1", "size", "first", "tied", (F.col("of").isNotNull() & own).alias("own")]
    joined = joined.select(columns)
    # Few tables repeat an id with its payload; only such rows are gathered by payload.
    if not groups.filter("tied").isEmpty():
        doubted = F.coalesce(F.col("tied") & F.col("own"), F.lit(False))
        number = F.row_number().over(Window.partitionBy("sha").orderBy("url"))
        one = joined.filter(doubted).withColumn("html", F.when(number == 1, F.col("html")))
        joined = joined.filter(~doubted).unionByName(one)
    return joined.select("page_id", "url", "html", "sha", "sha1", "size", "first")


def write_archives(
    pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z",
    frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE,
) -> None:
    """A record per row of page_id, url and html, in bundles and an index below ``path``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, number, count, bundle = TaskContext.get().partitionId(), 0, 0, _Bundle()
        for batch in batches:
            for row in batch.to_pylist():
                count += 1
                if row["html"] is not None and row["size"] >= least:
                    record_id = response_id(row["sha"], row["page_id"])
                else:
                    record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"record:{row['sha']}:{row['page_id']}:{part}:{count}"))
                bundle.add(record_id, _page_record(row, record_id, date), frame_bytes)
                if bundle.bytes >= bundle_bytes:
                    yield bundle.row(f"{part:06d}-{number:06d}")
                    number, bundle = number + 1, _Bundle()
        if bundle.ids:
            yield bundle.row(f"{part:06d}-{number:06d}")

    write_small_batches(map_arrow(_marked(pages, least), write, BUNDLE_SCHEMA), f"{path}/bundles")
    lists = ("record_ids", "frames", "offsets", "lengths")
    places = _bundles(pages.sparkSession, path).select("bundle", F.inline(F.arrays_zip(*lists)))
    index = places.toDF("bundle", "record_id", "frame", "offset", "length")
    index.sort("record_id", "bundle", "frame", "offset").write.parquet(f"{path}/index")


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE_SCHEMA).parquet(f"{path}/bundles")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    schema = "bundle string, record_id string, frame int, offset long, length long"
    return spark.read.schema(schema).parquet(f"{path}/index")


RECORD_SCHEMA = (
    "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, "
    "refers_to_record string, refers_to long, payload binary"
)


def _bare(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<urn:uuid:").removesuffix(">")


def _fields(headers: dict[str, str], block: bytes) -> list:
    """Columns of a record; the digest of a payload that is there is computed anew."""
    payload, digest = None, headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size, page_id, refers = (headers.get(f"X-{n}") for n in ("Payload-Length", "Page-ID", "Refers-To-Page-ID"))
    if headers["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != int(size) or base32(hashlib.sha1(payload).hexdigest()) != digest:
            raise ValueError("a payload differs from its digest")
    numbers = [None if x is None else int(x) for x in (page_id, size, refers)]
    return [
        _bare(headers["WARC-Record-ID"]), headers["WARC-Type"], numbers[0], headers.get("WARC-Target-URI"), numbers[1],
        digest, _bare(headers.get("WARC-Refers-To")), numbers[2], payload,
    ]


def _as_batch(records: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*records, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records, frame by frame; without ``payloads`` they are checked but not returned."""
    schema = to_arrow_schema(StructType.fromDDL(RECORD_SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                for entry in seek_table(data):
                    raw, at, records = frame(data, entry), 0, []
                    while at < len(raw):
                        headers, block, at = parsed(raw, at)
                        records.append(_fields(headers, block))
                        if not payloads:
                            records[-1][-1] = None
                    yield _as_batch(records, schema)

    return _bundles(spark, path).select("data").mapInArrow(read, RECORD_SCHEMA)


def fetch(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """The records with the given record_id, found by the index; other frames are not decompressed."""
    schema = to_arrow_schema(StructType.fromDDL(RECORD_SCHEMA))
    # At most the records of one bundle in each list.
    wanted = (
        read_index(spark, path).join(record_ids.select("record_id").distinct(), "record_id")
        .groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "length"))).alias("places"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries, records, opened, raw = seek_table(row["data"]), [], None, b""
                for place in row["places"]:
                    if place["frame"] != opened:
                        opened = place["frame"]
                        raw = frame(row["data"], entries[opened])
                    one = raw[place["offset"] : place["offset"] + place["length"]]
                    records.append(_fields(*parsed(one)[:2]))
                yield _as_batch(records, schema)

    found = _bundles(spark, path).select("bundle", "data").join(wanted, "bundle")
    return found.select("data", "places").mapInArrow(read, RECORD_SCHEMA)


def op13_archives(spark, folder: str) -> DataFrame:
    path = scratch_folder(spark, "archives")
    write_archives(table(spark, folder, "pages"), path)
    return read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP13_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) // CAST(power(32, 3 - i % 4) AS INTEGER)) % 32 + 1
              AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
