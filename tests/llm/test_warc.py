"""Archives: exact round trips, the bundle format read by the library alone, and lookups by identifier."""

import base64
import hashlib
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from gridloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def sample_pages():
    rng = random.Random(4)
    body = lambda n: "".join(rng.choice("<p>é\r\n\x00WARC/1.1 日") for _ in range(n))
    shared = [body(40), body(900), ""]
    rows = [(i, f"http://h{i % 3}/{i}", rng.choice(shared) if i % 3 else body(rng.randint(0, 3000))) for i in range(90)]
    return rows + [(200, None, None), (201, "a b\r\nX: y", "\r\n\r\n"), (202, "", "x" * 700_000)]


def brute_records(rows, least=0):
    """page_id to bytes, digest, type and response for rows with distinct ids."""
    first, out = {}, {}
    for page_id, _, html in sorted(rows):
        raw = (html or "").encode()
        earlier = first.setdefault(raw, page_id)
        same = earlier != page_id and len(raw) >= least
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[page_id] = (len(raw), digest, "revisit" if same else "response", earlier if same else None)
    return out


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, least):
    rows = sample_pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path), least, frame_bytes=4096, bundle_bytes=10_000)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    texts = {i: html or "" for i, _, html in rows}
    assert len(got) == len(rows)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute_records(rows, least)
    by_record = {r.record_id: r for r in got}
    assert len(by_record) == len(rows)
    for r in got:
        whole = r if r.record_type == "response" else by_record[r.refers_to_record]
        assert whole.page_id == (r.page_id if r.refers_to is None else r.refers_to)
        assert bytes(whole.payload).decode() == texts[r.page_id]
    urls = {r.page_id: r.url for r in got}
    assert urls[0] == "http://h0/0" and urls[200] is None and urls[201] == "a%20b%0D%0AX:%20y" and urls[202] == ""


def test_bundles_are_plain_streams_with_a_seek_table(spark, tmp_path):
    rows = sample_pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path), frame_bytes=4096, bundle_bytes=10_000)
    seen, bundles = 0, spark.read.parquet(f"{tmp_path}/bundles").collect()
    assert len(bundles) > 3
    for bundle in bundles:
        data = bytes(bundle.data)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        entries = warc.seek_table(data)
        assert b"".join(warc.frame(data, e) for e in entries) == whole and len(entries) > 1
        at = 0
        while at < len(whole):
            _, _, at = warc.parsed(whole, at)
            seen += 1
    assert seen == len(rows)


def test_lookup_reads_only_the_frames_it_needs(spark, tmp_path):
    rows = sample_pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path), frame_bytes=4096, bundle_bytes=10_000)
    every = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    wanted = [r.record_id for r in every.values() if r.page_id in (3, 4, 5, 202)]
    ids = spark.createDataFrame([(i,) for i in [*wanted, wanted[0], "none"]], "record_id string")
    got = {r.record_id: r for r in warc.fetch(spark, str(tmp_path), ids).collect()}
    assert got == {i: every[i] for i in wanted}
    index = warc.read_index(spark, str(tmp_path))
    assert index.count() == len(rows) and index.select("record_id").distinct().count() == len(rows)
    # A frame that is damaged is noticed, and only by lookups that need it.
    place = index.filter(F.col("record_id") == wanted[0]).first()
    data = bytearray(spark.read.parquet(f"{tmp_path}/bundles").filter(F.col("bundle") == place.bundle).first().data)
    entries = warc.seek_table(bytes(data))
    data[entries[place.frame][0] + 10] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.frame(bytes(data), entries[place.frame])
    assert all(warc.frame(bytes(data), e) for n, e in enumerate(entries) if n != place.frame)


def test_repeated_rows_null_ids_and_other_columns(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (None, "u", "same"), (2, "u", "same"),
            (None, "u", "alone"), (None, "w", "alone"), (5, "u", None), (5, "u", None), (6, None, "")]
    frame = spark.createDataFrame([(*r, "x", True) for r in rows], SCHEMA + ", sha string, tied boolean")
    warc.write_archives(frame, f"{tmp_path}/a")
    got = [(r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, f"{tmp_path}/a").collect()]
    assert sorted(got) == sorted(
        [(1, 4, "response", 0), (1, 4, "revisit", 1), (1, 4, "revisit", 1), (0, 4, "revisit", 1), (2, 4, "revisit", 1),
         (0, 5, "response", 0), (0, 5, "revisit", 0), (5, 0, "response", 0), (5, 0, "revisit", 5), (6, 0, "revisit", 5)]
    )
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/b")
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0
    assert warc.fetch(spark, f"{tmp_path}/b", spark.createDataFrame([("x",)], "record_id string")).count() == 0
