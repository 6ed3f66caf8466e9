"""WARC archives: round trips, byte ranges of any size, members that hold magics, awkward pages."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmart.llm import warc

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "a long page über all " * 80 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def brute(rows):
    bodies = [(h or "").encode() for _, _, h in rows]
    keep = {}
    for (i, _, _), b in zip(rows, bodies, strict=True):
        if len(b) >= 1000 and i is not None:
            keep[b] = max(i, keep.get(b, i))
    out = []
    for (i, _, _), b in zip(rows, bodies, strict=True):
        k = keep.get(b)
        to = None if k == i else k
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def got(df):
    found = warc.archived_pages(df)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


EDGE = [
    (1, "http://a.example/", LONG), (7, "http://b.example/", LONG), (3, None, LONG), (None, "http://c.example/", LONG),
    (4, "http://d.example/\r\nWARC-Type: revisit", "x" * 999), (5, "", "x" * 999), (6, "http://e.example/ü", None), (8, "http://f.example/", ""),
    (9, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (None, None, "z" * 2000), (None, None, "z" * 2000),
    (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (12, "u", "é" * 500), (13, "u", "\x1f\x00\x08" * 50), (-14, "u", LONG + " "),
]


def test_edges(spark):
    wide = pages(spark, EDGE).select("*", *[F.lit(f"other {c}").alias(c) for c in ("body", "same", "keep", "refers_to", "file", "start", "part", "copies")])
    assert got(wide) == brute(EDGE)
    assert got(pages(spark, [])) == []


def test_a_payload_with_very_many_copies(spark):
    rows = [(i, "u", LONG if i % 3 == 0 else f"page {i} " * 200) for i in range(3000)]
    assert got(pages(spark, rows).repartition(5)) == brute(rows)


@pytest.mark.parametrize("size", [97, 1000, 40_000])
def test_byte_ranges_of_any_size(spark, sf_dir, size, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").orderBy("page_id").limit(8 if size < 100 else 200).collect()]
    folder = f"{tmp_path}/archive"
    warc.write_archives(pages(spark, rows).repartition(2), folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        read = warc.read_archives(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["record_id"], r["url"], bytes(r["payload"]).decode()) for r in read) == sorted((f"{warc.RECORD_ID}{i}", u, h) for i, u, h in rows)
    assert all(r["intact"] and r["record_type"] == "response" for r in read)


def test_archives_are_plain_multi_member_gzip(spark, tmp_path):
    folder = tmp_path / "archive"
    warc.write_archives(pages(spark, EDGE).coalesce(1), str(folder))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(folder.glob("part*")))
    assert text.count(b"WARC-Record-ID: <urn:quillmart:page:") == len(EDGE) and text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def stored(data):
    """A gzip member whose data stand in it as they are."""
    deflate = zlib.compressobj(0, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def record(name, payload):
    return warc._record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{name}>")], payload)


def read_with(spark, folder, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return sorted((r["record_id"], bytes(r["payload"])) for r in warc.read_archives(spark, str(folder)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", [61, 500, 3000, 1_000_000])
def test_magics_inside_of_stored_members(spark, tmp_path, size):
    rnd = random.Random(size)
    noise = lambda n: b"".join(rnd.choice([warc.MAGIC, warc.MAGIC[:2], b"\x1f", b"plain", rnd.randbytes(7)]) for _ in range(n))
    wanted = [(f"r{i:02}", noise(rnd.randrange(60))) for i in range(40)]
    for k in range(2):
        (tmp_path / f"part{k}").write_bytes(b"".join(stored(record(*x)) for x in wanted[k::2]))
    assert read_with(spark, tmp_path, size) == wanted


@pytest.mark.parametrize("size", [150, 700, 1_000_000])
def test_archives_inside_of_payloads(spark, tmp_path, size):
    inner = b"".join(stored(record(f"inner{i}", b"within " * 9)) for i in range(9))
    wanted = [("a", b"before"), ("b", inner), ("c", b"after")]
    (tmp_path / "nested").write_bytes(b"".join(stored(record(*x)) for x in wanted))
    (tmp_path / "other").write_bytes(stored(record("d", b"own")))
    assert read_with(spark, tmp_path, size) == [*wanted, ("d", b"own")]


@pytest.mark.parametrize("broken", [b"no archive", stored(record("a", b"x"))[:-3], stored(record("a", b"x")[:-8]), warc.MAGIC * 3])
def test_broken_archives_are_errors(spark, tmp_path, broken):
    (tmp_path / "broken").write_bytes(stored(record("z", b"y")) + broken)
    with pytest.raises(Exception, match="no gzip member"):
        read_with(spark, tmp_path, 1_000_000)


def test_changed_payloads_are_not_intact(spark, tmp_path):
    fields = [("WARC-Type", "resource"), ("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(b'was').hexdigest()}")]
    (tmp_path / "changed").write_bytes(stored(warc._record(fields, b"is")) + stored(warc._record(fields, b"was")))
    assert sorted((bytes(r["payload"]), r["intact"]) for r in warc.read_archives(spark, str(tmp_path)).collect()) == [(b"is", False), (b"was", True)]
