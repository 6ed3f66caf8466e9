"""WARC archives: a writer with revisit records, and a reader whose tasks take byte ranges of the archives."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.functions.durable import ensure_checkpoint_dir
from quillmart.llm.common import durable
from quillmart.operators.hot import hot_keys, join_unique

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
#: Start of every gzip member, by which byte ranges are cut into candidates.
MAGIC = b"\x1f\x8b\x08"
RECORD_ID, REVISIT = "urn:quillmart:page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
READ = "record_id string, record_type string, refers_to_id string, url string, payload_bytes long, payload_digest string, intact boolean, payload binary, _file string, _start long, _part long, _rest binary"


def _member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _written(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """One gzip member for each page."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, out = batch.slice(at, 256), []
            for id_, url, body, keep in zip(*(part[c].to_pylist() for c in ("page_id", "url", "body", "refers_to")), strict=True):
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                fields = [("WARC-Type", "response" if keep is None else "revisit"), ("WARC-Record-ID", f"<{RECORD_ID}{'-' if id_ is None else id_}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if url is not None:
                    # control characters would end the field
                    fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
                if keep is not None:
                    fields += [("WARC-Refers-To", f"<{RECORD_ID}{keep}>"), ("WARC-Profile", REVISIT)]
                out.append(_member(_record(fields, HTTP + str(len(body)).encode() + b"\r\n\r\n" + (body if keep is None else b""))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, body (UTF-8 bytes of html) and refers_to (null where the record is written in full).

    Payloads are equal by length and SHA-256. Groups are found by partial sums of digests; pages move once, by
    digest, and those of a payload with very many copies not at all. Of a group the rows with the largest page_id are
    written in full (all of them, if rows repeat it), the others refer to it; in a group without any id all are.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    long = F.octet_length("body") >= LEAST_REVISIT
    rows = pages.select("page_id", "url", body.alias("body"))
    keyed = rows.withColumn("same", F.when(long, F.concat(F.octet_length("body").cast("string"), F.lit(":"), F.sha2("body", 256))))
    digests = durable(keyed.where("same is not null").select("page_id", "same"))
    groups = digests.groupBy("same").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and keep is not null").select("same", "keep")
    found = join_unique(keyed.where("same is not null"), groups, "same", hot_keys(digests, "same"), "left")
    short = keyed.where("same is null").withColumn("keep", F.lit(None).cast("long"))
    return found.unionByName(short).select("page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record for each page (page_id, url, html) into archives in ``folder``, one gzip member a record.

    Spark's text sink writes the members as they are, to any store that Spark writes, and commits each task's file as
    a whole. What it puts after each row is an empty gzip member, so a file is a valid sequence of members throughout.
    The same pages give the same records; ``date`` is the WARC-Date of all of them.

    A null html is an empty payload, a null url leaves out the target, a null page_id is written as ``-``. Control
    characters of a url are percent-encoded. An empty table gives a folder without records; other columns are ignored.
    """
    members = with_revisits(pages).mapInArrow(functools.partial(_written, date=date), "member binary")
    sink = members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
    sink.option("lineSep", _member(b"").decode("latin-1")).text(folder)


class _Candidate:
    """A gzip member that begins at a magic; parts are added until it is whole or cannot be one."""

    def __init__(self) -> None:
        self.inflate, self.parts, self.out = zlib.decompressobj(31), [], []
        self.valid, self.seen = True, b""

    def add(self, part: bytes) -> None:
        """A decoded text must be empty or begin as a WARC record does; else this is no member, or not one of ours."""
        self.parts.append(part)
        try:
            data = self.inflate.decompress(part)
        except zlib.error:
            self.valid = False
            return
        self.out.append(data)
        self.seen = (self.seen + data)[:5]
        # zeros may pad a member, as gzip allows
        self.valid = b"WARC/".startswith(self.seen) and not self.inflate.unused_data.strip(b"\0")

    @property
    def whole(self) -> bool:
        """Checksum and length at its end have been read, and what it holds is nothing or a record."""
        return self.valid and self.inflate.eof and self.seen in (b"", b"WARC/")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields (lower-case names) and payload of a record: of an http message what follows its head. None if it is cut."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not found or not length.isdigit() or len(rest) < int(length):
        return None
    block = rest[: int(length)]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def _row(data: bytes, payloads: bool) -> tuple | None:
    parsed = parse_record(data)
    if parsed is None:
        return None
    fields, payload = parsed
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    hex_ = hashlib.sha1(payload).hexdigest()
    if stated.lower().startswith("sha1:"):
        value = stated[5:]
        try:
            written = value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
        except ValueError:  # neither hexadecimal nor base 32
            written = value
    else:
        written = hex_
    revisit = kind == "revisit"
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    return (bare("warc-record-id"), kind, bare("warc-refers-to"), fields.get("warc-target-uri"), None if revisit else len(payload), written if revisit else hex_, revisit or written == hex_, payload if payloads and not revisit else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch["file"][i].as_py(), batch["start"][i].as_py(), batch["part"][i].as_py(), batch["bytes"][i].as_py()


def _no_record(file: str, start: int, part: int, rest: bytes) -> tuple:
    return (*[None] * 8, file, start, part, rest)


def _members(batches: Iterator[pa.RecordBatch], payloads: bool, scope: str) -> Iterator[pa.RecordBatch]:
    """Records of the members that begin in a byte range (scope ``range``), in what ranges left over (``rest``), or in a
    whole file (``file``).

    Parts run from one magic to the next. A part that is no whole member is joined with those after it, since the magic
    that ends it lies inside compressed data. What a range has left over at either end, where such a member spans two
    ranges, is passed on with its place. What is then no member marks its file as one to be read in order (an empty
    rest); in a file that is read in order it is an error.
    """
    rows: list[tuple] = []
    held: list[tuple[str, int, int, bytes]] = []  # parts not yet in a whole member
    candidate: _Candidate | None = None
    here: tuple[str, int] | None = None
    skipped = ""  # a file that has been marked

    def left_over() -> None:
        nonlocal skipped
        if held and scope == "file":
            raise ValueError(f"{held[0][0]} holds bytes that are no gzip member of a WARC record, from its byte range {held[0][1]} on")
        if held and scope == "rest":
            skipped = held[0][0]
            rows.append(_no_record(*held[0][:3], b""))
        elif held:
            rows.extend(_no_record(*x) for x in held)
        held.clear()

    for file, start, part, data in _parts(batches):
        if here is None or file != here[0] or (scope == "range" and start != here[1]):
            left_over()
            candidate = None
            # only what stands in front of a file's first magic has none itself; it is empty in a sound archive
            headless = scope != "rest" and start == 0
            here = (file, start)
            if headless and not data:
                continue
            data = data if headless or scope == "rest" else MAGIC + data
        elif scope != "rest":
            data = MAGIC + data
        if scope == "rest" and file == skipped:
            continue
        held.append((file, start, part, data))
        candidate = candidate or _Candidate()
        candidate.add(data)
        if not candidate.valid:
            left_over()  # in a range: the end of a member that begins in an earlier one
            candidate = None
        elif candidate.whole:
            text = b"".join(candidate.out)
            row = _row(text, payloads) if text else None
            if text and row is None:
                left_over()
            elif row:
                rows.append((*row, file, None, None, None))
            held.clear()
            candidate = None
        if len(rows) >= 256:
            yield _batch(rows)
            rows = []
    left_over()
    yield _batch(rows)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """record_id, record_type, refers_to_id, url, payload_bytes, payload_digest, intact and payload of every record.

    Spark's text source splits the archives into byte ranges (``spark.sql.files.maxPartitionBytes``), looks for the
    gzip magic and gives each range what begins inside it. A candidate counts as a member once its header, data and
    checksum decode and it holds a WARC record; a magic inside compressed data joins its two sides again. Members that
    span ranges in this way are put together from what the ranges left over, which is at most a member for each range.
    If a range begins inside a payload that holds whole archived members itself, these are taken for records there, but
    the member around them is then left over in pieces: such a file is read again in order, by one task, and only that.

    A revisit has no payload of its own: payload_bytes is null and the digest is that of its header; ``intact`` says
    whether the digest of a payload is the one that was written. Empty members are no records. Bytes that belong to no
    member, cut members and cut records are errors. Repeated records are read as often as they stand. Names must not
    end in ``.gz``, since Hadoop would unpack such a file as one stream. The rows are durable: archives may be deleted.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(folder)
    parts = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("part"), F.col("value").cast("binary").alias("bytes"))
    members = lambda rows, scope: rows.mapInArrow(functools.partial(_members, payloads=payloads, scope=scope), READ)
    in_order = lambda rows: rows.repartition("file").sortWithinPartitions("file", "start", "part")
    read = durable(members(parts, "range"))
    rest = read.where("_rest is not null").select(F.col("_file").alias("file"), F.col("_start").alias("start"), F.col("_part").alias("part"), F.col("_rest").alias("bytes"))
    read = read.where("_rest is null")
    if not rest.isEmpty():
        joined = durable(members(in_order(rest), "rest"))
        read = read.unionByName(joined.where("_rest is null"))
        marked = joined.where("_rest is not null").select("_file").distinct()
        if not marked.isEmpty():
            again = members(in_order(parts.join(marked, F.col("file") == F.col("_file"), "left_semi")), "file")
            read = read.join(marked, "_file", "left_anti").unionByName(durable(again))
    return read.drop("_file", "_start", "_part", "_rest")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The records with payload_bytes and payload_digest of what each revisit refers to; facts move, payloads do not.

    Revisits of one response may be a large share of all records: its facts are broadcast, the records stay in place.
    """
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    facts = records.where("record_type = 'response' and record_id is not null").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("of"))
    resolved = join_unique(revisits, facts, "refers_to_id", hot_keys(revisits, "refers_to_id"), "left").select(*[c for c in revisits.columns], F.col("of.payload_bytes"), F.col("of.payload_digest"))
    return records.where("record_type <> 'revisit'").unionByName(resolved)


def page_of(record_id: str | Column) -> Column:
    return F.regexp_extract(record_id, rf"^{RECORD_ID}(-?[0-9]+)$", 1).try_cast("long")


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared checkpoint folder, read these back, and report every page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, as read; a page whose digest does not fit its
    payload is an error. Rows with a null page_id keep it. See write_archives and read_archives for awkward rows.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    records = resolve_revisits(read_archives(spark, folder, payloads=False))
    delete_folder(spark, folder)
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not fit its digest")))
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", page_of("refers_to_id").alias("refers_to"))


OP13_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
  SELECT page_id, n, sha1(body) AS digest,
         CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS keep FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN keep IS DISTINCT FROM page_id AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to
FROM k
"""
