"""WARC archives by a chunked record table.

A page becomes rows (record, chunk number, chunk) with running digests; a
payload beyond the chunk size goes on in continuation records, so neither
writing nor reading ever allocates a whole record again. Every record is a
gzip member of its own in ``.warc.gz`` files that begin with a warcinfo record.
Spark's text sink writes and its text source reads the files: any shared store
serves, and lost tasks are run again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_path, shuffle_width

CHUNK_BYTES = 1 << 20
_BATCH_BYTES = 4 << 20
_END = b"\r\n\r\n"
#: The last byte of a gzip member, the high one of its 32-bit length, is zero for any record below 16 MiB: the text sink writes it as its line separator.
_MEMBER_END = "\0"
_MOST_CHUNK_BYTES = 8 << 20
_CHUNK_KINDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("copy", pa.int32()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("chunk_digest", pa.string()), ("data", pa.binary()),
])
_CHUNK_SCHEMA = "page_id long, url string, record_type string, refers_to long, copy int, payload_bytes long, payload_digest string, chunk int, last boolean, chunk_digest string, data binary"
_READ_KINDS = pa.schema([
    ("page_id", pa.int64()), ("copy", pa.int32()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("chunk", pa.int32()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()),
])
_READ_SCHEMA = "page_id long, copy int, record_type string, refers_to long, url string, chunk int, last boolean, payload_bytes long, payload_digest string, data binary"


def roles(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with record_type, refers_to, copy (number among rows of equal id and payload), size and SHA-1.

    Of payloads equal by length and SHA-1 and of at least ``least_bytes`` bytes, the smallest
    page_id is the response (null ids come last); a hot payload is dealt out by a hash of the id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha", F.concat(F.sha1(F.col("html").cast("binary")), F.lit("-"), F.col("payload_bytes").cast("string")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(4), "page_id"), F.lit(shuffle_width(pages.sparkSession))))
    local = rows.groupBy("sha", "salt").agg(F.min("page_id").alias("m"))
    first = local.join(local.groupBy("sha").agg(F.min("m").alias("first")), "sha").select("sha", "salt", "first")
    same = Window.partitionBy("sha", "salt", "page_id").orderBy("url")
    dealt = rows.join(first, ["sha", "salt"]).withColumn("copy", F.row_number().over(same))
    response = (F.col("payload_bytes") < least_bytes) | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    return dealt.select("page_id", "url", "html", "payload_bytes", F.substring("sha", 1, 40).alias("sha"), "copy", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("first")).alias("refers_to"))


def _base32(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def _batches(rows: Iterator[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some megabytes; the last field of a row is its data."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 200
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)


def _cut(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple]:
    """Rows of the chunk table from batches of ``roles``."""
    for b in batches:
        html = b.column("html").cast(pa.large_string())
        _, offsets, data = html.buffers()
        offsets = memoryview(offsets).cast("q")[html.offset : html.offset + len(html) + 1]
        view = memoryview(data) if data else memoryview(b"")
        others = [b.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "copy", "payload_bytes", "sha")]
        for i, (page, url, kind, refers, copy, size, sha) in enumerate(zip(*others)):
            digest = _base32(bytes.fromhex(sha))
            head = (page, url, kind, refers, copy, size, digest)
            if kind == "revisit":
                yield (*head, 0, True, digest, b"")
                continue
            at, end, running, chunk = offsets[i], offsets[i + 1], hashlib.sha1(), 0
            while chunk == 0 or at < end:
                stop = min(end, at + chunk_bytes)
                while stop < end and view[stop] & 0xC0 == 0x80:
                    stop -= 1
                part = bytes(view[at:stop])
                running.update(part)
                yield (*head, chunk, stop == end, _base32(running.digest()), part)
                at, chunk = stop, chunk + 1


def _for_python(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", "payload_bytes", "sha", "copy", "record_type", "refers_to")


def _checked(chunk_bytes: int) -> int:
    if not 4 <= chunk_bytes <= _MOST_CHUNK_BYTES:
        raise ValueError(f"chunks have 4 to {_MOST_CHUNK_BYTES} bytes")
    return chunk_bytes


def chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of ``roles``: chunks end between characters; chunk_digest covers the payload so far."""
    most = _checked(chunk_bytes)
    return _for_python(pages).mapInArrow(lambda batches: _batches(_cut(batches, most), _CHUNK_KINDS), _CHUNK_SCHEMA)


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{key}: {value}" for key, value in [*fields, ("Content-Length", str(len(block)))] if value is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + _END + block + _END


def _name(page: int | None, copy: int) -> str:
    return f"<urn:x-page:{'none' if page is None else page}:{copy}>"


def _records(rows: Iterator[tuple], date: str) -> Iterator[bytes]:
    """The records of a file: a warcinfo record, then one a chunk."""
    begun = False
    for page, url, kind, refers, copy, size, digest, chunk, last, so_far, data in rows:
        if not begun:
            begun = True
            yield _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-page:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        own, first = _name(page, copy), chunk == 0
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        if first:
            revisit = kind == "revisit"
            yield _record([
                ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7F]", "%20", url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None), ("WARC-Refers-To", _name(refers, 1) if revisit else None), ("WARC-Segment-Number", None if last else "1"),
                ("X-Page-Id", None if page is None else str(page)), ("X-Page-Copy", str(copy)), ("X-Payload-Length", str(size)), ("X-Chunk-Digest", f"sha1:{so_far}"), ("Content-Type", "application/http; msgtype=response"),
            ], http + data)
        else:
            yield _record([
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-page-part:{own[12:-1]}:{chunk}>"), ("WARC-Date", date), ("WARC-Segment-Number", str(chunk + 1)), ("WARC-Segment-Origin-ID", own),
                ("WARC-Segment-Total-Length", str(size + len(http)) if last else None), ("X-Chunk-Digest", f"sha1:{so_far}"),
            ], data)


def _finish(spark: SparkSession, path: str, threads: int = 16) -> None:
    """Give the written files their names; files without a record go. Moves no data where the store renames."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path
    folder = at(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    files = [(str(f.getPath().getName()), int(f.getLen())) for f in fs.listStatus(folder)]

    def name(file: tuple[str, int]) -> None:
        old = at(folder, file[0])
        if not (fs.rename(old, at(folder, file[0].removesuffix(".txt") + ".warc.gz")) if file[1] else fs.delete(old, False)):
            raise OSError(f"{path}/{file[0]} could not be renamed")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(name, [f for f in files if f[0].endswith(".txt")]))


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES, least_bytes: int = 0, **columns) -> None:
    """Archives of WARC/1.1 files in folder ``path``, a gzip member a record."""
    most, kinds = _checked(chunk_bytes), pa.schema([("value", pa.binary())])

    def members(batches):
        def packed():
            for record in _records(_cut(batches, most), date):
                member = gzip.compress(record, 6, mtime=0)
                assert member[-1] == 0
                yield (member[:-1],)

        return _batches(packed(), kinds)

    rows = _for_python(roles(pages, least_bytes, **columns)).mapInArrow(members, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", _MEMBER_END).text(path)
    _finish(pages.sparkSession, path)


class _Stream:
    """Bytes of whole files from batches of their lines, taken a few at a time.

    Every record, and so every file, ends with a line feed: a line feed after
    each line gives back exactly the bytes of the files, one after the other.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.held = batches, bytearray()

    def more(self) -> bool:
        for b in self.batches:
            if b.num_rows:
                lines = pa.LargeListArray.from_arrays(pa.array([0, b.num_rows], pa.int64()), b.column(0).cast(pa.large_binary()))
                self.held += pc.binary_join(lines, pa.scalar(b"\n", pa.large_binary()))[0].as_buffer()
                self.held += b"\n"
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next mark, which is passed; None at the end of the last file."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends within a record")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("an archive ends within a record")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            yield out


def _parsed(stream: _Stream, with_data: bool) -> Iterator[tuple]:
    """Rows of ``read``. Records are framed by their Content-Length alone."""
    record, running, size, chunk, whole = {}, None, 0, 0, 0
    while (head := stream.until(_END)) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        left = int(fields["Content-Length"])
        info = fields["WARC-Type"] == "warcinfo"
        if info:
            pass
        elif fields["WARC-Type"] != "continuation":
            left -= len(stream.until(_END)) + len(_END)
            record, running, size, chunk = fields, hashlib.sha1(), 0, 0
            whole = int(fields["X-Payload-Length"])
        elif fields["WARC-Segment-Origin-ID"] != record.get("WARC-Record-ID"):
            raise ValueError("a continuation without its record")
        data = bytearray()
        for part in stream.take(left):
            if not info:
                running.update(part)
                size += len(part)
            if with_data:
                data += part
        if b"".join(stream.take(len(_END))) != _END:
            raise ValueError("a record doesn't end where it should")
        if info:
            continue
        revisit = record["WARC-Type"] == "revisit"
        digest = record["WARC-Payload-Digest"][5:] if revisit else _base32(running.digest())
        last = revisit or size == whole
        if fields["X-Chunk-Digest"][5:] != digest or last and record["WARC-Payload-Digest"][5:] != digest:
            raise ValueError(f"a payload of page {record.get('X-Page-Id')} doesn't fit its digest")
        refers = record["WARC-Refers-To"].split(":")[-2] if revisit else None
        page = record.get("X-Page-Id")
        yield (page and int(page), int(record["X-Page-Copy"]), record["WARC-Type"], int(refers) if refers and refers != "none" else None, record.get("WARC-Target-URI"), chunk, last, whole if revisit else size, digest, bytes(data) if with_data else None)
        chunk += 1


def read(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """The chunk table of the archives, digests recomputed: page_id, copy, record_type, refers_to, url, chunk, last, payload_bytes and payload_digest so far, data.

    Revisits have one row with the size and digest of the payload that they
    refer to. A record whose payload doesn't fit its digests is an error.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(lambda batches: _batches(_parsed(_Stream(batches), with_data), _READ_KINDS), _READ_SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0, **columns) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, from archives written and read back.

    Null html is an empty payload. Null ids come last in the choice of a
    response. Rows that repeat id and payload: the first by url is the response,
    the others revisit it. Payloads may end in any line breaks. An empty table
    gives no row.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes=least_bytes, **columns)
    ends = read(pages.sparkSession, path).where("last")
    return ends.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
