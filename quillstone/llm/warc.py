"""Operator 5, WARC: a monolithic gzip normaliser.

Archives as crawlers write them are one gzip stream each, in which no record can be reached without all
before it. The normaliser inflates each stream once, a piece at a time, writes every record as a gzip
member of its own, and beside the archive a sidecar index (one JSON line a record) of offsets; readers
then fetch and inflate single members. Archives are files in a folder that all executors share; a task
writes under another name and renames, so a repeated attempt replaces what an earlier one left.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Work, join_checked

#: Bytes of records after which a writer begins another archive; a longer record has one of its own.
ARCHIVE_BYTES = 16 << 20
PIECE = 1 << 20
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    n = rid.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit record, which has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def headers(block: bytes) -> dict[str, str]:
    """The named fields of a header block, names in lower case."""
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def inflate(file) -> Iterator[bytes]:
    """The contents of a gzip file (of one or many members) that is open for reading, in pieces; a file that ends within a member is an error."""
    engine, part = zlib.decompressobj(31), file.read(PIECE)
    some = bool(part)
    while part:
        yield engine.decompress(part, PIECE)
        if engine.eof:
            part = engine.unused_data or file.read(PIECE)
            if part:
                engine = zlib.decompressobj(31)
        else:
            part = engine.unconsumed_tail or file.read(PIECE)
    if some and not engine.eof:
        yield engine.flush()
        raise ValueError("a gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, the whole record) of each record of an inflated archive."""
    held = bytearray()
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        seen = 0
        while (cut := held.find(_END, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("an archive ends within a header")
        fields = headers(bytes(held[:cut]))
        n = cut + 4 + int(fields["content-length"]) + 4
        if not held.startswith(b"WARC/") or not fill(n):
            raise ValueError("an archive has a broken record")
        yield fields, bytes(held[:n])
        del held[:n]


@contextmanager
def _file(folder: str, name: str):
    """A file to write, under its name when all is written; a failed attempt leaves none."""
    fs, path = pafs.FileSystem.from_uri(folder)
    own = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(own, compression=None) as out:
        yield out
    fs.move(own, f"{path}/{name}")


def _writer(folder: str, most: int):
    """Writes the rows (html, page_id, url, keeper) as archives of about `most` bytes of records, a page at a time."""

    def write(batches):
        part, k, done = TaskContext.get().partitionId(), 0, []
        pages = (r for b in W.chunks(batches, "html", PIECE) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(pages, None)
        while row:
            name, size, n, engine = f"part-{part:05d}-{k:05d}.warc.gz", 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            with _file(folder, name) as out:
                while row:
                    html, page, url, keeper = row
                    r = record(page, url, (html or "").encode(), keeper)
                    if n and size + len(r) > most:
                        break
                    out.write(engine.compress(r))
                    size, n, row = size + len(r), n + 1, next(pages, None)
                out.write(engine.flush())
            done.append((name, n))
            k += 1
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "n_records"])

    return write


def _normaliser(raw: str, folder: str):
    """Rewrites the named archives, holding one record of one at a time."""

    def run(batches):
        source, root = pafs.FileSystem.from_uri(raw)
        for b in batches:
            for name in b.column(0).to_pylist():
                at, n = 0, 0
                with _file(folder, name) as out, _file(folder, f"{name}.idx") as index, source.open_input_stream(f"{root}/{name}", compression=None) as file:
                    try:
                        for fields, whole in records(inflate(file)):
                            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = engine.compress(whole) + engine.flush()
                            index.write((json.dumps({"archive": name, "offset": at, "length": len(member), "record_id": fields["warc-record-id"], "record_type": fields["warc-type"]}) + "\n").encode())
                            out.write(member)
                            at, n = at + len(member), n + 1
                    except (ValueError, zlib.error, KeyError) as e:
                        raise ValueError(f"{raw}/{name}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], ["archive", "n_records", "bytes"])
        W.give_back()

    return run


def _reader(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html", "archive", "offset")
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, held = [], 0
        for b in batches:
            for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                whole = zlib.decompress(file.read(length), 31)
                cut = whole.index(_END) + 4
                fields = headers(whole[: cut - 4])
                block = whole[cut : cut + int(fields["content-length"])]
                end = block.index(_END) + 4
                size, payload = int(headers(block[: end - 4])["content-length"]), block[end:]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{archive} at {offset}: the payload isn't what its record says")
                to = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, to, payload.decode() if kind == "response" else None, archive, offset))
                held += len(block)
                if held >= PIECE:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)
        if file:
            file.close()

    return run


def _folder(work: Work, name: str) -> str:
    path = f"{work.root}/{name}"
    p = work.spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(work.spark._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def revisits(work: Work, pages: DataFrame) -> DataFrame:
    """(page_id, digest, keeper) of pages whose payload a page with a larger id has too. Only ids and digests are shuffled; a payload that a third of the pages have meets in its aggregate as one row a task."""
    ids = work.write(pages.select("page_id", _digest("html").alias("digest")), "digests")
    keepers = work.write(ids.where("page_id is not null").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("least < keeper").drop("least"), "keepers")
    found = join_checked(ids, keepers, "digest", "inner", 40 * keepers.count()).where("page_id < keeper")
    return work.write(found.select("page_id", "digest", "keeper").distinct(), "revisits")


def _digest(c: str):
    return F.unhex(F.sha1(F.coalesce(F.col(c), F.lit("")).cast("binary")))


def write_archives(work: Work, pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes pages (page_id, url, html) as monolithic archives; returns their folder. Columns of other names are not read."""
    own = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    again = revisits(work, own)
    rows = own.withColumn("digest", _digest("html"))
    rows = join_checked(rows, again, ["page_id", "digest"], "left", 48 * again.count()).select("html", "page_id", "url", "keeper")
    folder = _folder(work, "raw")
    work.write(rows.mapInArrow(_writer(folder, archive_bytes), "archive string, n_records long"), "written")
    return folder


def normalise(work: Work, raw: str) -> str:
    """Rewrites each archive of a folder, of one gzip stream or several, with a member for each record and an index beside it; returns the new folder.

    An archive may be of any size: tasks read it as a stream and write as they read. A broken or cut archive is an error that names it; an empty folder gives an empty one."""
    folder = _folder(work, "archives")
    # names alone: files are opened in the tasks
    names = work.spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(raw).select(F.element_at(F.split("path", "/"), -1).alias("archive"))
    work.write(names.mapInArrow(_normaliser(raw, folder), "archive string, n_records long, bytes long"), "normalised")
    return folder


def read_archives(spark, folder: str) -> DataFrame:
    """Reads every record of normalised archives through their indexes, with its payload checked against its digest: page_id, url, payload_bytes and payload_digest of the full payload, record_type, refers_to, html (null for revisits), archive and offset."""
    index = spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder).select("archive", "offset", "length")
    return index.mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, archive string, offset long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back. A null html is an empty payload and a null url an empty one. Of pages with equal
    payloads, all that have the largest id are responses; a page without an id is always one. Repeated rows
    are records each; an empty table makes no archive and an empty result."""
    work = Work(pages.sparkSession, "warc")
    raw = write_archives(work, pages)
    folder = normalise(work, raw)
    work.delete(raw)
    return read_archives(pages.sparkSession, folder)


def op5_monolithic_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 in SQL: five bits at a time out of two neighbouring hexadecimal digits.
OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as keeper from pages
)
select page_id, strlen(html) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (((16 * (strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1)
    + strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)) & 31) as bigint), 1)), 'string_agg', '') as payload_digest,
  case when page_id < keeper then 'revisit' else 'response' end as record_type,
  case when page_id < keeper then keeper end as refers_to
from p
"""
