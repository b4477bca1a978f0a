"""A zip archive written by several tasks: each writes a segment of entries and its part of the directory, one task joins them."""

from __future__ import annotations

import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archives import file_of

# Fixed values of the zip format: signatures, the version that has 64-bit places, names in UTF-8, deflate, 1980-01-01, and the mark of a 64-bit value.
LOCAL, ENTRY, END64, LOCATOR, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x06\x06", b"PK\x06\x07", b"PK\x05\x06"
VERSION, UTF8, DEFLATE, DATE, LATER = 45, 0x800, 8, 0x21, 0xFFFFFFFF
COPY_BYTES = 4 << 20


def _header(name: bytes, crc: int, packed: int, size: int) -> tuple[bytes, bytes]:
    return struct.pack("<HHHHHIIIHH", VERSION, UTF8, DEFLATE, 0, DATE, crc, LATER, LATER, len(name), 20), struct.pack("<HHQQ", 1, 16, size, packed)


def _segments(folder: str):
    def run(batches):
        name = uuid.uuid4().hex  # an attempt's own, so that one that is lost leaves nothing that is read
        at, n, first = 0, 0, None
        with file_of(f"{folder}/{name}.part", "w") as part, file_of(f"{folder}/{name}.dir", "w") as directory:
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    data = (content or "").encode()
                    own, pack = path.encode(), zlib.compressobj(6, zlib.DEFLATED, -15)
                    packed = pack.compress(data) + pack.flush()
                    fixed, sizes = _header(own, zlib.crc32(data), len(packed), len(data))
                    entry = LOCAL + fixed + own + sizes + packed
                    part.write(entry)
                    directory.write(struct.pack("<QIQQI", at, zlib.crc32(data), len(packed), len(data), len(own)) + own)
                    first = path if first is None else first
                    at, n = at + len(entry), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([at], pa.int64()), pa.array([n], pa.int64())], ["segment", "first", "bytes", "n"])

    return run


def _entries(stream, base: int):
    """A segment's part of the directory, with places in the archive."""
    while head := stream.read(32):
        at, crc, packed, size, n = struct.unpack("<QIQQI", head)
        own = stream.read(n)
        extra = struct.pack("<HHQQQ", 1, 24, size, packed, base + at)
        yield ENTRY + struct.pack("<HHHHHHIIIHHHHHII", VERSION, VERSION, UTF8, DEFLATE, 0, DATE, crc, LATER, LATER, n, len(extra), 0, 0, 0, 0, LATER) + own + extra


def _joined(folder: str, path: str, segments: list[tuple[str, int]]):
    def run(batches):
        for _ in batches:
            pass
        at, size, n = 0, 0, 0
        with file_of(path, "w") as out:
            for name, _ in segments:
                with file_of(f"{folder}/{name}.part") as part:
                    while data := part.read(COPY_BYTES):
                        out.write(data)
            base = sum(b for _, b in segments)
            for name, bytes_ in segments:
                with file_of(f"{folder}/{name}.dir") as directory:
                    for entry in _entries(directory, at):
                        out.write(entry)
                        size, n = size + len(entry), n + 1
                at += bytes_
            out.write(END64 + struct.pack("<QHHIIQQQQ", 44, VERSION, VERSION, 0, 0, n, n, size, base) + LOCATOR + struct.pack("<IQI", 0, base + size, 1))
            out.write(END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, LATER, LATER, 0))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([base + size + 98], pa.int64())], ["archive", "n", "bytes"])

    return run


def write_zip(files: DataFrame, path: str) -> DataFrame:
    """Writes rows (path, content) as one zip archive, by path, and returns one row: archive, n (entries) and bytes.

    Tasks pack entries, each in memory by itself; what the driver sees is a row a task. One task then copies the segments behind each other, as an archive is one
    file, a few MB at a time. Paths go below the archive's root (leading / and .. are taken away); of equal paths each is an entry; null contents are
    empty; no rows make an empty archive. The folder of segments beside the archive is deleted.
    """
    spark, folder = files.sparkSession, f"{path}.{uuid.uuid4().hex[:8]}"
    safe = F.array_join(F.filter(F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", "..")), "/")
    rows = files.where("path is not null").select(safe.alias("path"), F.col("content").cast("string").alias("content")).repartitionByRange("path", "content").sortWithinPartitions("path", "content")
    made = rows.mapInArrow(_segments(folder), "segment string, first string, bytes bigint, n bigint").collect()  # a row a task
    segments = [(r.segment, r.bytes) for r in sorted(made, key=lambda r: r["first"].encode())]
    out = spark.range(0, 1, 1, 1).mapInArrow(_joined(folder, path, segments), "archive string, n bigint, bytes bigint").collect()
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return spark.createDataFrame(out, "archive string, n bigint, bytes bigint")
