"""JSON exports in files and zip archives of any size, read as streams.

Only an archive's directory is read to list it; its entries are dealt to tasks, and a task holds one element of a root
array at a time, whatever the size of the entry.
"""

from __future__ import annotations

import codecs
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Characters of JSON that a row has, about, and bytes read at once.
ROW_CHARS, READ_BYTES = 4 << 20, 1 << 20
_BLANK = re.compile(r"[ \t\r\n]*")


class _Text:
    """Text that is read on as it is needed; what lies before `at` is let go."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.utf8 = read, codecs.getincrementaldecoder("utf-8-sig")("replace")
        self.text, self.at, self.over, self.longest = "", 0, False, 0

    def more(self) -> bool:
        """Reads as much as is held, so that an element of any length is parsed a few times only."""
        if self.over:
            return False
        data = self.read(max(READ_BYTES, len(self.text) - self.at))
        self.over = not data
        self.text, self.at = self.text[self.at :] + self.utf8.decode(data, self.over), 0
        self.longest = max(self.longest, len(self.text))
        return True

    def sign(self) -> str:
        """The next sign that isn't blank, '' at the end."""
        while True:
            self.at = _BLANK.match(self.text, self.at).end()
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]


def json_runs(source: _Text, most: int = ROW_CHARS) -> Iterator[tuple[int, str]]:
    """(place of the first element, JSON array) of runs of a root array's elements, or (0, the whole text) of another root. Text that breaks off, or goes on behind the root, is a ValueError."""
    if source.sign() != "[":
        while source.more():
            pass
        json.loads(source.text)
        yield 0, source.text
        return
    decoder = json.JSONDecoder()
    source.at += 1
    held, chars, first, n = [], 0, 0, 0
    while (sign := source.sign()) != "]" or n:
        if n:
            if sign not in (",", "]"):
                raise ValueError("a list that breaks off" if not sign else f"{sign!r} between elements")
            if sign == "]":
                break
            source.at += 1
            source.sign()
        while True:
            try:
                _, end = decoder.raw_decode(source.text, source.at)
                if end + 3 <= len(source.text) or source.over:  # a number may go on behind its first digits, as in 3e+5
                    break
            except ValueError:
                if source.over:
                    raise
            source.more()
        held.append(source.text[source.at : end])
        source.at, chars, n = end, chars + len(held[-1]), n + 1
        if chars >= most:
            yield first, f"[{','.join(held)}]"
            held, chars, first = [], 0, n
    source.at += 1
    if source.sign():
        raise ValueError("text behind the list")
    if held:
        yield first, f"[{','.join(held)}]"


def file_of(path: str, mode: str = "r"):
    """A file of any store that pyarrow.fs knows, to read at any place, or to write."""
    if path.startswith(("file:", "/")):
        store, place = fs.LocalFileSystem(), re.sub("^file:/+|^/+", "/", path)
    else:
        scheme, place = path.split("://", 1)
        store, place = fs.FileSystem.from_uri(f"{scheme}://{quote(place)}")
    if mode == "r":
        return store.open_input_file(place)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(place)


def _entries(batches):
    """(path, entry) of JSON files (no entry) and of the JSON entries of archives."""
    for b in batches:
        for path in b.column(0).to_pylist():
            names = [None]
            if path.lower().endswith(".zip"):
                with file_of(path) as f, zipfile.ZipFile(f) as z:
                    names = sorted(e.filename for e in z.infolist() if not e.is_dir() and e.filename.lower().endswith(".json"))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())], ["path", "entry"])


def _runs(path: str, entry: str | None) -> Iterator[tuple[int, str]]:
    with file_of(path) as f:
        if entry is None:
            yield from json_runs(_Text(f.read))
        else:
            with zipfile.ZipFile(f) as z, z.open(entry) as e:
                yield from json_runs(_Text(e.read))


def _contents(batches):
    for b in batches:
        for path, entry in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:  # an entry counts as a whole or not at all, so it is read through before
                for _ in _runs(path, entry):
                    pass
            except ValueError:
                if entry is None:
                    raise ValueError(f"{path} is no JSON, or breaks off") from None
                continue  # archives hold other files as well
            name = "/".join(filter(None, [path.rsplit("/", 1)[1], entry]))
            for first, content in _runs(path, entry):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([content])], ["name", "first", "content"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, first, content) of JSON files, and of the JSON entries of zip archives by name: a root array comes in rows of about 4 MB, `first` the place of a row's first element; any other root is one row.

    Entries that are no JSON, or break off, are passed over as a whole; such a file of its own is an error. Tasks open the files with pyarrow.fs.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,zip,JSON,ZIP}").load(path).select("path")
    entries = files.mapInArrow(_entries, "path string, entry string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "entry")
    return entries.mapInArrow(_contents, "name string, first bigint, content string")
