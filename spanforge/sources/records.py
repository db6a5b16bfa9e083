"""A Spark data source that streams records out of large JSON files.

A feed is one object whose arrays hold the records. A task reads its file piece by piece and
gives each record's text as soon as its last bracket is read, so it holds one record and one
piece, never the file; .gz files are unpacked on the way. Files are the partitions."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20
_MARK = re.compile(r'[{}\[\]"]')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def array_records(pieces: Iterable[str], keys: set[str]) -> Iterator[tuple[str, str]]:
    """(key, text) of every object in the arrays that the outermost object holds under ``keys``.

    Raises ValueError where the text ends inside a bracket or string, after all records before."""
    more = iter(pieces)
    text, at, depth, word, key, start = "", 0, 0, None, None, None

    def grow() -> bool:
        nonlocal text, at, start
        piece = next(more, None)
        if piece is None:
            return False
        keep = at if start is None else start
        text, at, start = text[keep:] + piece, at - keep, None if start is None else 0
        return True

    while True:
        m = _MARK.search(text, at)
        if m is None:
            at = len(text)
            if not grow():
                break
            continue
        at, c = m.start(), m[0]
        if c == '"':
            s = _STRING.match(text, at)
            if s is None:
                if not grow():
                    raise ValueError("the text ends inside a string")
                continue
            if depth == 1:
                word = s[0][1:-1]
            at = s.end()
            continue
        if c in "{[":
            depth += 1
            if depth == 2 and c == "[" and word in keys:
                key = word
            elif depth == 3 and c == "{" and key is not None:
                start = at
        else:
            depth -= 1
            if depth == 2 and start is not None:
                yield key, text[start : at + 1]
                start = None
            elif depth == 1:
                key = None
        at += 1
    if depth:
        raise ValueError("the text ends inside a bracket")


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, path: str, keys: set[str], piece: int):
        self.path, self.keys, self.piece = path, keys, piece

    def partitions(self):
        fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)) if x.is_file]
        root = self.path[: len(self.path.rstrip("/")) - len(path.rstrip("/"))]  # what stands before the store's own path
        return [_File(root + x.path) for x in sorted(found, key=lambda x: x.path) if not x.base_name.startswith((".", "_"))]

    def read(self, partition):
        if partition is None or not hasattr(partition, "uri"):
            return
        fs, path = pyarrow.fs.FileSystem.from_uri(partition.uri)

        def pieces():
            decoder = codecs.getincrementaldecoder("utf-8-sig")()
            with fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as f:
                while raw := f.read(self.piece):
                    yield decoder.decode(raw)
                decoder.decode(b"", True)

        try:
            for key, record in array_records(pieces(), self.keys):
                yield partition.uri, key, record, None
        except (ValueError, OSError) as e:  # a damaged file is told of in a row of its own
            yield partition.uri, None, None, str(e)


class JsonRecords(DataSource):
    """Options: path (a file or folder), keys (names of arrays, by commas), piece (bytes at a time)."""

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        return "file string, key string, record string, error string"

    def reader(self, schema):
        return _Reader(self.options["path"], set(self.options["keys"].split(",")), int(self.options.get("piece", PIECE)))


def read_records(spark: SparkSession, path: str, keys: list[str], piece: int = PIECE) -> DataFrame:
    """(file, key, record, error): a row a record; a file that breaks off has a last row with the
    error and no record."""
    spark.dataSource.register(JsonRecords)
    return spark.read.format("json_records").option("keys", ",".join(keys)).option("piece", piece).load(path)
