"""Parquet footers, dictionary pages and page headers, read without decoding data pages, and single row groups."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: page types, encodings whose values are dictionary indices, codecs pyarrow can read.
DICTIONARY_PAGE = 2
INDEX_ENCODINGS = {2, 8}
CODECS = {"SNAPPY": "snappy", "ZSTD": "zstd", "GZIP": "gzip", "BROTLI": "brotli", "LZ4_RAW": "lz4_raw", "UNCOMPRESSED": None}
HEADER_BYTES = 4096

CHUNK = (
    "file string, row_group int, column_name string, n_rows bigint, n_nulls bigint, min_value string, max_value string, "
    "complete boolean, candidates array<string>, group_min string, group_max string"
)


class Compact:
    """Reader of Thrift's compact protocol, as far as page headers go."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.signed()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise IndexError
            return None
        if kind in (9, 10):
            head = self.byte()
            n = head >> 4
            n = self.varint() if n == 15 else n
            return [self.byte() == 1 if head & 15 in (1, 2) else self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.fields()
        raise ValueError(f"thrift type {kind}")

    def fields(self) -> dict:
        out, field = {}, 0
        while kind := self.byte():
            field = field + (kind >> 4) if kind >> 4 else self.signed()
            out[field] = self.value(kind & 15)
        return out


def page_header(source, offset: int, end: int) -> tuple[dict, int]:
    """The header of the page at offset, and the place of its body."""
    n = HEADER_BYTES
    while True:
        source.seek(offset)
        data = source.read(min(n, end - offset))
        r = Compact(data)
        try:
            return r.fields(), offset + r.at
        except IndexError:
            if n >= end - offset:
                raise
            n *= 8


def dictionary_of(source, chunk) -> tuple[list[str] | None, bool]:
    """The entries of a text chunk's dictionary page, and whether every data page refers to it.

    (None, False) where there is no dictionary or it can't be read here.
    """
    if not chunk.has_dictionary_page or chunk.physical_type != "BYTE_ARRAY" or chunk.compression not in CODECS:
        return None, False
    at = chunk.dictionary_page_offset
    end = at + chunk.total_compressed_size
    values, complete = None, True
    while at < end:
        h, body = page_header(source, at, end)
        at = body + h[3]
        if h[1] == DICTIONARY_PAGE:
            source.seek(body)
            raw = source.read(h[3])
            codec = CODECS[chunk.compression]
            raw = pa.decompress(raw, decompressed_size=h[2], codec=codec).to_pybytes() if codec else raw
            values, p = [], 0
            for _ in range(h[7][1]):
                (n,) = struct.unpack_from("<i", raw, p)
                values.append(raw[p + 4 : p + 4 + n].decode("utf-8", "replace"))
                p += 4 + n
        else:
            data = h.get(5) or h.get(8) or {}
            complete = complete and data.get(2 if 5 in h else 4) in INDEX_ENCODINGS
    return values, complete and values is not None


def opened(path: str):
    """A file of any store that pyarrow can open."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(name)


def read_group(path: str, group: int, columns: list[str]) -> pa.Table:
    """Columns of one row group; those that the file lacks are null texts."""
    with opened(path) as source:
        f = pq.ParquetFile(source)
        have = [c for c in columns if c in f.schema_arrow.names]
        t = f.read_row_group(group, columns=have)
        n = f.metadata.row_group(group).num_rows
    for c in columns:
        if c not in have:
            t = t.append_column(c, pa.nulls(n, pa.string()))
    return t.select(columns)


def each_group(chunks: DataFrame, work: Callable[[str, int, list[str]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows of `schema` that work(file, row group, columns) gives for every row group of chunks, each read by one task."""
    groups = chunks.groupBy("file", "row_group").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))  # as many as rules

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from work(r["file"], r["row_group"], r["columns"])

    return groups.repartition(4 * chunks.sparkSession.sparkContext.defaultParallelism, "file", "row_group").mapInArrow(read, schema)


def read_footer(path: str, columns: list[str], group: str | None) -> list[tuple]:
    """One row for each row group and column of a file; see CHUNK. Values as text."""
    rows = []
    with opened(path) as source:
        meta = pq.read_metadata(source)
        for g in range(meta.num_row_groups):
            rg = meta.row_group(g)
            at = {rg.column(i).path_in_schema: rg.column(i) for i in range(rg.num_columns)}
            s = at[group].statistics if group in at else None
            bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max and s.null_count == 0 else (None, None)
            for c in columns:
                if c not in at:
                    rows.append((path, g, c, rg.num_rows, rg.num_rows, None, None, True, [], *bounds))
                    continue
                s = at[c].statistics
                values, complete = dictionary_of(source, at[c])
                nulls = s.null_count if s is not None and s.has_null_count else None
                low, high = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                if complete and nulls != rg.num_rows and (low not in values or high not in values):
                    low = high = None  # cut off, or of another order: not exact
                rows.append((path, g, c, rg.num_rows, nulls, low, high, complete or nulls == rg.num_rows, values if complete else [], *bounds))
    return rows


def chunk_statistics(spark: SparkSession, files: list[str], columns: list[str], group: str | None = None) -> DataFrame:
    """CHUNK rows of all files, each footer read once by a task. files: a list of paths, one partition for every few."""
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b["file"]:
                try:
                    rows = read_footer(f, columns, group)
                except (OSError, ValueError, NotImplementedError, pa.ArrowException):  # a store that pyarrow can't open: nothing is known
                    rows = [(f, 0, c, None, None, None, None, False, [], None, None) for c in columns]
                yield pd.DataFrame(rows, columns=names)

    n = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(f,) for f in files] or [], "file string").repartition(n, F.col("file")).mapInPandas(read, CHUNK)
