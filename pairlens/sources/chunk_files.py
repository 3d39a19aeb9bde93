"""Array files as a Spark data source that reads only what is asked for.

`array_files` lists a folder of genes with numbered 2-D .npy chunks. A partition is a run of chunks of one gene: its task reads the headers of the gene's chunks, which
give every chunk's place in the gene, and then of its own chunks only the wanted rows, by their offset in the file. Chunks without a wanted row are
never opened beyond the header. The folder must be mounted on the driver and all executors; through stores that only Spark reads, take `arrays.read_embedding_chunks`.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairlens.sources.arrays import CHUNK_PATTERN

MAX_WANTED = 1_000_000  # row numbers that travel with the query
BATCH_VALUES = 4_000_000  # values read before rows are handed on
_FIELDS = "gene string, chunk int, row_in_chunk bigint, row_idx bigint, embedding array<float>"
_REPORT = "gene string, chunk int, first_row bigint, n_rows bigint, rows_read bigint, bytes_read bigint"


@dataclass
class ChunkRun(InputPartition):
    """Chunks of a gene that one task reads; `files` are all chunks of the gene, in order."""

    gene: str
    files: list[tuple[int, str]]
    start: int
    stop: int


def read_header(path: str) -> tuple[tuple[int, int], np.dtype, int]:
    """Shape, type and offset of the data of a C-ordered 2-D .npy file, from its first bytes."""
    with open(path, "rb") as file:
        version = np.lib.format.read_magic(file)
        shape, fortran, dtype = np.lib.format.read_array_header_1_0(file) if version == (1, 0) else np.lib.format.read_array_header_2_0(file)
        if len(shape) != 2:
            raise ValueError(f"expected a 2-D chunk, got shape {shape} in {path}")
        if fortran and min(shape) > 1:
            raise ValueError(f"chunks must hold their rows together, {path} holds columns")
        if dtype.hasobject:
            raise ValueError(f"{path} holds Python objects")
        return shape, dtype, file.tell()


def read_rows(path: str, rows: np.ndarray) -> tuple[np.ndarray, int]:
    """The given rows (ascending) of a chunk, reading runs of neighbours at once, and the bytes read after the header."""
    (n, width), dtype, offset = read_header(path)
    out, at, read = np.empty((len(rows), width), dtype), 0, 0
    with open(path, "rb") as file:
        for run in np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1):
            if not len(run):
                continue
            file.seek(offset + int(run[0]) * width * dtype.itemsize)
            data = file.read(len(run) * width * dtype.itemsize)
            read += len(data)
            if len(data) < len(run) * width * dtype.itemsize:
                raise ValueError(f"{path} ends before row {int(run[-1])} of {n}")
            out[at : at + len(run)] = np.frombuffer(data, dtype).reshape(len(run), width)
            at += len(run)
    return out, read


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = re.sub(r"^file:(//)?", "", options["path"])
        self.pattern = options.get("pattern", CHUNK_PATTERN)
        self.genes = json.loads(options["genes"]) if "genes" in options else None
        self.wanted = np.array(sorted(set(json.loads(options["rows"]))), np.int64) if "rows" in options else None
        self.per_task = int(options.get("chunks", "8"))
        self.report = options.get("report", "false") == "true"

    def partitions(self) -> list[ChunkRun]:
        """Names alone; no file is opened here."""
        out = []
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name):
            if not entry.is_dir() or (self.genes is not None and entry.name not in self.genes):
                continue
            found = [(int(hit.group(1)), f.path) for f in os.scandir(entry.path) if (hit := re.search(self.pattern, f.path))]
            files = sorted(found)  # by number
            out += [ChunkRun(entry.name, files, a, min(a + self.per_task, len(files))) for a in range(0, len(files), self.per_task)]
        return out or [ChunkRun("", [], 0, 0)]

    def read(self, partition: ChunkRun) -> Iterator[pa.RecordBatch]:
        sizes = [read_header(path)[0][0] for _, path in partition.files[: partition.stop]]
        firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        for k in range(partition.start, partition.stop):
            chunk, path = partition.files[k]
            own = np.arange(sizes[k]) if self.wanted is None else self.wanted[np.searchsorted(self.wanted, firsts[k]) : np.searchsorted(self.wanted, firsts[k + 1])] - firsts[k]
            width = read_header(path)[0][1] if len(own) else 1
            total = 0
            for part in np.array_split(own, max(1, -(-len(own) * width // BATCH_VALUES))) if len(own) else []:
                rows, read = read_rows(path, part)
                total += read
                if not self.report:
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
                    columns = [pa.array([partition.gene] * len(part)), pa.array(np.full(len(part), chunk, np.int32)), pa.array(part), pa.array(part + firsts[k])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(rows.astype(np.float32).ravel()))], names=["gene", "chunk", "row_in_chunk", "row_idx", "embedding"])
            if self.report:
                values = [partition.gene, chunk, int(firsts[k]), sizes[k], len(own), total]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["gene", "chunk", "first_row", "n_rows", "rows_read", "bytes_read"])


class ArrayFiles(DataSource):
    """Options: path; pattern (of chunk files, its group 1 the number); genes and rows (JSON lists) to read only those; chunks per task; report."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return _REPORT if self.options.get("report", "false") == "true" else _FIELDS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_array_files(spark: SparkSession, path: str, rows: list[int] | None = None, genes: list[str] | None = None, pattern: str = CHUNK_PATTERN, chunks: int = 8, report: bool = False) -> DataFrame:
    """(gene, chunk, row_in_chunk, row_idx, embedding) of the wanted rows of the wanted genes; all without `rows` or `genes`.

    With `report`, what would be read instead: (gene, chunk, first_row, n_rows, rows_read, bytes_read), a row per chunk.
    """
    if rows is not None and len(rows) > MAX_WANTED:
        raise ValueError(f"{len(rows)} row numbers are too many to travel with the query; read all rows and join")
    spark.dataSource.register(ArrayFiles)
    reader = spark.read.format("array_files").option("path", path).option("pattern", pattern).option("chunks", str(chunks)).option("report", str(report).lower())
    if rows is not None:
        reader = reader.option("rows", json.dumps([int(r) for r in rows]))
    if genes is not None:
        reader = reader.option("genes", json.dumps(list(genes)))
    return reader.load()


def take_rows(spark: SparkSession, path: str, ids: DataFrame, wanted: DataFrame, subject: str = "subject_id", row: str = "row_idx", position: str = "pos", **options) -> DataFrame:
    """(subject, position, gene, embedding) of the wanted subjects from array files: the chunk-pruned form of `align.take_in_order`.

    ids: (subject, row_idx) of all rows of the files; wanted: (subject, position). A wanted subject without a row is an error. At most `MAX_WANTED`.
    """
    from pairlens.operators.align import take_in_order

    places = take_in_order(wanted, ids, subject, position).select(subject, position, row)
    table = places.limit(MAX_WANTED + 1).toArrow()
    rows = read_array_files(spark, path, table[row].to_pylist(), **options).select(F.col("row_idx").alias(row), "gene", "embedding")
    return places.join(rows, row).select(subject, position, "gene", "embedding")
