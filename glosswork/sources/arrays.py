"""Array files as tables: token streams (``.bin``) and matrices (``.npy``), by the Python data source API."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Elements or rows that one read task takes.
SPLIT_TOKENS, SPLIT_ROWS = 1 << 22, 1 << 16


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def _ranges(n: int, step: int) -> list[Range]:
    return [Range(a, min(a + step, n)) for a in range(0, n, step)] or [Range(0, 0)]


class _TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.dtype = np.dtype(options.get("dtype", "uint16"))
        self.step = int(options.get("split", SPLIT_TOKENS))

    def partitions(self):
        return _ranges(os.path.getsize(self.path) // self.dtype.itemsize, self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        data = np.memmap(self.path, self.dtype, "r") if os.path.getsize(self.path) else np.zeros(0, self.dtype)
        for a in range(partition.begin, partition.end, 65536):
            token = np.asarray(data[a : min(a + 65536, partition.end)])
            columns = [np.zeros(len(token), np.int64), np.arange(a, a + len(token)), token.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "pos", "token"])


class TokenStream(DataSource):
    """``(doc_id, pos, token)`` of a flat file of unsigned integers; one document, read in ranges."""

    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return "doc_id bigint, pos bigint, token int"

    def reader(self, schema):
        return _TokenReader(self.options)


class _MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.step = int(options.get("split", SPLIT_ROWS))

    def _open(self) -> np.ndarray:
        data = np.load(self.path, mmap_mode="r")
        if data.ndim != 2:
            raise ValueError(f"a matrix is needed, not {data.ndim} dimensions")
        return data

    def partitions(self):
        return _ranges(len(self._open()), self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        data = self._open()
        for a in range(partition.begin, partition.end, 4096):
            x = np.asarray(data[a : min(a + 4096, partition.end)], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(x))), lists], names=["row", "v"])


class Matrix(DataSource):
    """``(row, v)`` of a two-dimensional ``.npy`` file of any float type, half precision included."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row bigint, v array<float>"

    def reader(self, schema):
        return _MatrixReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format('token_stream')`` and ``'npy_matrix'`` known."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(TokenStream)
    spark.dataSource.register(Matrix)


def token_stream(spark: SparkSession, path: str, dtype: str = "uint16") -> DataFrame:
    register(spark)
    return spark.read.format("token_stream").option("dtype", dtype).load(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("npy_matrix").load(path)


def vector_file(spark: SparkSession, path: str) -> DataFrame:
    """``(token, z)`` of a one-dimensional ``.npy`` file, as marginals are stored; as long as a vocabulary."""
    z = np.load(path.removeprefix("file://")).astype(np.float64)
    if z.ndim != 1:
        raise ValueError("a vector is needed")
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(z)], "token int, z double")


def embedding_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(token, e)`` of the array ``embedding`` in an ``.npz`` file."""
    with np.load(path.removeprefix("file://")) as archive:
        e = archive["embedding"].astype(np.float32)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], "token int, e array<float>")


def save_embedding_archive(vectors: DataFrame, path: str, **facts) -> None:
    """Write ``(token, e)`` as ``embedding`` in an ``.npz`` file; as many rows as a vocabulary has tokens."""
    rows = vectors.orderBy("token").select(F.col("e").cast("array<float>").alias("e")).toArrow().column(0).combine_chunks()
    np.savez(path.removeprefix("file://"), embedding=rows.flatten().to_numpy().reshape(len(rows), -1), **facts)


def save_vector_file(marginals: DataFrame, path: str, column: str = "z") -> None:
    """Write ``(token, z)`` as a one-dimensional ``.npy`` file in token order."""
    np.save(path.removeprefix("file://"), marginals.orderBy("token").select(F.col(column).cast("double").alias("z")).toArrow().column(0).to_numpy())
