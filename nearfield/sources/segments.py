"""Vector segments: Parquet by shard, with a manifest row for what a binary header would hold.

The binary form of a segment (a 64-byte header, then rows of float32) is read as well, one file a task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "shard_id int, node_id int, vec_id long, embedding array<float>"
# Fixed values of the binary form: magic, version, bytes of the header.
MAGIC, VERSION, HEADER = b"VECD", 1, 64


def create(vectors: DataFrame, path: str) -> None:
    """Write a new dataset; fails if there is one."""
    vectors.select("shard_id", "node_id", "vec_id", "embedding").write.mode("errorifexists").partitionBy("shard_id").parquet(path)


def append(vectors: DataFrame, path: str) -> None:
    vectors.select("shard_id", "node_id", "vec_id", "embedding").write.mode("append").partitionBy("shard_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def get(segment: DataFrame, node_id: int, shard_id: int | None = None) -> list[float]:
    """One vector; raises IndexError if it is not there. The filter reaches the scan."""
    at = segment.where(F.col("node_id") == node_id)
    row = (at if shard_id is None else at.where(F.col("shard_id") == shard_id)).select("embedding").first()
    if row is None:
        raise IndexError(f"no node {node_id}")
    return list(row[0])


def manifest(segment: DataFrame) -> DataFrame:
    """shard_id, count, dim of a dataset."""
    return segment.groupBy("shard_id").agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dim"))


def pack_binary(vectors: np.ndarray, created_ns: int = 0) -> bytes:
    """The binary form: magic, version, flags, count, dim, CRC-32 of these, time of creation, zeros; rows of float32."""
    x = np.asarray(vectors, "<f4")
    head = struct.pack("<4sIIII", MAGIC, VERSION, 0, len(x), x.shape[1] if x.ndim == 2 else 0)
    return (head + struct.pack("<IQ", zlib.crc32(head), created_ns)).ljust(HEADER, b"\0") + x.tobytes()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, node_id, embedding of binary segments. Raises for a wrong magic, version or checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                magic, version, _, n, dim = struct.unpack_from("<4sIIII", raw)
                if magic != MAGIC or version != VERSION or struct.unpack_from("<I", raw, 20)[0] != zlib.crc32(raw[:20]):
                    raise ValueError(f"{name} is no segment of version {VERSION}")
                x = np.frombuffer(raw, "<f4", n * dim, HEADER)
                for lo in range(0, n, 10_000):
                    hi = min(n, lo + 10_000)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * dim, dim, dtype=np.int32)), pa.array(x[lo * dim : hi * dim]))
                    yield pa.record_batch([pa.array([name] * (hi - lo)), pa.array(np.arange(lo, hi, dtype=np.int32)), cells], ["path", "node_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, node_id int, embedding array<float>")
