"""What the training-data operators share: reading, cutting lineage, and hashing words in numpy."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TESTS_OWN_DIR: list[str] = []

#: Maps A-Z to a-z in bytes and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; a cluster has no folder that every machine sees, so it is told."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _TESTS_OWN_DIR:
        _TESTS_OWN_DIR.append(tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return _TESTS_OWN_DIR[0]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts lineage and survives a lost executor.

    release() deletes the files early; otherwise they go when the driver's JVM ends.
    """
    path = new_path(df.sparkSession, label)
    schema = df.schema
    with writing(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.quarry_path = path
    return out


#: While a table is written: a query's shuffle files go when it ends, as what it wrote is read instead of them, and Python workers get batches of whole texts that stay small.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize_kinds(df: DataFrame, label: str, kinds: list[int]) -> dict[int, DataFrame]:
    """As materialize, with a table for each value of the column kind, so that each can be released by itself."""
    path = new_path(df.sparkSession, label)
    schema = T.StructType([f for f in df.schema.fields if f.name != "kind"])
    with writing(df.sparkSession):
        df.write.partitionBy("kind").parquet(path)
    out = {}
    for kind in kinds:
        part = f"{path}/kind={kind}"
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(part)
        there = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where)
        out[kind] = df.sparkSession.read.schema(schema).parquet(part) if there else df.sparkSession.createDataFrame([], schema)
        out[kind].quarry_path = part if there else None
    return out


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that is deleted at the end."""
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def release(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "quarry_path", None)
        if path:
            spark = df.sparkSession
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
            df.quarry_path = None


def give_back() -> None:
    """Returns what a task no longer needs to the system: Python workers live on after a task, beside the executor's own memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit keys over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class WordHasher(dict):
    """word -> 64-bit hash, remembered for words seen before; forgets all when it holds `most` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
