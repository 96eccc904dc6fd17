"""Session helpers and vectorised hashing shared by the operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ROOT = str(Path(__file__).resolve().parents[2])
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SEGMENT = 1 << 20  # bytes that are hashed at a time
_powers: dict[str, np.ndarray] = {}
_written: list[str] = []  # folders of materialise() that are still there


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver got it from its own working folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a temporary
    folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark.sparkContext, "_own_shared_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext._own_shared_dir = path
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, zstd: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder (by zstd of a level, if one is given) and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if zstd is None else df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(zstd))
    writer.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote for frames that nothing reads any more."""
    for df in frames:
        if (path := getattr(df, "_written", None)) in _written:
            _written.remove(path)
            delete(df.sparkSession, path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end whatever materialise() wrote within, but for the frames handed to what it gives."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written)
        return df

    yield keep
    for path in [x for x in _written if x not in before and x not in kept]:
        _written.remove(path)
        delete(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives the memory that it has freed back to the system: it stays for later tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return inner


def column(name: str) -> Column:
    """The column of just this name, whatever signs it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: StructType | None = None) -> DataFrame:
    """mapInArrow over all columns, by place, whatever their names are; run gives them back, with more at the end."""
    schema = StructType([StructField(f"_{i}", f.dataType, f.nullable) for i, f in enumerate([*df.schema.fields, *(more.fields if more else ())])])
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(released(run), schema).toDF(*df.columns, *(more.names if more else ()))


#: Bytes of input, as Spark estimates them, that a shuffle partition is meant for at most.
PARTITION = 1 << 28


def partitions(df: DataFrame) -> int:
    """Partitions to deal out what comes from df: spark.sql.shuffle.partitions, or more if df is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # what isn't read from files has no estimate
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION) if known else 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def power(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, _SEGMENT + 1), _INVERSE if inverse else _BASE, dtype=_U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[key] = have
    return have[:n]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], for many spans at once, by one running polynomial sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(values.astype(_U) * power(n), out=total[1:])
    return mix((total[end] - total[start]) * power(n + 1, True)[start] ^ (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of UTF-8 bytes; white space is the blank and 0x09 to 0x0D."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def located_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and 64-bit hash of every word of the text, in order; long texts go in segments that end between words."""
    places, out, at, n = [], [], 0, len(text)
    while at < n:
        to = min(n, at + _SEGMENT)
        while to < n and not _SPACE[text[to]]:
            to += 1
        data = np.frombuffer(text, dtype=np.uint8, count=to - at, offset=at)
        start, end = word_spans(data)
        if len(start):
            places.append(start + at)
            out.append(spans_hash(data.astype(_U) + _U(1), start, end))
        at = to
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    return np.concatenate(places), np.concatenate(out)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order."""
    return located_words(text)[1]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words."""
    count = max(0, len(words) - n + 1)
    acc = np.zeros(count, dtype=_U)
    for j in range(n):
        acc = acc * _BASE + words[j : j + count]
    return mix(acc)
