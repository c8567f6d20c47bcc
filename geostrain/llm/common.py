"""Shared pieces of the corpus operators: shared-folder tables, hashing, buckets.

Nothing here keeps state on one machine.  Intermediate tables go to the folder
that the session names in ``spark.checkpoint.dir``, into one folder for each
application, which can go when the application has ended.  A session without
the setting gets a temporary folder if it runs on one machine, else an error.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of every contract of this package: blank and \x09 to \x0D.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: A broadcast side may have this many bytes at most; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20
#: What one id takes in the hash table of a broadcast, at most.
ID_BYTES = 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="geostrain-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the rounds
    before this table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema: StructType = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def join_by_size(left: DataFrame, right: DataFrame, on: str | list[str], how: str, right_bytes: int) -> DataFrame:
    """Broadcast ``right`` if its size allows it (measured, or ``ID_BYTES`` for each counted id), else join by shuffle."""
    if right_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing

_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Ranges of more bytes are hashed by the library, one by one.
LONG = 256


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for many ranges at once.

    Eight bytes at a time go through the finaliser, which is not linear, so no
    family of strings collides by construction.
    """
    size = end - start
    out = mix(size.astype(np.uint64), seed)
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    row = np.flatnonzero(size <= LONG)
    at, left = start[row], size[row]
    while len(row):
        lane = lanes[at]
        last = left < 8
        lane[last] &= (np.uint64(1) << (np.uint64(8) * left[last].astype(np.uint64))) - np.uint64(1)
        out[row] = mix(out[row] ^ lane, seed)
        on = left > 8
        row, at, left = row[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(2, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_hashes(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of every ``width`` values in a row, from those of 1, 2, 4, ... values."""
    n = max(0, len(values) - width + 1)
    power, out, done, size = values, None, 0, 1
    while n:
        if width & size:
            part = power[done : done + n]
            out = mix(part, seed) if out is None else mix(out * _ODD + part, seed + size)
            done += size
        if 2 * size > width:
            return out
        power = mix(power[:-size] * _ODD + power[size:], seed + 1000 + size)
        size *= 2
    return np.zeros(0, np.uint64)


class Words:
    """The words of some texts that lie one after another in one byte buffer.

    ``start`` and ``end`` are byte positions, ``first[d]:first[d + 1]`` are the
    words of text ``d``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        inside = ~_IS_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.lower = lower

    def hashes(self, seed: int = 0) -> np.ndarray:
        return range_hashes(_LOWERED[self.data] if self.lower else self.data, self.start, self.end, seed)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``limit`` bytes of text each, or one row.

    Whole texts always; only the number of rows handled at once is bounded.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, at = text_buffer(column)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def release() -> None:
    """Give free memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def trimmed(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``, which gives the memory it freed back to the system.

    Python workers are used again, by other operators too; what one task held
    must not stay with the worker.
    """

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        release()

    return run


# ---------------------------------------------------------------- buckets


#: Bytes of text whose entries meet in one bucket, and in one task, about.
BUCKET_TEXT, TASK_TEXT = 1 << 19, 1 << 24


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(n_bytes: int) -> int:
    """A power of two that keeps buckets of one size, whatever the corpus."""
    return max(256, 1 << (n_bytes // BUCKET_TEXT).bit_length())


def task_count(spark: SparkSession, n_bytes: int) -> int:
    return max(n_partitions(spark), n_bytes // TASK_TEXT)


#: Tasks that meetings of blocks are dealt over at most.
MOST_TASKS = 1000


def meeting_tasks(spark: SparkSession, meetings: int) -> int:
    """Tasks for so many meetings of blocks, which can grow with the square of a group.

    A task streams its meetings, so its memory doesn't follow their number.  But
    each task of a grouped Python function leaves 0.2 MB outside the heap of its
    executor for good (Spark 4.1.2), so the number of tasks must not follow it either.
    """
    return max(4 * n_partitions(spark), min(meetings // 4, MOST_TASKS))


def scatter(keys: np.ndarray, records: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Split a structured array into one blob per bucket of ``keys``."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, b in zip(np.split(records, cuts), bucket[np.r_[0, cuts]] if len(bucket) else (), strict=False):
        yield int(b), part.tobytes()


BLOB = "bucket int, blob binary"


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of one bucket after another from a partition sorted by bucket."""
    held: list[bytes] = []
    at = None
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != at and held:
                yield at, held
                held = []
            at = b
            held.append(blob)
    if held:
        yield at, held
