"""Operator 3: exact duplicates by progressive refinement.

Texts are compared without their white space.  A first pass over the texts
finds the length of each and a hash of its beginning; rows are grouped by
length, then by that hash.  Only texts whose (length, hash) pair occurs again
are read a second time, whole, and grouped by their full SHA-256.  (``report``
also gives the hash of every text, which takes a pass of its own.)

Defined results: null counts as empty, and empty texts equal each other; ties
of the original length go to the smallest doc_id; rows with one doc_id are one
row repeated, count each, and are kept or dropped together; a row with a null id
is a group of its own; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID_BYTES, join_by_size, pieces, stored, text_buffer, trimmed

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
PREFIX_BYTES = 96


def _normal(data: np.ndarray, at: np.ndarray, row: int) -> bytes:
    return data[at[row] : at[row + 1]].tobytes().translate(None, _SPACE)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, at = text_buffer(batch.column(1))
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        length, prefix = [], []
        for row in range(batch.num_rows):
            normal = _normal(data, at, row)
            length.append(len(normal))
            prefix.append(xxhash.xxh64_intdigest(normal[:PREFIX_BYTES]) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points[at[1:]] - points[at[:-1]]), pa.array(length, pa.int64()), pa.array(prefix, pa.int64())], ["doc_id", "points", "length", "prefix"])


def full_hashes(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the whole normalised text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, at = text_buffer(batch.column(1))
            digest = [hashlib.sha256(_normal(data, at, row)).hexdigest() for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.string())], ["doc_id", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(hashed), "doc_id long, text_sha256 string")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size and kept of every row.

    Aggregates combine on the map side, so a group of any size arrives as one
    row a task.  What they find is stored before it is joined back: a join of
    two plain exchanges is one that adaptive execution splits where one group
    holds many rows.
    """
    ids = docs.select(F.col("doc_id").cast("long"), "text")
    begun = stored(ids.mapInArrow(trimmed(_beginnings), "doc_id long, points long, length long, prefix long"), "beginnings")
    lengths = stored(begun.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length"), "lengths")
    prefixes = begun.join(lengths, "length", "left_semi").groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("length", "prefix")
    prefixes = stored(prefixes, "prefixes")
    surviving = stored(begun.join(prefixes, ["length", "prefix"], "left_semi").select("doc_id", "points", "length", "prefix"), "surviving")
    size = surviving.count() * ID_BYTES
    again = join_by_size(ids, surviving.select("doc_id").distinct(), "doc_id", "left_semi", size)
    known = stored(full_hashes(again).withColumnRenamed("text_sha256", "full"), "hashes")
    rows = begun.select("doc_id", "points").join(known.dropDuplicates(["doc_id", "full"]), "doc_id") if size else None
    if rows is None:
        return begun.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    best = F.max_by("doc_id", F.struct("points", -F.coalesce("doc_id", F.lit((1 << 63) - 1))))
    groups = stored(rows.groupBy("full").agg(best.alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    members = rows.join(groups, "full").select(F.col("doc_id").alias("member"), "keep_id", "group_size").distinct()
    out = begun.select("doc_id").join(members, F.col("doc_id") == F.col("member"), "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(keep == F.col("doc_id"), F.lit(True)).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """The decision and the hash of every row; rows with a null id keep to themselves."""
    hashes = full_hashes(docs)
    known = exact_duplicates(docs.where("doc_id is not null")).distinct()
    alone = hashes.where("doc_id is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return hashes.where("doc_id is not null").join(known, "doc_id").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").unionByName(alone)
