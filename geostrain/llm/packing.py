"""Operator 1: pack token pieces into windows of near-equal size.

Full windows are cut off every document first.  What is left of each document
(fewer tokens than a window) is cut into pieces and dealt to groups of about
``GROUP_TOKENS`` tokens; inside a group the Karmarkar-Karp multiway differencing
method spreads the pieces over ``ceil(tokens / capacity)`` windows.  If a window
exceeds the capacity, the number of windows rises and the group is spread anew.
A full window leaves no room for another piece, so differencing has nothing to
decide for it.

Defined results: a null or empty text is the end-of-text id alone; rows with
equal texts or equal ids are packed each on their own; a text of any length is
cut, never shortened; pieces of one length go in the order of their rows; a
null id stays null; an empty table gives an empty result; further columns of
the input are ignored whatever their names are.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, pieces, stored, trimmed

CAPACITY = 2048
#: Pieces of what is left of a document; small ones balance well.
PIECE = 512
GROUP_TOKENS = 1 << 19
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"


@functools.lru_cache(maxsize=1)
def tokenizer(vocabulary: str):
    """The tokenizer library's own encoder, as the file defines it."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(vocabulary))


@functools.lru_cache(maxsize=1)
def fast_encoder(vocabulary: str):
    """(encoder, special): merges by the ranks of the same file, and the file's special tokens."""
    import json

    import public_tokenizers as public
    import tiktoken

    path = public.path(vocabulary)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    with open(path, encoding="utf-8") as f:
        table = json.load(f)
    special = {x["content"] for x in table.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in table["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), tuple(sorted(special))


def token_ids(text: str | None, vocabulary: str = TOKENIZER) -> np.ndarray:
    """The tokenizer's ids and the end id.

    Texts with the name of a special token, and those on which the fast
    encoder's pattern engine gives up, go to the tokenizer library; it is
    loaded only then.
    """
    text = text or ""
    fast, special = fast_encoder(vocabulary)
    ids = None
    if not any(name in text for name in special):
        try:
            ids = fast.encode_ordinary(text)
        except BaseException as error:
            if type(error).__name__ != "PanicException":  # how the engine gives up; it can't be imported
                raise
    if ids is None:
        ids = tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    ids.append(END_ID)
    return np.array(ids, "<u4")


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp for ``k`` windows: the window of each piece.

    Each partial partition is a vector of ``k`` sums in descending order.  The
    two with the largest spread are merged, the largest sum of one onto the
    smallest of the other, until one partition is left.
    """
    if k == 1:
        return np.zeros(len(sizes), np.int64)
    sums: dict[int, np.ndarray] = {}
    slots: dict[int, list[list[int]]] = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums[i] = np.array([size], np.int64)
        slots[i] = [[i]]
        heap.append((-size, i))
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        p, q = slots.pop(a), slots.pop(b)
        over = len(x) + len(y) - k  # only these sums meet a sum that isn't zero
        if over <= 0:
            total, parts = np.concatenate([x, y]), p + q
        else:
            lone = len(x) - over
            total = np.concatenate([x[:lone], x[lone:] + y[len(y) - over :][::-1], y[: len(y) - over]])
            parts = p[:lone] + [u + v for u, v in zip(p[lone:], reversed(q[len(q) - over :]), strict=True)] + q[: len(q) - over]
        order = np.argsort(-total, kind="stable")
        sums[fresh] = total = total[order]
        slots[fresh] = [parts[j] for j in order.tolist()]
        heapq.heappush(heap, (int(total[-1] if len(total) == k else 0) - int(total[0]), fresh))
        fresh += 1
    out = np.empty(len(sizes), np.int64)
    for w, members in enumerate(slots[heap[0][1]]):
        out[members] = w
    return out


def spread(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows of the pieces, none above ``capacity``."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, k).max() <= capacity:
            return window
        k += max(1, k // 500)


def cut(n_tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length): full windows first, then pieces of the rest."""
    full = n_tokens - n_tokens % capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(piece, n_tokens - s)) for s in range(full, n_tokens, piece)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, vocabulary: str = TOKENIZER) -> DataFrame:
    """One row for each piece of each document, in one pass over the texts."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, vocabulary)
                rows += [(doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in cut(len(ids), capacity, piece)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(tokenised), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, group_tokens: int = GROUP_TOKENS, vocabulary: str = TOKENIZER) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module's text.

    The table of pieces is a few numbers a document.  It is stored, so that the
    groups can follow from the number of tokens and ids of full windows are
    those of stored rows.  Groups take pieces by a hash of document and start,
    so no source or document of any size fills one group.
    """
    table = stored(token_pieces(docs, capacity, piece, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = table.where(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.where(F.col("length") < capacity)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))

    def spread_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        size = group["length"].to_numpy()
        window = spread(size, capacity)
        order = np.argsort(window, kind="stable")
        group, size, window = group.iloc[order], size[order], window[order]
        ahead = np.cumsum(size) - size
        first = np.r_[True, np.diff(window) > 0]
        group["offset"] = ahead - np.maximum.accumulate(np.where(first, ahead, 0))
        group["sequence_id"] = (1 << 62) + (group["group"].to_numpy().astype(np.int64) << 24) + window
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    if groups > 1:
        dealt = dealt.repartition(max(n_partitions(docs.sparkSession), groups // 4), "group")
    packed = dealt.groupBy("group").applyInPandas(spread_group, full.schema)
    return full.unionByName(packed)
