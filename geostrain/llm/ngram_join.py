"""Operator 5: exact Jaccard join of word shingles by PartEnum signatures.

Texts with equal shingle sets are one class and act once.  Sizes are divided
into bands; two sets with Jaccard similarity of at least 3/4 lie in one band or
in two neighbours, and differ in at most ``k = 2 * r / 7`` shingles, ``r`` the
largest size there.  For each such instance the domain of shingles is divided
by hash into ``n1`` partitions, and each of these into three parts.  The
signatures are enumerated: of every partition, every subset of two parts, as
the content of the set there.  With ``n1`` above ``k / 2``, some partition has
at most one difference, so at least one of its subsets agrees; ``partitions``
gives the least number ``s`` of signatures that two similar sets share.

Empty subsets give no signature, and of the others each set takes the first
``3 * n1 - s + 1`` in a common order: those of common shingles alone come last
(counters over all texts say which are common), then those with fewer shingles.
Of all that two sets share, the first in this order is among those of both, if
one of the sets has less than ``s`` empty subsets.  A set for which that fails
is dealt anew with another hash, and gives the signatures of all levels up to
the first at which it holds, so two sets always share a level at which it holds
for one of them.

Groups of up to ``ALL_PAIRS`` sets give all pairs.  Of larger groups each member
is compared with one hub; where that leaves several components, members outside
the group's main component are compared with the whole of it and with each
other, in blocks.  Pairs are refuted by histograms of their shingles where these
differ too much, else decided on the whole sets.

That gives the components.  On request links are counted too: they lie inside
components, so the members of large groups meet all others of their component, in
blocks again, and what they share is counted on the whole sets; only the numbers
of links leave a block.

Shingles are compared by 64-bit hashes of their words, classes by 128 bits.

Defined results: null texts and texts without words have no shingles and link
with nothing; texts of any length are read whole; a row with a null doc_id takes the component of a row with equal
shingles that has an id, else null; rows with one doc_id are one row repeated;
equal texts share a component; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB, ID_BYTES, Words, blob_batch, bucket_count, by_bucket, join_by_size, meeting_tasks, mix, pieces, scatter, stored, task_count, text_buffer, trimmed, window_hashes
from .components import components

WIDTH = 5
#: Two sets link from this similarity on, in percent.
PERCENT = 75
#: Second-level parts of a partition; a signature takes all but one of them.
PARTS = 3
ALL_PAIRS = 8
#: Rows of a side that meet in one task.
BLOCK = 1000
#: Shingles of a side that meet in one task, on average; a single set is always whole.
BLOCK_SHINGLES = 1 << 21
#: Shingles that are counted at once, and pairs that rare ones give at once.
COLUMNS, EXPANDED = 2048, 1 << 20
#: Least bins of a set's histogram; it grows with the set.
HISTOGRAM = 256
#: Counters of shingles; one is common if its counter is so many times the mean.
COUNTERS, COMMON = 1 << 18, 4.0
FLUSH_SIGNATURES, FLUSH_ROWS = 1 << 19, 50_000
MAX_LEVEL = 64


def shingle_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(*text_buffer(batch.column(1)), lower=True)
    h = words.hashes()
    n = len(h) - WIDTH + 1
    if n > 0:
        window = window_hashes(h, WIDTH, 5)
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WIDTH:
            own = np.sort(window[a : b - WIDTH + 1])
            yield own[np.r_[True, own[1:] != own[:-1]]]
        elif b > a:
            yield window_hashes(h[a:b], b - a, 6) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Bounds of the bands of sizes: the next begins above 4/3 of the first size."""

    def __init__(self):
        self.last = [1]

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            self.last.append((self.last[-1] + 1) * 4 // 3)
        return bisect.bisect_left(self.last, size)

    def end(self, band: int) -> int:
        while len(self.last) <= band:
            self.last.append((self.last[-1] + 1) * 4 // 3)
        return self.last[band]


def partitions(k: int) -> tuple[int, int]:
    """(n1, least): first-level partitions for ``k`` differing shingles, and how many signatures two such sets share.

    A partition without a difference shares all three of its signatures, one
    with differences in one part shares one, any other none.  The worst case
    spoils as many signatures as ``k`` differences can.
    """
    n1 = max(1, k // 2 + 1, (6 * k + 9) // 10)
    return n1, 3 * n1 - 2 * k if n1 >= k else 2 * n1 - k


def signatures(own: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    """All signatures of one set, for both instances it takes part in."""
    band = bands.of(len(own))
    usual = common[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]
    out = []
    for instance in (band, band + 1):
        k = 2 * bands.end(instance) // 7
        n1, least = partitions(k)
        for level in range(MAX_LEVEL):
            dealt, rare = own, ~usual
            if level:
                dealt = mix(own ^ np.uint64(level), 11 + level)
                order = np.argsort(dealt)
                dealt, rare = dealt[order], rare[order]
            part = (((dealt >> np.uint64(32)) * np.uint64(PARTS * n1)) >> np.uint64(32)).astype(np.int64)
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            content, size, unusual = np.zeros(PARTS * n1, np.uint64), np.zeros(PARTS * n1, np.int64), np.zeros(PARTS * n1, np.int64)
            content[part[start]] = np.add.reduceat(mix(dealt, 3), start)
            size[part[start]] = np.diff(np.r_[start, len(dealt)])
            unusual[part[start]] = np.add.reduceat(rare.astype(np.int64), start)
            # the subsets of a partition's parts: all but one of them
            content, size, unusual = ((x.reshape(n1, PARTS).sum(axis=1, dtype=x.dtype, keepdims=True) - x.reshape(n1, PARTS)).ravel() for x in (content, size, unusual))
            filled = np.flatnonzero(size)
            name = filled.astype(np.uint64) + np.uint64((instance * MAX_LEVEL + level) << 32)
            sig = mix(content[filled] ^ mix(name, 12), 4)
            most = PARTS * n1 - least + 1
            if len(sig) > most:
                sig = sig[np.lexsort((sig, -size[filled], unusual[filled] == 0))[:most]]
            out.append(sig)
            if PARTS * n1 - len(filled) < least:
                break
        else:  # never seen; all such sets of an instance meet here
            out.append(mix(np.array([instance], np.uint64), 99))
    return np.concatenate(out)


def shingle_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the hash of the set (h1, h2) of each text.

    Rows without a hash are counters of shingles instead, as (counter, count):
    those of a task that stand out in it.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in pieces(batches):
            n, h1, h2, seen = [], [], [], []
            for own in shingle_sets(batch):
                n.append(len(own))
                h1.append(int(mix(own, 1).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(mix(own, 2).sum(dtype=np.uint64).view(np.int64)))
                seen.append((own & np.uint64(COUNTERS - 1)).astype(np.int64))
            counters += np.bincount(np.concatenate(seen), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "n_shingles", "h1", "h2"])
        at = np.flatnonzero(counters > counters.mean() + 2 * np.sqrt(counters.mean()) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counters[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())], ["doc_id", "n_shingles", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(hashed), "doc_id long, n_shingles long, h1 long, h2 long")


def common_shingles(counters: DataFrame, total: int) -> np.ndarray:
    """Flags of the counters far above the mean: a table of fixed size."""
    flags = np.zeros(COUNTERS, bool)
    least = max(8.0, COMMON * total / COUNTERS)
    rows = counters.groupBy(F.col("doc_id").alias("at")).agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= least).select("at").toPandas()
    flags[rows["at"].to_numpy(np.int64)] = True
    return flags


_ENTRY = np.dtype("<u8")
_FOUND = "kind int, a long, b long, n long, hist binary"


def histogram(own: np.ndarray) -> bytes:
    """Counts of a set's shingles in bins, two to four shingles a bin on average."""
    bins = max(HISTOGRAM, 1 << max(0, len(own) // 4).bit_length())
    counts = np.bincount((own & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles in which two sets differ.

    Counts stop at 255 and bins are added up: both only make it smaller.
    """
    p, q = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    bins = min(len(p), len(q))
    return int(np.abs(p.reshape(-1, bins).sum(axis=0) - q.reshape(-1, bins).sum(axis=0)).sum())


def _emit(n_buckets: int, sent):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        bands, uid = Bands(), TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []
        infos: list[tuple] = []
        base = uid

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
            at = np.repeat(np.arange(len(held)), [len(x) for x in held]).astype(np.uint64)
            entries = ((keys // np.uint64(n_buckets)) << np.uint64(16)) | at
            head = np.int64(base).tobytes()
            rows = [(b, head + blob) for b, blob in scatter(keys, entries, n_buckets)]
            rows += [(n_buckets + (base // 997 + i) % n_buckets, pickle.dumps(infos[i : i + 32])) for i in range(0, len(infos), 32)]
            held.clear()
            infos.clear()
            return blob_batch(rows)

        count = 0
        for batch in pieces(batches):
            for doc_id, own in zip(batch.column(0).to_pylist(), shingle_sets(batch), strict=True):
                if not len(own):
                    continue
                held.append(signatures(own, bands, common))
                count += len(held[-1])
                infos.append((uid, doc_id, len(own), histogram(own)))
                uid += 1
                if count >= FLUSH_SIGNATURES or len(held) >= FLUSH_ROWS:
                    yield flush()
                    base, count = uid, 0
        if held:
            yield flush()

    return emit


def _pairs_of(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Candidate pairs (a, b), and (group, member) of larger groups.

    A group is named by its members, so that signatures with equal members, of
    any bucket, are one group with one hub.
    """
    entries = [np.frombuffer(x, _ENTRY, offset=8) for x in blobs]
    ids = np.concatenate([np.frombuffer(x, "<i8", 1)[0] + (e & np.uint64(0xFFFF)).astype(np.int64) for x, e in zip(blobs, entries, strict=True)])
    sig = np.concatenate(entries) >> np.uint64(16)
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[start, len(sig)])
    a, b = [], []
    for m in range(2, ALL_PAIRS + 1):
        at = start[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                a.append(ids[at + i])
                b.append(ids[at + j])
    groups, members = [], []
    for at, m in zip(start[size > ALL_PAIRS].tolist(), size[size > ALL_PAIRS].tolist(), strict=True):
        own = ids[at : at + m]
        group = mix(mix(own.astype(np.uint64), 8).sum(keepdims=True, dtype=np.uint64), 9)
        hub = own[mix(own.astype(np.uint64), 6).argmin()]  # one order for all groups, so that those of one family share hubs
        a.append(np.minimum(own, hub))
        b.append(np.maximum(own, hub))
        groups.append(np.full(m, group[0].view(np.int64)))
        members.append(own)
    pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
    pair = pair[pair[:, 0] != pair[:, 1]]
    return pair[:, 0], pair[:, 1], np.concatenate(groups) if groups else np.zeros(0, np.int64), np.concatenate(members) if members else np.zeros(0, np.int64)


def _match(n_buckets: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, a, b, n=None, hist=None) -> pa.RecordBatch:
            size = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(a), pa.array(b), pa.nulls(size, pa.int64()) if n is None else pa.array(n), pa.nulls(size, pa.binary()) if hist is None else pa.array(hist, pa.binary())], ["kind", "a", "b", "n", "hist"])

        for bucket, blobs in by_bucket(batches):
            if bucket >= n_buckets:
                info = [x for blob in blobs for x in pickle.loads(blob)]
                uid, doc_id, n, hist = zip(*info, strict=True)
                yield rows(1, np.array(uid, np.int64), np.array(doc_id, np.int64), np.array(n, np.int64), list(hist))
                continue
            a, b, group, members = _pairs_of(blobs)
            yield rows(0, a, b)
            yield rows(2, group, members)

    return match


def may_link(difference, total, percent: int):
    """Whether two sets of ``total`` shingles together that differ in so many can be as similar as that."""
    return (100 + percent) * difference <= (100 - percent) * total


def unrefuted(percent: int):
    """Pairs that their histograms don't refute: the sets differ at least as much."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf = pdf[may_link((pdf["n_a"] - pdf["n_b"]).abs(), pdf["n_a"] + pdf["n_b"], percent)]
                least = [least_difference(x, y) for x, y in zip(pdf["hist_a"], pdf["hist_b"], strict=True)]
                pdf = pdf[may_link(np.array(least, np.int64), pdf["n_a"] + pdf["n_b"], percent)]
            yield pdf[["a", "b"]]

    return run


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, union = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
            both = np.sort(np.concatenate([p, q]))
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            shared.append(same)
            union.append(len(both) - same)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "shared", "united"])


def _sets_of(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch)], pa.binary())], ["id", "shingles"])

    chosen = join_by_size(docs, ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi", ID_BYTES * count)
    return chosen.select("doc_id", "text").mapInArrow(trimmed(made), "id long, shingles binary").dropDuplicates(["id"])


def decide(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared and united of ``pairs`` (a, b), on the whole sets."""
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = stored(_sets_of(docs, ids, ids.count()), "sets")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return stored(joined.mapInArrow(trimmed(_decided), "a long, b long, shared long, united long"), "decided")


def linking(percent: int) -> str:
    return f"100 * shared >= {percent} * united"


def _folded(hist: np.ndarray, bins: int) -> np.ndarray:
    return hist.reshape(len(hist), -1, bins).sum(axis=1, dtype=np.int32)


def crossing(percent: int):
    """Pairs of a row on the left with one on the right that their histograms don't refute.

    Only the refutations are many; they stay in here.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        a, b = [], []
        tables = []
        for bins, part in right.groupby(right["hist"].map(len)):
            part = part.sort_values("n")
            raw = np.frombuffer(b"".join(part["hist"]), np.uint8).reshape(len(part), bins)
            tables.append((bins, raw, {}, part["id"].to_numpy(), part["n"].to_numpy(), part["component"].to_numpy()))
        for u, n, component, hist in zip(left["id"], left["n"], left["component"], left["hist"], strict=True):
            own = np.frombuffer(hist, np.uint8)[None]
            for bins, raw, folds, ids, sizes, components_ in tables:
                # sizes alone leave one range of the sorted rows
                lo, hi = np.searchsorted(sizes, [-(-percent * n // 100), 100 * n // percent + 1])
                if lo >= hi:
                    continue
                least = min(bins, own.shape[1])
                if least not in folds:
                    folds[least] = _folded(raw, least)
                gap = np.abs(folds[least][lo:hi] - _folded(own, least)).sum(axis=1)
                hit = (components_[lo:hi] != component) & may_link(gap, sizes[lo:hi] + n, percent)
                if hit.any():
                    a.append(np.full(int(hit.sum()), u))
                    b.append(ids[lo:hi][hit])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set on the left shares with each on the right.

    Frequent shingles are columns of 0 and 1 in products of matrices; of rare ones
    the pairs are counted.
    """
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.int64)
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)
    if not len(both):
        return out

    def entries(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, values)
        at[at == len(both)] = 0
        hit = both[at] == values
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order], np.bincount(at, minlength=len(both))

    (rx, cx, nx), (ry, cy, ny) = entries(x, left), entries(y, right)
    rare = 50 * nx * ny < n * m
    rows, cols = rx[rare[cx]], cx[rare[cx]]
    begin, many = np.r_[0, np.cumsum(ny)], ny[cols]
    upto = np.cumsum(many)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - many[a] + EXPANDED, "right")))
        k = many[a:b]
        own = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        other = ry[np.repeat(begin[cols[a:b]], k) + own]
        out += np.bincount(np.repeat(rows[a:b], k) * m + other, minlength=n * m).reshape(n, m)
        a = b
    place = np.cumsum(~rare) - 1
    rx, px = rx[~rare[cx]], place[cx[~rare[cx]]]
    ry, py = ry[~rare[cy]], place[cy[~rare[cy]]]
    for lo in range(0, int((~rare).sum()), COLUMNS):
        sides = []
        for size, r, p in ((n, rx, px), (m, ry, py)):
            a, b = np.searchsorted(p, [lo, lo + COLUMNS])
            side = np.zeros((size, COLUMNS), np.float32)
            side[r[a:b], p[a:b] - lo] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _degrees(group: pd.DataFrame) -> pd.DataFrame:
    """Links of each set of two blocks, or of one block, with the others there."""
    same = group["i"].iloc[0] == group["j"].iloc[0]
    left = group if same else group[group["piece"] == group["i"]]
    right = group if same else group[group["piece"] == group["j"]]
    if not len(left) or not len(right):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    x, y = ([np.frombuffer(v, "<u8") for v in side["shingles"]] for side in (left, right))
    shared = shared_counts(x, y)
    united = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None] - shared
    linked = 100 * shared >= 75 * united
    if same:
        return pd.DataFrame({"id": left["id"].to_numpy(), "n": linked.sum(axis=1) - 1})
    return pd.DataFrame({"id": np.r_[left["id"], right["id"]], "n": np.r_[linked.sum(axis=1), linked.sum(axis=0)]})


def _crowded(docs: DataFrame, crowd: DataFrame, parts: DataFrame) -> DataFrame:
    """id and n: links of the members of large groups (``crowd``: id, n) among each other.

    A pair that meets in large groups alone is never listed before, but its link
    lies in one component.  Each component's members are dealt into blocks and
    every two blocks meet once: rows are the members once for a block.
    """
    member = stored(crowd.join(parts, "id"), "crowd")
    size = member.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    size = size.select("component", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    size = stored(size, "crowd-blocks")
    member = stored(member.join(size, "component").select("id", "component", "nb"), "crowd-members")
    sets = stored(_sets_of(docs, member.select("id"), member.count()), "crowd-sets")
    rows = member.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(6)), F.col("nb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("id", "component", "piece", F.least("piece", "q").alias("i"), F.greatest("piece", "q").alias("j")).join(sets, "id")
    meetings = size.agg(F.sum(F.col("nb") * F.col("nb"))).first()[0] or 0
    rows = rows.repartition(meeting_tasks(docs.sparkSession, meetings), "component", "i", "j")
    found = stored(rows.groupBy("component", "i", "j").applyInPandas(_degrees, "id long, n long"), "crowd-links")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, crowd): every document with its class, links of classes, members of large groups.

    The links are all but some of those between two members of large groups, and
    enough for the components.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = stored(shingle_classes(docs), "classes")
    members = classes.where("h1 is not null")
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    sent = spark.sparkContext.broadcast(common_shingles(classes.where("h1 is null"), total))
    reps = members.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = stored(reps, "representatives")
    n_reps = reps.count()
    chosen = join_by_size(docs, reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi", ID_BYTES * n_reps)
    n_buckets = bucket_count(8 * total)
    dealt = chosen.mapInArrow(trimmed(_emit(n_buckets, sent)), BLOB).repartition(task_count(spark, 8 * total), "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(trimmed(_match(n_buckets)), _FOUND), "found")
    info = stored(found.where("kind = 1").select(F.col("a").alias("uid"), F.col("b").alias("id"), "n", "hist"), "info")
    name = lambda c: info.select(F.col("uid").alias(f"u_{c}"), F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"hist_{c}"))
    pairs = found.where("kind = 0").select(F.col("a").alias("u_a"), F.col("b").alias("u_b")).distinct().join(name("a"), "u_a").join(name("b"), "u_b")
    near = stored(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b", "hist_a", "hist_b").mapInPandas(unrefuted(PERCENT), "a long, b long"), "near")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    decided = decide(docs, near)
    linked = decided.where(linking(PERCENT)).select("a", "b")
    large = found.where("kind = 2").select(F.col("a").alias("group"), F.col("b").alias("uid")).distinct()
    crowd = stored(large.select("uid").distinct().join(info, "uid").select("id", "n"), "crowded")
    if not large.isEmpty():
        linked = linked.unionByName(rest(docs, large, info, decided, linked, PERCENT))
    return members.join(reps.withColumnRenamed("n_shingles", "n"), [members["h1"] == reps["h1"], members["h2"] == reps["h2"], F.col("n_shingles") == F.col("n")], "left").select("doc_id", "n_shingles", "rep"), linked, crowd


def rest(docs: DataFrame, large: DataFrame, info: DataFrame, decided: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Links that the hubs of large groups left open.

    In a group with several components, members outside its main component are
    attached to that one.  Each component's members, in blocks, meet the ones
    attached to it, and these meet each other: rows are the members once for
    ``BLOCK`` attached ones, not the pairs.
    """
    parts = stored(components(linked), "parts")
    ids = info.select("uid", "id")
    member = large.join(ids, "uid").join(parts.withColumnRenamed("id", "pid"), F.col("id") == F.col("pid"), "left").select("group", "id", F.coalesce("component", "id").alias("component"))
    member = stored(member, "large")
    counts = member.groupBy("group", "component").agg(F.count("*").alias("m"))
    main = counts.groupBy("group").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("n_components")).where("n_components > 1").select("group", "main")
    main = stored(main, "main")
    attached = member.join(main, "group").where("component <> main").select("main", "id", "component").distinct()
    attached = stored(attached, "attached")
    core = parts.select(F.col("component").alias("main"), "id").unionByName(attached.select("main", F.col("main").alias("id"))).distinct()
    n_att = stored(attached.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("na")), "n-attached")
    n_core = core.join(n_att, "main", "left_semi").groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nc"))
    blocks = stored(n_att.join(n_core, "main"), "blocks")
    piece = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    core = core.join(blocks, "main").withColumn("component", F.col("main"))
    att = attached.join(blocks, "main")
    right = core.select("main", "id", "component", piece("nc").alias("r"), every("na").alias("l"), F.lit(1).alias("side"))
    left = att.select("main", "id", "component", piece("na").alias("l"), every("nc").alias("r"), F.lit(0).alias("side"))
    # attached ones among each other: blocks i <= j, on negative block numbers
    own = att.withColumn("i", piece("na"))
    right2 = own.select("main", "id", "component", (-1 - F.col("i")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("l"), F.lit(1).alias("side"))
    left2 = own.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("na") - 1))).select("main", "id", "component", F.col("i").alias("l"), (-1 - F.col("j")).alias("r"), F.lit(0).alias("side"))
    rows = left.unionByName(right).unionByName(left2).unionByName(right2)
    meetings = blocks.agg(F.sum(F.col("na") * (F.col("nc") + F.col("na")))).first()[0] or 0
    rows = rows.join(info.select("id", "n", "hist"), "id").repartition(meeting_tasks(docs.sparkSession, meetings), "main", "l", "r")
    pairs = rows.groupBy("main", "l", "r").applyInPandas(crossing(percent), "a long, b long").distinct()
    pairs = stored(pairs.join(decided.select("a", "b"), ["a", "b"], "left_anti"), "crossing")
    return decide(docs, pairs).where(linking(percent)).select("a", "b")


def near_duplicates(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, unless left out, n_links (of its class) of every row.

    Counting links compares every two members of a component's large groups, so
    its cost grows with the square of a family; components don't need it.
    """
    members, found, crowd = links(docs)
    found = stored(found.distinct(), "found-links")
    parts = stored(components(found), "found-parts")
    if not count_links:
        return labelled(members, parts)
    ends = lambda df: df.select(F.col("a").alias("id")).unionByName(df.select(F.col("b").alias("id"))).withColumn("n", F.lit(1))
    if crowd.isEmpty():
        counted = ends(found)
    else:  # links inside the crowd are all counted there
        a, b = (crowd.select(F.col("id").alias(k), F.lit(True).alias(f"in_{k}")) for k in ("a", "b"))
        listed = found.join(a, "a", "left").join(b, "b", "left").where("in_a is null or in_b is null")
        counted = ends(listed).unionByName(_crowded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), crowd, parts))
    degree = counted.groupBy("id").agg(F.sum("n").alias("n_links"))
    parts = stored(parts.join(degree, "id", "left").withColumnRenamed("id", "pid"), "components")
    out = members.join(parts, F.col("rep") == F.col("pid"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id from each row's representative and the components of these."""
    out = members.join(parts.withColumnRenamed("id", "pid"), F.col("rep") == F.col("pid"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
