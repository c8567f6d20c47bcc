"""Operator 13: near duplicates by an LSH forest of MinHash signatures.

A document's signature holds ``TREES * DEPTH`` minima of its shingles under as
many hashes, four bytes each.  A tree of the forest is the order of all
signatures, each rotated so that another run of minima comes first: two sets of
similarity s agree on the first ``d`` values of a tree's order with probability
s^d.  Neighbours by longest common prefix are the candidates, and the depth
adapts to the region:

* texts with equal shingle sets are one class and act once;
* a region is what agrees on the first ``DEPTH`` values in one tree; regions of up
  to ``ngram_join.ALL_PAIRS`` sets give all their pairs, of larger ones each member
  meets a hub, and what links becomes one component;
* a region that is left with several components is open: it is divided by longer
  prefixes (``DEEPER``), and in each part members of other components meet the hub;
* what is still open meets in blocks, members outside the main component of a region
  with all of it and with each other (``ngram_join.rest``), so no link of a region is lost.

A pair is missed only if no tree has both in one region: with 32 trees of depth
6 this has probability (1 - s^6)^32, 2.6e-7 for a pair at 0.85 and less above.
Nothing else is left to chance: candidates are refuted by histograms of shingles
where these differ too much, and links are decided on the whole sets.

No group meets in one task: regions are counts and hubs, which combine on the map
side, joined back to their members.

Defined results: null texts and texts without words have no shingles and link
with nothing; texts of any length are read whole; equal texts share a component,
ties have one, the least id; a row with a null doc_id takes the component of a row
with equal shingles that has an id, else null, and is kept; rows with one doc_id
are one row repeated; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID_BYTES, join_by_size, mix, pieces, stored, trimmed
from .components import components
from .ngram_join import ALL_PAIRS, decide, histogram, labelled, linking, rest, shingle_sets, unrefuted

#: Two sets link from this similarity on, in percent.
PERCENT = 85
TREES, DEPTH = 32, 6
#: Lengths of the prefixes that divide open regions.
DEEPER = (12, 24, 48, TREES * DEPTH)
#: What a key and its hub take in the hash table of a broadcast, at most.
REGION_BYTES = 64

_WIDE = np.uint64(32)
_FACTORS = mix(np.arange(TREES * DEPTH, dtype=np.uint64), 131) | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each set, none of which is empty, as big-endian values."""
    values = np.concatenate(sets)
    start = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(_FACTORS)), ">u4")
    for i, factor in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat(values * factor, start) >> _WIDE
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, hash of the set (h1, h2), signature and histogram of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = list(shingle_sets(batch))
            filled = [s for s in sets if len(s)]
            rows = iter(minima(filled)) if filled else iter(())
            n, h1, h2, sig, hist = [], [], [], [], []
            for own in sets:
                n.append(len(own))
                h1.append(int(mix(own, 1).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(mix(own, 2).sum(dtype=np.uint64).view(np.int64)))
                sig.append(next(rows).tobytes() if len(own) else None)
                hist.append(histogram(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(hist, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig", "hist"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(made), "doc_id long, n_shingles long, h1 long, h2 long, sig binary, hist binary")


def _prefix(depth: int) -> Column:
    """A name of the first ``depth`` values of a signature in the order of ``tree``.

    Names that collide join two regions, which costs candidates and loses none.
    """
    own = F.substring(F.concat("sig", "sig"), F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * depth))
    return F.xxhash64("tree", F.lit(depth), own)


def _entries(info: DataFrame, *depths: int) -> DataFrame:
    """id and the region ``k<depth>`` of every set, in every tree."""
    trees = info.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return trees.select("id", *(_prefix(d).alias(f"k{d}") for d in depths))


def _regions(entries: DataFrame, depth: int) -> DataFrame:
    """Key, size and hub of each region of two sets or more.

    Hubs come first in one order for all regions, so those of one family share them.
    """
    counted = entries.groupBy(f"k{depth}").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", F.lit(6)), "id")).alias("first"))
    return counted.where("size > 1").select(f"k{depth}", "size", F.col("first.id").alias("hub"))


def _small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of the regions of ``members`` (key, id), which are small."""
    lists = members.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    firsts = lists.select("ids", F.posexplode("ids").alias("at", "a"))
    return firsts.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.lit(ALL_PAIRS))).alias("b"))


def _near(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Distinct ``pairs`` (a, b) that sizes and histograms don't refute."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: info.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"hist_{c}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(unrefuted(PERCENT), "a long, b long"), "near")


def _deeper_pairs(info: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of different components inside the parts of open regions.

    ``members`` (key, id, component) are those of large regions.
    """
    of = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    of = stored(of, "open")
    n_open = of.count()
    if not n_open:
        return members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    known = members.select("id", "component").distinct()
    inside = join_by_size(_entries(info, DEPTH, *DEEPER), of.withColumnRenamed("key", f"k{DEPTH}"), f"k{DEPTH}", "left_semi", REGION_BYTES * n_open)
    inside = stored(inside, "inside")
    out = None
    for depth in DEEPER:
        hubs = stored(_regions(inside, depth), "hubs")
        met = join_by_size(inside.select("id", f"k{depth}"), hubs, f"k{depth}", "inner", REGION_BYTES * hubs.count()).select("id", "hub").distinct()
        out = met if out is None else out.unionByName(met)
    out = out.where("id <> hub").distinct().join(known, "id").join(known.select(F.col("id").alias("hub"), F.col("component").alias("other")), "hub")
    return out.where("component <> other").select(F.col("id").alias("a"), F.col("hub").alias("b"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): every document with its class, and links of classes enough for the components."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stored(signed(docs), "signed")
    reps = stored(made.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "representatives")
    members = made.select("doc_id", "n_shingles", "h1", "h2").join(reps.withColumnRenamed("n_shingles", "n"), (F.col("n_shingles") == F.col("n")) & (made["h1"] == reps["h1"]) & (made["h2"] == reps["h2"]), "left").select("doc_id", "n_shingles", "rep")
    n_reps = reps.count()
    own = reps.select(F.col("rep").alias("doc_id"), "h1", "h2", "n_shingles")
    info = join_by_size(made, own, ["doc_id", "h1", "h2", "n_shingles"], "left_semi", 2 * ID_BYTES * n_reps)
    info = stored(info.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "hist").dropDuplicates(["id"]), "info")

    regions = stored(_regions(_entries(info, DEPTH), DEPTH), "regions")
    found = join_by_size(_entries(info, DEPTH), regions, f"k{DEPTH}", "inner", REGION_BYTES * regions.count())
    found = stored(found.select(F.col(f"k{DEPTH}").alias("key"), "id", "size", "hub"), "members-of-regions")
    large = found.where(F.col("size") > ALL_PAIRS)
    pairs = _small_pairs(found.where(F.col("size") <= ALL_PAIRS)).unionByName(large.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    decided = decide(docs, _near(pairs, info))
    linked = decided.where(linking(PERCENT)).select("a", "b")
    if large.isEmpty():
        return members, linked

    parts = stored(components(linked), "parts")
    where = large.select("key", "id").join(parts.withColumnRenamed("id", "pid"), F.col("id") == F.col("pid"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    deeper = _near(_deeper_pairs(info, stored(where, "large"), parts), info).join(decided.select("a", "b"), ["a", "b"], "left_anti")
    decided = stored(decided.unionByName(decide(docs, deeper)), "decided")
    linked = decided.where(linking(PERCENT)).select("a", "b")
    uids = info.select(F.col("id").alias("uid"), "id", "n", "hist")
    crowded = large.select(F.col("key").alias("group"), F.col("id").alias("uid"))
    return members, linked.unionByName(rest(docs, crowded, uids, decided, linked, PERCENT))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    members, found = links(docs)
    parts = stored(components(found), "found-parts")
    out = labelled(members, parts)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
