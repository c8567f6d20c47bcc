"""Operator 12: a trie of conversation prefixes, summed up by heavy paths.

A node is a sequence of first turns (role, text) that conversations share.  Its
name is the running xor of 128-bit hashes of (depth, turn), so the names of all
prefixes of a conversation come from one running aggregate, whatever their
length.

Sums over subtrees follow a heavy-path decomposition.  Each node's heavy child is
the largest one, by members, then by the least conversation; a light child has at
most half of its parent's members, so a path from the root has few light edges, at
most the logarithm of the number of conversations.  Every heavy path ends in one
leaf, and the leaf's smallest conversation runs along the whole path: the path is
the part of this conversation below its last light edge, which one join with the
flags of the nodes shows.  Rounds go from the paths with the most light edges
above them to the root's: a suffix sum along each path, then the sum at its head
goes to the parent on another path.

Long conversations and paths are cut at fixed depths (``CHUNK``): aggregates run
inside the pieces, and pieces are put together by their totals, so no task holds
a whole conversation.  Conversations that end in one node are hashed in order
from strings of up to ``ENDS`` ids each, as a stream.

Defined results: rows are ordered by turn, null first, turns alike by a hash of
role and text, so equal rows stay two turns; a null role or text is empty; rows
without a conv_id belong to no conversation; an empty table has no conversation,
hence no node; texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, stored

#: Turns of a conversation, or nodes of a path, that one window holds.
CHUNK = 4096
#: Range of conversation ids whose ends become one string.
ENDS = 256
#: Conversations are rebuilt on the beginning of each ``GROUP``-th one.
GROUP = 20


def _chunk(order: str) -> Column:
    return F.floor(F.col(order) / CHUNK)


def running(df: DataFrame, key: str, order: list[Column], chunk: Column, names: dict[str, str], xor: bool = False, backwards: bool = False) -> DataFrame:
    """``df`` with running sums (or xors) of each ``key``, the row itself included, as new name: column.

    Windows run inside chunks; what lies before a chunk is added from a table of
    chunk totals.
    """
    fold = F.bit_xor if xor else F.sum
    inner = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy(F.col("_c").desc() if backwards else F.col("_c")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_chunk", chunk)
    local = df.withColumns({new: fold(old).over(inner) for new, old in names.items()})
    totals = df.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_c")).agg(*(fold(old).alias(f"_{new}") for new, old in names.items()))
    ahead = totals.select("_key", "_c", *(F.coalesce(fold(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in names))
    out = local.join(ahead, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_c")))
    out = out.withColumns({new: F.col(new).bitwiseXOR(F.col(f"_{new}")) if xor else F.col(new) + F.col(f"_{new}") for new in names})
    return out.drop("_key", "_c", "_chunk", *(f"_{new}" for new in names))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), hashes of the turn and its words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"), F.regexp_count(text, F.lit(WORD_CLASS)).cast("long").alias("words")
    )
    # turns without a number come first, in the chunk before all others
    rows = stored(rows.withColumn("part", F.coalesce(_chunk("turn"), F.lit(-(1 << 62)))), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    return running(rows.withColumn("one", F.lit(1).cast("long")), "conv_id", order, F.col("part"), {"pos": "one"}).select("conv_id", "pos", "t1", "t2", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their lengths, their turns as conv_id, depth, t1, t2, words)."""
    own = stored(turns(conversations), "ranked")
    shared = F.crc32(F.col("conv_id").cast("string")) % 4
    counts = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    counts = stored(counts, "conversations")
    bases = counts.select(F.col("conv_id").alias("of"), F.col("n").alias("of_n"))
    known = counts.join(bases, F.col("base") == F.col("of"), "left").withColumn("lent", F.least("h", F.coalesce("of_n", F.lit(0))))
    known = stored(known.select("conv_id", "h", "base", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "known")
    heads = own.where("pos <= 3").select(F.col("conv_id").alias("of"), "pos", "t1", "t2", "words")
    lent = known.where("lent > 0").join(heads, (F.col("base") == F.col("of")) & (F.col("pos") <= F.col("lent"))).select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "words")
    rest = own.join(known.select(F.col("conv_id").alias("c"), "h", "lent"), F.col("conv_id") == F.col("c")).where("pos > h").select("conv_id", (F.col("lent") + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "words")
    return known, lent.unionByName(rest)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's strings, which come sorted by node and place."""
    at, digest, first = None, None, True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], ["e1", "e2", "ends_sha256"])

    for batch in batches:
        for e1, e2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if at != (e1, e2):
                if at:
                    yield row()
                at, digest, first = (e1, e2), hashlib.sha256(), True
            digest.update(ids.encode() if first else b"," + ids.encode())
            first = False
    if at:
        yield row()


def ends(last: DataFrame) -> DataFrame:
    """e1, e2 and the digest of the conversations in ``last`` (conv_id, e1, e2), ascending."""
    strings = last.groupBy("e1", "e2", F.floor(F.col("conv_id") / ENDS).alias("place")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    strings = stored(strings, "ends")
    return strings.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "place").mapInArrow(_ends, "e1 long, e2 long, ends_sha256 string")


def _nodes(known: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, the node of every turn), nodes with their children counted and the heavy child named."""
    name = lambda i: F.xxhash64(F.lit(i), "depth", "t1", "t2")
    named = rows.withColumns({"own1": name(1), "own2": name(2)})
    named = running(named, "conv_id", [F.col("depth")], _chunk("depth"), {"k1": "own1", "k2": "own2"}, xor=True)
    named = named.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("own1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("own2")).alias("p2"), "words")
    named = stored(named, "named")
    nodes = named.groupBy("depth", "k1", "k2", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    root = known.agg(F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2")), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = stored(nodes.unionByName(root.where("n_convs > 0")), "nodes")
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("by"), "k1", "k2"))
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), largest.alias("heavy"))
    children = stored(children.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), "n_children", F.col("heavy.k1").alias("h1"), F.col("heavy.k2").alias("h2")), "children")
    tails = named.join(known.select(F.col("conv_id").alias("c"), F.col("length")), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("length")))
    tails = tails.select("conv_id", F.col("k1").alias("e1"), F.col("k2").alias("e2")).unionByName(known.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2")))
    nodes = nodes.join(children, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").join(ends(tails), (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    nodes = nodes.select("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "words", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "h1", "h2", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    nodes = stored(nodes, "nodes-with-children")
    parents = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    flagged = nodes.drop("h1", "h2").join(parents, (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left")
    light = F.coalesce((F.col("k1") != F.col("g1")) | (F.col("k2") != F.col("g2")), F.lit(False)).alias("light")
    return stored(flagged.select(*(c for c in nodes.columns if c not in ("h1", "h2")), "parent_conv_id", light), "flagged"), named


def heavy_paths(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """``nodes`` with path (its leaf's smallest conversation), head (the path's first depth) and level (light edges above)."""
    leaves = nodes.where("n_children = 0 and depth > 0").select("conv_id")
    chain = named.join(leaves, "conv_id", "left_semi").select("conv_id", "k1", "k2")
    flags = nodes.where("depth > 0").select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("depth").alias("at"), "light")
    chain = stored(chain.join(flags, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).select(F.col("conv_id").alias("path"), "k1", "k2", "at", "light"), "chains")
    paths = chain.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("at"))), F.lit(0)).alias("head"), F.count_if("light").alias("level"))
    paths = stored(paths, "paths")
    on = chain.join(paths.withColumnRenamed("path", "own"), F.col("path") == F.col("own")).where("at >= head").select("path", "head", "level", F.col("k1").alias("f1"), F.col("k2").alias("f2"))
    below = nodes.where("depth > 0").join(on, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).drop("f1", "f2")
    # the root begins the one path that has no light edge
    first = paths.where("level = 0").select("path", F.lit(0).cast("long").alias("top"))
    root = nodes.where("depth = 0").join(first, F.col("depth") == F.col("top"), "left").drop("top")
    root = root.withColumns({"path": F.coalesce("path", "conv_id"), "head": F.lit(0).cast("long"), "level": F.lit(0).cast("long")})
    return stored(below.unionByName(root.select(*below.columns)), "on-paths")


def subtree_sums(on: DataFrame) -> DataFrame:
    """``on`` with n_leaves and saved_tokens of every node's subtree."""
    on = on.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    deepest = on.agg(F.max("level")).first()[0]
    if deepest is None:
        return on.withColumns({"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")})
    out, given = None, None
    for level in range(deepest, -1, -1):
        own = on.where(F.col("level") == level)
        if given is not None:
            own = own.join(given, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left")
            own = own.withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).select(*on.columns)
        summed = stored(running(own, "path", [F.col("depth").desc()], _chunk("depth"), {"n_leaves": "leaf", "saved_tokens": "saved"}, backwards=True), f"level-{level}")
        heads = summed.where("depth = head and depth > 0").groupBy(F.col("p1").alias("a1"), F.col("p2").alias("a2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        given = stored(heads, "attached") if level else None
        out = summed if out is None else out.unionByName(summed)
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    nodes, named = _nodes(*rebuilt(conversations))
    summed = subtree_sums(heavy_paths(nodes, named))
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
