"""Operator 11: how filters interact, by a trie of their orders.

The audit runs every order of the filters, as a trie whose paths are prefixes
of orders.  It walks the trie depth first; a state is the set of filters that
have been applied, whatever their order, so each of the 2^n sets is made once
and all prefixes of the same filters share it.  A state is a persisted DataFrame
of survivors, made from its parent's survivors by one more filter; one
aggregation counts, for each part of the corpus, what every further filter
removes there.  These are the edges of the trie; orders, interactions and
Shapley values are sums over edges.  At most one path of states is persisted at
a time, and a lost executor's blocks are made again from the stored table of
verdicts.  Only names of states are on the driver; counts stay in tables.

A filter's verdict on a document doesn't depend on the others (copies are copies
of any smaller id, removed or not), so texts are read once, and states hold the
verdicts of five filters, not texts.

Defined results: a null text is empty and has no words, and equals an empty one;
null and empty ``lang`` are one part; rows with one doc_id count each and are no
copies of each other, a row with a null id is no copy and makes none; a document
with several label rows is good or toxic if one says so, rows of labels without
an id say nothing; texts of any length are read whole; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, WS_CLASS, join_by_size, stored

FILTERS = "ABCDE"
#: Bytes of a text's hash and its first id in the hash table of a broadcast, at most.
_FIRST_BYTES = 160


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, one flag for each filter that the document fails, good and toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count("text", F.lit(WORD_CLASS))
    distinct = F.size(F.array_remove(F.array_distinct(F.split("text", WS_CLASS + "+")), ""))
    flags = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id",
        "part",
        (words < 200).alias("A"),
        (100 * distinct < 50 * words).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    flags = stored(flags, "flags")
    firsts = stored(flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    marked = join_by_size(flags, firsts, "digest", "left", _FIRST_BYTES * firsts.count())
    marked = marked.withColumn("E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("digest", "first")
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"{c}_1")
    known = stored(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(said("quality"), said("toxic")), "labels")
    joined = marked.join(known, F.col("doc_id") == F.col("label_id"), "left")
    return joined.select("part", *FILTERS, F.coalesce("quality_1", F.lit(False)).alias("good"), F.coalesce("toxic_1", F.lit(False)).alias("toxic"))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


class Trie:
    """Counts at every state and edge, gathered depth first."""

    def __init__(self, documents: DataFrame, filters: str = FILTERS):
        self.filters = filters
        self.counted: dict[str, DataFrame] = {}
        self._visit("", documents)

    def _visit(self, state: str, survivors: DataFrame) -> None:
        """Count the edges out of ``state``, a sorted string of filters, then go on below it."""
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            nexts = [f for f in self.filters if f not in state]
            sums = [_count(F.lit(True)).alias("survivors")]
            for f in nexts:
                sums += [_count(F.col(f)).alias(f"removed_{f}"), _count(F.col(f) & F.col("good")).alias(f"good_{f}"), _count(F.col(f) & F.col("toxic")).alias(f"toxic_{f}")]
            self.counted[state] = stored(survivors.groupBy("part").agg(*sums), f"state-{state or 'none'}")
            for f in nexts:
                below = "".join(sorted(state + f))
                if below not in self.counted:  # else another order of these filters has made it
                    self._visit(below, survivors.where(~F.col(f)))
        finally:
            survivors.unpersist()

    def edges(self) -> DataFrame:
        """part, state, filter and what the filter removes there; an edge on which no document arrives has no row."""
        out = None
        for state, counted in self.counted.items():
            nexts = [f for f in self.filters if f not in state]
            if not nexts:
                continue
            each = F.array(*(F.struct(F.lit(f).alias("filter"), F.col(f"removed_{f}").alias("removed"), F.col(f"good_{f}").alias("good_lost"), F.col(f"toxic_{f}").alias("toxic_lost")) for f in nexts))
            rows = counted.select("part", F.lit(state).alias("state"), "survivors", F.explode(each).alias("edge")).select("part", "state", "survivors", "edge.*")
            out = rows if out is None else out.unionByName(rows)
        return out


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for every part, order of the filters and step."""
    trie = Trie(stored(verdicts(docs, labels), "verdicts"), filters)
    edges = stored(trie.edges(), "edges")
    parts = stored(trie.counted[""].select("part"), "parts")
    # every part has every edge; what has no documents is zero
    orders = F.array(*(F.lit("".join(order)) for order in permutations(filters)))
    grid = parts.select("part", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    grid = grid.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    grid = grid.withColumns({"state": letters(F.substring("filter_order", F.lit(1), F.col("step") - 1)), "others": letters(F.replace(F.col("filter_order"), F.col("filter"), F.lit("")))})
    edge = grid.join(edges, ["part", "state", "filter"], "left").fillna(0, ["survivors", "removed", "good_lost", "toxic_lost"])
    alone = edges.select("part", F.col("state").alias("others"), "filter", F.col("removed").alias("unique_fails"))
    fails = edges.where("state = ''").select("part", "filter", F.col("removed").alias("fails"))
    shapley = edge.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    out = edge.join(alone, ["part", "others", "filter"], "left").join(fails, ["part", "filter"], "left").join(shapley, ["part", "filter"])
    kept, fails_all = F.col("survivors") - F.col("removed"), F.coalesce("fails", F.lit(0))
    counts = {"kept": kept, "removed": F.col("removed"), "redundant": fails_all - F.col("removed"), "unique_fails": F.coalesce("unique_fails", F.lit(0)), "good_lost": F.col("good_lost"), "toxic_lost": F.col("toxic_lost"), "shapley": F.col("shapley")}
    return out.select("part", "filter_order", "step", *(c.cast("long").alias(k) for k, c in counts.items()))
