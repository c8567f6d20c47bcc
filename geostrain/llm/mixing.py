"""Operator 7: mix sources to target weights.  JVM only.

Sources are the leaves of a tree of domains, languages and sources.  A budget
of tokens goes down the tree in proportion to the weights of siblings.  A node
that has fewer tokens than its share keeps all it has (times the epochs
allowed); its shortage goes to its siblings, and only what a whole subtree
cannot use reaches the siblings of an ancestor.  Because a node's capacity is
the sum of its leaves, one division of each level, from the top, does both.

A leaf with budget ``b`` and ``n`` tokens takes its documents ``b // n`` times,
and of the next epoch, in that epoch's seeded order, the longest prefix whose
tokens fit the rest.

All numbers are integers, so results don't depend on the order of sums.

Defined results: null texts have no tokens; null languages and sources are
nodes of their own; a domain without weight has the weight 1, as have languages
and sources; documents with equal ids are taken or left together; texts of any
length are counted whole; of documents at one place of the order the lesser id
comes first; an empty table gives an empty result; further columns are ignored
whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, stored

LEVELS = ("domain", "lang", "source")
#: Slices of a leaf's seeded order; each is summed on its own.
SLICES = 1024
_BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Plan:
    """What to mix: weights by name for each level, budget and epochs."""

    target_share: tuple[int, int] = (3, 5)  # of all tokens, as a fraction
    max_epochs: int = 1
    seed: int = 11
    domains: dict[str, int] = field(default_factory=lambda: {"web": 5, "books": 3, "code": 2})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if min([1, *self.domains.values(), *self.languages.values(), *self.sources.values(), self.max_epochs, self.target_share[1]]) < 1:
            raise ValueError("weights, epochs and the share's denominator are positive integers")


def domain(source: Column) -> Column:
    """The domain of a source: by the number in its name."""
    number = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("long"), F.lit(0)) % 3
    return F.when(number == 0, "web").when(number == 1, "books").otherwise("code")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A seeded place in an epoch's order, from 0 to 2**52 - 1."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    known = [F.when(F.col(column) == k, w) for k, w in weights.items()]
    return F.coalesce(*known, F.lit(1)).cast("long")


def divided(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Share each parent's budget: columns weight and capacity in, budget out.

    Siblings in the order of capacity over weight: while the next one is full
    at the common rate, it keeps its capacity; the others share what is left in
    proportion to their weights, rounded down.
    """
    siblings = Window.partitionBy(*parent).orderBy("rate", *[c for c in LEVELS if c in nodes.columns])
    rows = nodes.withColumn("given", budget).withColumn("rate", F.col("capacity").cast("double") / F.col("weight"))
    ahead = F.coalesce(F.sum("capacity").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(siblings.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("left", (F.col("given") - ahead).cast(_BIG)).withColumn("shares", behind.cast(_BIG))
    open_ = F.col("left") * F.col("weight").cast(_BIG) < F.col("capacity").cast(_BIG) * F.col("shares")
    whole = Window.partitionBy(*parent)
    cut = F.min(F.when(open_, F.struct("rate", *[c for c in LEVELS if c in nodes.columns], "left", "shares"))).over(whole)
    rows = rows.withColumn("cut", cut)
    own = F.struct("rate", *[c for c in LEVELS if c in nodes.columns])
    edge = F.struct(*(F.col(f"cut.{c}") for c in ["rate", *[c for c in LEVELS if c in nodes.columns]]))
    share = F.floor(F.expr("CAST(cut.left AS DECIMAL(38,0)) * CAST(weight AS DECIMAL(38,0)) div cut.shares")).cast("long")
    filled = F.when(F.col("cut").isNull() | (own < edge), F.col("capacity")).otherwise(F.greatest(F.lit(0), F.least(F.col("capacity"), share)))
    return rows.withColumn("budget", filled.cast("long")).drop("given", "rate", "left", "shares", "cut")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Budget of each leaf; ``leaves`` has the levels and n_tokens."""
    weights = dict(zip(LEVELS, (plan.domains, plan.languages, plan.sources), strict=True))
    leaves = leaves.withColumn("capacity", F.col("n_tokens") * plan.max_epochs)
    total = leaves.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]
    above, given = [], F.lit(total * plan.target_share[0] // plan.target_share[1])
    budgets = None
    for level in LEVELS:
        nodes = leaves.groupBy(*above, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights[level]))
        if above:
            on = [nodes[c].eqNullSafe(budgets[f"up_{c}"]) for c in above]
            nodes = nodes.join(budgets, on).drop(*(f"up_{c}" for c in above))
            given = F.col("up_budget")
        nodes = divided(nodes, above or [F.lit(0)], given).drop("up_budget")
        above = [*above, level]
        budgets = nodes.select(*(F.col(c).alias(f"up_{c}") for c in above), F.col("budget").alias("up_budget"))
    return stored(budgets.select(*(F.col(f"up_{c}").alias(c) for c in LEVELS), F.col("up_budget").alias("leaf_budget")), "budgets")


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, its leaf, tokens, and how often it is taken (0: not)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("source")).alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("n_tokens"))
    rows = stored(rows, "tokens")
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens")), "leaves")
    b = leaf_budgets(leaves, plan).alias("b")
    t = leaves.alias("t")
    cuts = t.join(b, [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in LEVELS])
    full = F.when(F.col("n_tokens") > 0, F.expr("leaf_budget div n_tokens")).otherwise(F.lit(0)).cast("long")
    cuts = cuts.select(*(F.col(f"t.{c}").alias(f"leaf_{c}") for c in LEVELS), "leaf_budget", full.alias("epochs"), (F.col("leaf_budget") - full * F.col("n_tokens")).alias("rest"))
    cuts = stored(cuts, "cuts")
    same = [F.col(c).eqNullSafe(F.col(f"leaf_{c}")) for c in LEVELS]
    placed = rows.join(cuts, same).withColumn("place", order_key(plan.seed, F.col("epochs"), F.col("doc_id")))
    # the prefix of a leaf of any size: sums of slices of the order, then inside the slice where the budget ends
    place_slice = F.floor(F.col("place") / (2**52 // SLICES)).cast("int")
    leaf = [f"leaf_{c}" for c in LEVELS]
    slices = placed.groupBy(*leaf, "rest", place_slice.alias("slice")).agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*leaf).orderBy("slice")
    reached = F.sum("n").over(along)
    slices = slices.withColumn("upto", reached)
    ends = slices.where(F.col("upto") > F.col("rest")).groupBy(*leaf).agg(F.min("slice").alias("slice"), F.min_by(F.col("upto") - F.col("n"), "slice").alias("before"))
    ends = stored(ends.select(*(F.col(c).alias(f"end_{c}") for c in leaf), "slice", "before"), "ends")
    at_end = [F.col(c).eqNullSafe(F.col(f"end_{c}")) for c in leaf]
    inside = placed.withColumn("own", place_slice).join(ends, [*at_end, F.col("own") == F.col("slice")])
    by_doc = inside.groupBy(*leaf, "rest", "before", "place", "doc_id").agg(F.sum("n_tokens").alias("n"))
    run = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("place", "doc_id"))
    marks = by_doc.withColumn("run", run).where(F.col("run") > F.col("rest")).groupBy(*leaf).agg(F.min(F.struct("place", "doc_id")).alias("stop"))
    marks = stored(marks.select(*(F.col(c).alias(f"end_{c}") for c in leaf), F.col("stop.place").alias("stop_place"), F.col("stop.doc_id").alias("stop_id")), "marks")
    out = placed.join(marks, at_end, "left")
    before = (F.col("place") < F.col("stop_place")) | (F.col("place") == F.col("stop_place")) & (F.col("doc_id") < F.col("stop_id"))
    taken = F.col("epochs") + F.when((F.col("rest") > 0) & F.coalesce(before, F.col("stop_place").isNull()), 1).otherwise(0)
    return out.select("doc_id", *LEVELS, "n_tokens", "leaf_budget", taken.cast("long").alias("n_copies"))
