"""Operator 4: secrets, with linking of multipart credentials.  JVM only.

Three base kinds are found by pattern.  Credentials often come in parts, an
identifier, a secret and an endpoint, and each part alone may be too weak to
report.  Weak parts are therefore joined with each other and with the base
spans of the same text wherever their intervals lie within ``SCOPE`` code
points, and a weak part is reported only if its complement is there: a weak
identifier needs a secret, a weak secret an identifier, an endpoint both.

Matches become rows of (row, kind, start, end); the texts stay behind.  The
interval join is a merge over the sorted spans of a text: of all spans of a class
that begin earlier, only the furthest end can be near, and of those that begin
later only the first begin.  It takes time in proportion to the spans, and never
makes pairs.  Positions are code points, ends exclusive; they follow from the
lengths of the matches and of the gaps between them.

Defined results: null counts as empty; texts of any length are read whole;
spans that begin together are listed in the order of kinds; equal rows, rows
with equal ids and rows with a null id are reported each on their own; further
columns are ignored whatever their names are; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> (pattern, group whose length counts, least length)
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))" + _VALUE + "([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Parts that count only beside their complement; for the order of kinds they follow the base.
WEAK = {
    "ident": (r"(?<![A-Za-z0-9])((?i:user(?:_?name)?|login|client_?id|access_?key(?:_?id)?|account(?:_?id)?))" + _VALUE + "([A-Za-z0-9@._-]+)", 2, 3),
    "weak": (r"(?<![A-Za-z0-9])((?i:pwd|pass|auth|private_?key|credentials?|signature))" + _VALUE + "([A-Za-z0-9+/_.=-]+)", 2, 6),
    "endpoint": (r"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""", 0, 10),
}
#: Code points between parts of one credential, at most.
SCOPE = 200

_MATCHES = "array<struct<pos:int,kind:int,step:int,size:int,long_enough:boolean>>"


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost matches that do not overlap: the gap before each, its size, and whether it counts."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value")),
        lambda x, i: F.struct(i.alias("pos"), F.lit(kind).alias("kind"), F.length(x["gap"]).alias("step"), F.length(x["hit"]).alias("size"), (F.length(x["value"]) >= least).alias("long_enough")),
    )
    return F.when(text.rlike(pattern), steps).otherwise(F.array().cast(_MATCHES))


def span_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end of every match that counts; one row without a kind for other texts."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*(matches(text, pattern, group, least, k) for k, (pattern, group, least) in enumerate((BASE | WEAK).values())))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), found.alias("found"))
    rows = rows.select("doc_id", "row", F.explode_outer("found").alias("x")).select("doc_id", "row", "x.*").repartition("row")
    along = Window.partitionBy("row", "kind").orderBy("pos")
    rows = rows.withColumn("end", F.sum(F.col("step") + F.coalesce("size", F.lit(0))).over(along).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    # what follows the last match is a gap alone; a text keeps its first row, whatever it holds
    counts = F.coalesce("long_enough", F.lit(False))
    return rows.withColumn("kind", F.when(counts, F.col("kind"))).select("row", "doc_id", "kind", "start", "end")


def within(spans: DataFrame, name: str, chosen: Column, reach: int) -> DataFrame:
    """Flag ``name``: a span of the class ``chosen`` begins at most ``reach`` after this one's end and ends at most so long before its start."""
    upto = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(chosen, F.col("end"))).over(upto) >= F.col("start") - reach
    behind = F.min(F.when(chosen, F.col("start"))).over(after) <= F.col("end") + reach
    return spans.withColumn(name, F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False)))


def listed(names: Column, chosen: Column) -> Column:
    """The chosen spans of a text, as kind:start:end by start, then kind."""
    each = F.sort_array(F.collect_list(F.when(chosen, F.struct("start", "kind", "end"))))
    return F.array_join(F.transform(each, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every text."""
    kinds = [*BASE, *WEAK]
    number = {kind: k for k, kind in enumerate(kinds)}
    of = lambda *chosen: F.col("kind").isin([number[c] for c in chosen])
    spans = span_rows(docs)
    # a weak part that touches a base span is that span's own; it neither counts nor helps
    spans = within(spans, "inside", of(*BASE), -1)
    spans = spans.withColumn("kind", F.when(~(of(*WEAK) & F.col("inside")), F.col("kind")))
    spans = within(spans, "by_id", of("access", "ident"), scope)
    spans = within(spans, "by_key", of("assign", "hex", "weak"), scope)
    linked = of("ident") & F.col("by_key") | of("weak") & F.col("by_id") | of("endpoint") & F.col("by_id") & F.col("by_key")
    names = F.array(*map(F.lit, kinds))
    counts = [F.count_if(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    found = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, listed(names, of(*BASE)).alias("base"), listed(names, of(*BASE) | linked).alias("spans"))
    return found.select("doc_id", *(f"n_{kind}" for kind in BASE), F.sha2("base", 256).alias("base_sha256"), "spans")
