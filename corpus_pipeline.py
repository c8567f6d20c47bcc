"""The corpus pipeline: from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; the
result is written as Parquet and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``.

Defined results: an empty table stays empty through all stages; a null text has
no letter and is rejected by the first stage; where no language is labelled,
none can be told, and only texts without a letter are rejected.  Later stages
drop rows by their ids: rows with one id go or stay together, and a row whose id
is null stays.  Further columns are carried along, up to packing.  Texts of any
length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrain.llm import exact_dedup, language_id, mixing, ngram_join, packing
from geostrain.llm.common import ID_BYTES, join_by_size, read_table, stored

#: Texts whose language is less sure than this are rejected.
LEAST_SCORE = 0.5


def _without(docs: DataFrame, decided: DataFrame, dropped: str) -> DataFrame:
    """``docs`` without the ids that ``decided`` (doc_id, ...) marks as dropped."""
    ids = stored(decided.where(dropped).where("doc_id is not null").select("doc_id").distinct(), "dropped")
    return join_by_size(docs, ids, "doc_id", "left_anti", ID_BYTES * ids.count())


def _fresh(name: str, docs: DataFrame) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label every document; those without letters or with an unsure label go."""
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "lang"))
    label, score = _fresh("label", docs), _fresh("score", docs)
    labelled = language_id.identify(docs, model, rest, names=(label, score))
    kept = labelled.where((F.col(label) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(label)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, exact_dedup.exact_duplicates(docs), "not kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links stays: that with the least id."""
    return _without(docs, ngram_join.near_duplicates(docs, count_links=False), "component_id <> doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, mixing.mix(docs), "n_copies = 0")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language identification", identify_language),
    ("exact duplicates", drop_exact_copies),
    ("near duplicates", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
