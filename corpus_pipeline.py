"""Documents to packed training sequences, in five stages.

Each stage works on what the one before it kept.  All but the last return the
columns of documents, and further columns that the rows have, whatever their names.
A null text is an empty one, texts of any length are read whole, and an empty table
gives an empty one.  Repeated rows: exact dedup keeps one.  Rows that share a doc_id,
or have none, are judged by their own text, but mixed as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from treeloom.llm.common import free_name, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained model does not call toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words at a similarity of 0.8."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in training order."""
    mixed = mixing.mix(docs, whole_documents=True)
    own, places, place = (free_name(docs, c) for c in ("id", "positions", "position"))
    taken = mixed.groupBy(F.col("doc_id").alias(own)).agg(F.max("positions").alias(places)).filter(F.size(places) > 0)
    copies = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(taken[own]))
    return copies.select(*docs.columns, F.explode(places).alias(place)).orderBy(place, "doc_id").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The learned model, minhashes and tokenizer are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
