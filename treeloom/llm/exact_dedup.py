"""Exact duplicates by a tree merge of sorted digest runs.

Every partition of the input is a run: its distinct digests in order, each with
the row to keep and a count.  In binomial rounds the owners of runs exchange
them, ``fan_in`` to one, and merge equal digests, so a text that makes up a
third of the corpus is one entry of each run before anything is shuffled, and no
round moves more than the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, full_text, staged


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of the normalised text (A-Z lower-cased, null as empty), 32 bytes."""
    return F.unhex(F.sha2(F.encode(ascii_lower(full_text(text)), "UTF-8"), 256))


def digest_runs(docs: DataFrame) -> DataFrame:
    """A row per document: its digest, byte length and a second hash, its run and its place."""
    low = ascii_lower(full_text())
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest().alias("digest"),
        F.octet_length(low).cast("long").alias("n_bytes"),
        F.xxhash64(low).alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("place"),
    )


#: Texts are one if all three agree; the last two verify the first.
KEY = ("digest", "n_bytes", "check")


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = 16) -> DataFrame:
    """One entry per distinct text: KEY, keep (doc_id, place) and group_size.

    Level k merges the runs whose numbers agree above k digits of base
    ``fan_in``.  Of equal texts the largest doc_id is kept, of repeated rows the
    last place.
    """
    entries = runs.select(*KEY, "run", F.struct("doc_id", "place").alias("keep"), F.lit(1).cast("long").alias("group_size"))
    width = 1
    while True:
        width *= fan_in
        owner = F.floor(F.col("run") / F.lit(width)).cast("int").alias("run")
        entries = (
            entries.withColumn("run", owner)
            .groupBy("run", *KEY)
            .agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
        if width >= n_runs:
            return entries.drop("run")
        entries = entries.sortWithinPartitions("run", "digest")


def decide(docs: DataFrame, *, fan_in: int = 16) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text is
    an empty one.  The row with the largest doc_id stays (a null one is the
    smallest); of repeated rows with that id one stays.  An empty table gives an
    empty one.  Columns other than doc_id and text are not read.
    """
    runs = staged(digest_runs(docs), "digest-runs")
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    merged = merge_runs(runs, n_runs, fan_in).filter("group_size > 1")
    # Only texts that occur twice or more go into the join; AQE splits the
    # partition of a frequent one.
    joined = runs.select("doc_id", *KEY, "place").join(merged, list(KEY), "left")
    keep = F.coalesce("keep", F.struct("doc_id", "place"))
    return joined.select(
        "doc_id",
        keep["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("place") == keep["place"]).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, *, fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, with all their columns, whatever their names.

    They are found by doc_id and digest, so rows of one frequent text spread
    over all tasks.  Where a kept row itself is repeated, one of its copies
    stays.
    """
    runs = staged(digest_runs(docs), "digest-runs")
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    own, keep, of = (free_name(docs, c) for c in ("own", "keep", "digest"))
    merged = merge_runs(runs, n_runs, fan_in).select(F.col("keep.doc_id").alias(keep), F.col("digest").alias(of))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(keep)) & (F.col(own) == F.col(of))
    mine = docs.withColumn(own, digest())
    repeats = runs.groupBy("doc_id", "digest").count().filter("count > 1").select(F.col("doc_id").alias(keep), F.col("digest").alias(of))
    if repeats.isEmpty():
        return mine.join(merged, same, "left_semi").select(*docs.columns)
    once = mine.join(repeats, same, "left_anti").join(merged, same, "left_semi")
    # At most one row of each repeated id goes on.
    again = mine.join(repeats, same, "left_semi").join(merged, same, "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", own])).select(*docs.columns)
