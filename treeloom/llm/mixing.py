"""Mixing of sources to target weights along a curriculum.

A source's weight changes over training.  Integrated over training time its
schedule is the words that the source has given by then; the inverse of that
turns a document's place among its source's words into a training position.  The
places are prefix sums in two levels, over buckets of a source and within a
bucket, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, full_text, staged


def word_count(text: str = "text") -> Column:
    return F.regexp_count(full_text(text), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """A row per source (key): source_size, target, slot (which of the weights).

    Targets are the weights' shares of all words, none above ``cap`` times its
    source; what is above goes to the rest by weight.  Sorted by cap per weight,
    the common level is the first that no later cap is below.  The table has a
    row per source; the window over it is over sources, not documents.
    """
    by = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    at = by.withColumn("slot", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    at = at.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("slot") + 1).cast("long"))
    at = at.withColumn("cap", F.col("source_size") * cap)
    all_rows = Window.partitionBy()
    rising = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({
        "total": F.sum("source_size").over(all_rows),
        "caps_below": F.coalesce(F.sum("cap").over(rising), F.lit(0).cast("long")),
        "weights_left": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(rising), F.lit(0).cast("long")),
    })
    at = at.withColumn("level", (F.col("total") - F.col("caps_below")).cast("double") / F.col("weights_left"))
    fits = F.when(F.col("level") <= F.col("cap").cast("double") / F.col("weight"), F.struct((F.col("cap").cast("double") / F.col("weight")).alias("at"), "key", "level"))
    at = at.withColumn("level", F.min(fits).over(all_rows)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return at.select("key", "source_size", "slot", target.alias("target"))


def invert_demand(share: Column, slope: Column) -> Column:
    """The training time t at which a source has given ``share`` of its words.

    Its weight at t is in proportion to 1 + slope * (2t - 1), so by t it has given
    t + slope * (t*t - t).
    """
    return 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, slopes: tuple[float, ...] = (-0.5, 0.0, 0.5),
        bucket_rows: int = 1024, seed: str = "mix", whole_documents: bool = False) -> DataFrame:
    """A row for each row of ``docs``, in training order: doc_id, size, source_size, target, taken, copies, positions.

    Sources in order of code points, a null one last, have the ``weights`` and
    ``slopes`` in turn.  A document's copies come ``source_size`` words apart in
    its source's random but fixed order; the last turn ends at the target, in the
    midst of a document if need be.  taken counts the words of all copies, copies
    how many there are, positions has the training time in [0, 1] of each.  With
    ``whole_documents`` the document at the end is taken if its middle is before
    the target.

    A null text is empty: size 0, taken 0, no positions, at the end.  Repeated
    rows are documents of their own.  An empty table gives an empty one.  Runs
    agree, since the order is by a hash of doc_id.
    """
    spark = docs.sparkSession
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    sized = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        word_count().alias("size"), order.alias("o"),
    ), "sized")
    most = sized.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // bucket_rows))
    # The order is by hash, so equal ranges of it hold about equal numbers of rows.
    bucket = F.floor(F.conv(F.substring("o", 1, 8), 16, 10).cast("double") * n_buckets / 2.0**32).cast("int")
    sized = sized.withColumn("bucket", bucket)
    sums = sized.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0).cast("long")).alias("base"))
    starts = staged(starts.join(targets(sized, weights, cap), "key"), "starts")

    within = Window.partitionBy("key", "bucket").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    placed = placed.join(starts, ["key", "bucket"])
    start = F.col("base") + F.col("ahead")
    wanted = F.round("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.select("*", start.alias("start"), wanted.alias("wanted"), turns.alias("turns"), (wanted - turns * F.col("source_size")).alias("rest"))
    if whole_documents:
        last = F.when(2 * (F.col("rest") - F.col("start")) >= F.col("size"), F.col("size")).otherwise(0)
        last = F.when(F.col("rest") > 0, last).otherwise(0)
    else:
        last = F.greatest(F.lit(0).cast("long"), F.least(F.col("rest") - F.col("start"), F.col("size")))
    placed = placed.withColumn("last", last.cast("long"))
    copies = F.when(F.col("size") > 0, F.col("turns") + (F.col("last") > 0).cast("long")).otherwise(F.lit(0).cast("long"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), F.col("slot") + 1)
    share = lambda e: F.least(F.lit(1.0), (F.col("start") + e * F.col("source_size")).cast("double") / F.col("wanted"))
    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda e: invert_demand(share(e), slope))).otherwise(F.array().cast("array<double>"))
    out = placed.select(
        "doc_id", "size", "source_size", "target", (F.col("turns") * F.col("size") + F.col("last")).alias("taken"),
        copies.alias("copies"), positions.alias("positions"), "o",
    )
    first = F.try_element_at("positions", F.lit(1))
    return out.orderBy(first.isNull(), first, "o", "doc_id").drop("o")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row per copy of a document: doc_id, copy, position, sorted by position."""
    return mixed.select("doc_id", F.posexplode("positions").alias("copy", "position")).orderBy("position", "doc_id", "copy")
