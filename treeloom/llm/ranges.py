"""Ranges of doc_id with about equal numbers of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Ranges at most, unless the cluster has more shuffle partitions: the driver holds a
#: bound of each.  Beyond, ranges hold more rows, so what works on a range must read it
#: as a stream.
MOST = 8192


def in_ranges(docs: DataFrame, rows_per_range: int) -> tuple[DataFrame, list[tuple[int, int | None]]]:
    """``docs`` with a column range, and (range, smallest doc_id) of each range that has rows.

    Ranges ascend with doc_id; a null one is in the first.  The driver gets a
    bound and a head for each range, never ids of all documents.
    """
    most = max(MOST, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = min(most, -(-docs.count() // rows_per_range))
    bounds: list[int] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n))).first()[0] or []))
    cuts = np.array(bounds, dtype=np.int64)

    # The function sees ids as text, since a batch with a null id would come as
    # floats, which lose large ids.
    @F.pandas_udf("int")
    def place(doc_id: pd.Series) -> pd.Series:
        there = doc_id.notna().to_numpy()
        found = np.zeros(len(doc_id), dtype=np.int32)
        found[there] = np.searchsorted(cuts, np.array(list(map(int, doc_id[there])), dtype=np.int64), side="right")
        return pd.Series(found)

    ranged = docs.withColumn("range", place(F.col("doc_id").cast("string")) if bounds else F.lit(0))
    heads = docs.select("doc_id").withColumn("range", place(F.col("doc_id").cast("string")) if bounds else F.lit(0)).groupBy("range").agg(
        F.min("doc_id").alias("head"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("range").collect()
    return ranged, [(r["range"], None if r["nulls"] else r["head"]) for r in heads]
