"""Integrity checks of a node table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, violation): an empty result is a sound table.

    One window in tree order per tree, one per parent; nothing is collected.
    """
    key = ["doc_id", "node_id"]
    tree = Window.partitionBy("doc_id", "root_id").orderBy("pre")
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("pre")
    seen = nodes.select(
        *key, "root_id", "parent_id", "parent_type", "pre", "last", "depth", "sib_idx", "elem_idx", "node_type",
        F.lag("pre").over(tree).alias("before"), F.lag("last").over(siblings).alias("elder"),
        (F.row_number().over(siblings) - 1).alias("place"),
        F.sum(F.when(F.col("node_type") == 1, 1).otherwise(0)).over(siblings).alias("element_place"),
        F.count("*").over(Window.partitionBy(*key)).alias("same"),
    )
    has_parent = F.col("parent_id").isNotNull()
    tests = {
        "repeated node_id": F.col("same") > 1,
        "last before pre": F.col("last") < F.col("pre"),
        "gap in pre": F.col("before").isNotNull() & (F.col("pre") != F.col("before") + 1),
        "siblings overlap": has_parent & F.col("elder").isNotNull() & (F.col("elder") + 1 != F.col("pre")),
        "wrong sib_idx": has_parent & (F.col("sib_idx") != F.col("place")),
        "wrong elem_idx": has_parent & (F.col("node_type") == 1) & (F.col("elem_idx") != F.col("element_place")),
        "root with parent": (F.col("node_id") == F.col("root_id")) != F.col("parent_id").isNull(),
    }
    own = [seen.filter(t).select(*key, F.lit(name).alias("violation")) for name, t in tests.items()]
    p = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("p_pre"), F.col("last").alias("p_last"), F.col("depth").alias("p_depth"), F.col("root_id").alias("p_root"), F.col("node_type").alias("p_type"))
    up = seen.filter(has_parent).join(p, ["doc_id", "parent_id"], "left")
    nested = (F.col("pre") > F.col("p_pre")) & (F.col("last") <= F.col("p_last")) & (F.col("depth") == F.col("p_depth") + 1) & (F.col("root_id") == F.col("p_root")) & (F.col("parent_type") == F.col("p_type"))
    own.append(up.filter(F.col("p_pre").isNull()).select(*key, F.lit("no parent").alias("violation")))
    own.append(up.filter(F.col("p_pre").isNotNull() & ~nested).select(*key, F.lit("not within parent").alias("violation")))
    return reduce(DataFrame.unionByName, own)
