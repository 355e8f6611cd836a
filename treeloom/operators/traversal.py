"""Tree walkers and node iterators as ordered tables of accepted nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SHOW_ALL, shown
from .axes import rows_of
from .intervals import nearest_ancestor, semi, within

ACCEPT, SKIP, REJECT = "accept", "skip", "reject"


def tree_walker(nodes: DataFrame, root: DataFrame, *, what_to_show: int = SHOW_ALL, filter: Column | None = None) -> DataFrame:
    """The nodes that a walker under ``root`` (doc_id, node_id) visits, with neighbours.

    ``filter`` is a column of accept, skip or reject; reject takes the subtree
    with it.  Columns: the node's, then previous_id, next_id (in tree order, the
    root is first), parent_id_ (nearest accepted ancestor), previous_sibling,
    next_sibling, first_child, last_child among what the walker sees.
    """
    verdict = F.lit(ACCEPT) if filter is None else F.coalesce(filter, F.lit(ACCEPT))
    top = rows_of(nodes, root)
    scope = within(nodes, top.select("doc_id", "root_id", "pre", "last"), inclusive=True)
    judged = scope.withColumn("_verdict", F.when(~shown(what_to_show), SKIP).otherwise(verdict))
    is_top = top.select("doc_id", "node_id")
    below = semi(judged, is_top, [("doc_id", "doc_id"), ("node_id", "node_id")], how="left_anti")
    rejected = below.filter(F.col("_verdict") == REJECT).select("doc_id", "root_id", "pre", "last")
    gone = within(below, rejected, inclusive=True).select("doc_id", "node_id")
    seen = semi(below.filter(F.col("_verdict") == ACCEPT), gone, [("doc_id", "doc_id"), ("node_id", "node_id")], how="left_anti")
    # The walker starts at its root, whatever the filter says of it.
    seen = seen.drop("_verdict").unionByName(top)
    order = Window.partitionBy("doc_id", "root_id").orderBy("pre")
    carriers = seen.withColumn("_id", F.col("node_id"))
    seen = nearest_ancestor(seen, carriers, "_id", "parent_id_", inclusive=False)
    family = Window.partitionBy("doc_id", "parent_id_").orderBy("pre")
    sibling = lambda f: F.when(F.col("parent_id_").isNotNull(), f("node_id").over(family))
    seen = seen.withColumns({"previous_id": F.lag("node_id").over(order), "next_id": F.lead("node_id").over(order), "previous_sibling": sibling(F.lag), "next_sibling": sibling(F.lead)})
    kids = seen.filter("parent_id_ is not null").groupBy("doc_id", F.col("parent_id_").alias("node_id")).agg(F.min_by("node_id", "pre").alias("first_child"), F.max_by("node_id", "pre").alias("last_child"))
    return seen.join(kids, ["doc_id", "node_id"], "left")


def node_iterator(nodes: DataFrame, root: DataFrame, *, what_to_show: int = SHOW_ALL, filter: Column | None = None) -> DataFrame:
    """The nodes that an iterator yields, with ``position`` from 1; reject is as skip."""
    top = rows_of(nodes, root)
    scope = within(nodes, top.select("doc_id", "root_id", "pre", "last"), inclusive=True)
    verdict = F.lit(True) if filter is None else F.coalesce(filter == ACCEPT, F.lit(True))
    order = Window.partitionBy("doc_id", "root_id").orderBy("pre")
    return scope.filter(shown(what_to_show) & verdict).withColumn("position", F.row_number().over(order))


def adjust_reference(nodes: DataFrame, references: DataFrame, removed: DataFrame) -> DataFrame:
    """``references`` (doc_id, node_id, before) after the subtrees of ``removed`` go.

    A reference inside moves to the next node after the subtree, if the pointer
    is before it and there is one, else to the node before the subtree.
    """
    roots = rows_of(nodes, removed).select(F.col("doc_id").alias("_d"), F.col("root_id").alias("_t"), F.col("pre").alias("_p"), F.col("last").alias("_l"))
    at = references.join(nodes.select("doc_id", "node_id", F.col("root_id").alias("_r"), F.col("pre").alias("_pre")), ["doc_id", "node_id"])
    hit = at.join(roots, (F.col("doc_id") == F.col("_d")) & (F.col("_r") == F.col("_t")) & (F.col("_pre") >= F.col("_p")) & (F.col("_pre") <= F.col("_l")), "left")
    by_pre = nodes.select(F.col("doc_id").alias("_nd"), F.col("root_id").alias("_nr"), F.col("pre").alias("_np"), F.col("node_id").alias("_nid"))
    after = by_pre.toDF("_ad", "_ar", "_ap", "_after")
    out = hit.join(after, (F.col("_d") == F.col("_ad")) & (F.col("_t") == F.col("_ar")) & (F.col("_l") + 1 == F.col("_ap")), "left")
    out = out.join(by_pre, (F.col("_d") == F.col("_nd")) & (F.col("_t") == F.col("_nr")) & (F.col("_p") - 1 == F.col("_np")), "left")
    moves = F.col("_p").isNotNull()
    forward = F.col("before") & F.col("_after").isNotNull()
    return out.select("doc_id", F.when(moves, F.when(forward, F.col("_after")).otherwise(F.col("_nid"))).otherwise(F.col("node_id")).alias("node_id"), F.when(moves, forward).otherwise(F.col("before")).alias("before"))
