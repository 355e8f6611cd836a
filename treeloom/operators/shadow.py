"""Shadow trees and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ELEMENT, TEXT
from .intervals import semi


def shadow_roots(nodes: DataFrame, *, open_only: bool = True) -> DataFrame:
    """(doc_id, host_id, shadow_id, mode): what shadowRoot shows; closed ones are null there."""
    rows = nodes.filter(F.col("kind") == "shadow_root")
    if open_only:
        rows = rows.filter(F.col("shadow_mode") == "open")
    return rows.select("doc_id", "host_id", F.col("node_id").alias("shadow_id"), F.col("shadow_mode").alias("mode"))


def slots(nodes: DataFrame) -> DataFrame:
    """(doc_id, host_id, slot_id, slot_name): the first slot of each name in each shadow tree."""
    shadows = nodes.filter(F.col("kind") == "shadow_root").select("doc_id", F.col("node_id").alias("root_id"), "host_id", F.col("slot_assignment").alias("_how"))
    found = nodes.filter((F.col("node_type") == ELEMENT) & (F.col("local_name") == "slot")).drop("host_id").join(shadows, ["doc_id", "root_id"])
    name = F.coalesce(F.try_element_at("attrs", F.lit("name")), F.lit(""))
    order = Window.partitionBy("doc_id", "host_id", "slot_name").orderBy("pre")
    return found.select("doc_id", "host_id", F.col("node_id").alias("slot_id"), name.alias("slot_name"), "pre", "_how").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "pre")


def slot_assignment(nodes: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(doc_id, host_id, slot_id, node_id, position): light children of hosts by slot.

    Named: a child goes to the first slot with its ``slot`` attribute's name, text
    to the one without a name.  Manual: ``manual`` (doc_id, slot_id, nodes) lists
    the nodes of a slot; those that are no children of the host are left out.
    """
    named = slots(nodes).filter(F.coalesce("_how", F.lit("named")) == "named")
    kids = nodes.filter(F.col("node_type").isin(ELEMENT, TEXT)).select(
        "doc_id", F.col("parent_id").alias("host_id"), "node_id", "pre", F.when(F.col("node_type") == ELEMENT, F.coalesce(F.try_element_at("attrs", F.lit("slot")), F.lit(""))).otherwise("").alias("slot_name"))
    order = Window.partitionBy("doc_id", "slot_id").orderBy("pre")
    out = named.join(kids, ["doc_id", "host_id", "slot_name"]).select("doc_id", "host_id", "slot_id", "node_id", (F.row_number().over(order) - 1).alias("position"))
    if manual is None:
        return out
    shadows = nodes.filter((F.col("kind") == "shadow_root") & (F.col("slot_assignment") == "manual")).select("doc_id", F.col("node_id").alias("root_id"), "host_id")
    theirs = nodes.filter(F.col("local_name") == "slot").select("doc_id", "root_id", F.col("node_id").alias("slot_id")).join(shadows, ["doc_id", "root_id"])
    listed = manual.select("doc_id", "slot_id", F.posexplode("nodes").alias("_i", "node_id")).join(theirs, ["doc_id", "slot_id"])
    mine = semi(listed, nodes.select("doc_id", "parent_id", "node_id"), [("doc_id", "doc_id"), ("host_id", "parent_id"), ("node_id", "node_id")])
    # A node is in the last slot that it was given to.
    last = Window.partitionBy("doc_id", "node_id").orderBy(F.col("slot_id").desc())
    mine = mine.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    place = Window.partitionBy("doc_id", "slot_id").orderBy("_i")
    return out.unionByName(mine.select("doc_id", "host_id", "slot_id", "node_id", (F.row_number().over(place) - 1).alias("position")))


def assigned_nodes(assignment: DataFrame, nodes: DataFrame, *, elements: bool = False) -> DataFrame:
    """(doc_id, slot_id, nodes): lists in order."""
    rows = assignment
    if elements:
        rows = semi(rows, nodes.filter(F.col("node_type") == ELEMENT).select("doc_id", "node_id"), [("doc_id", "doc_id"), ("node_id", "node_id")])
    return rows.groupBy("doc_id", "slot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "node_id"))), lambda x: x["node_id"]).alias("nodes"))


def assigned_slot(assignment: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, slot_id) of slots in open shadow trees."""
    return assignment.join(shadow_roots(nodes).select("doc_id", "host_id"), ["doc_id", "host_id"], "left_semi").select("doc_id", "node_id", "slot_id")


def slot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, slot_id) of slots whose assignment differs, each once: the slotchange signals."""
    lists = lambda a: a.groupBy("doc_id", "slot_id").agg(F.sort_array(F.collect_list(F.struct("position", "node_id"))).alias("_l"))
    a, b = lists(before), lists(after).withColumnRenamed("_l", "_m")
    return a.join(b, ["doc_id", "slot_id"], "full_outer").filter(~F.col("_l").eqNullSafe(F.col("_m"))).select("doc_id", "slot_id")
