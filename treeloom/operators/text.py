"""Text and markup of subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import RAW_TEXT, VOID, end_tag, escape_text, start_tag
from ..schema import ELEMENT, TEXT
from .axes import rows_of
from .intervals import enclosing


def _ordered(value: str, *order: str) -> Column:
    """The strings of a group in an order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x[value]), "")


def _inside(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` paired with each of ``roots`` that they are in, themselves included; roots as _root and _depth."""
    return enclosing(nodes, roots, {"_root": F.col("node_id"), "_depth": F.col("depth")})


def text_content(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, node_id, text): the text of descendants; a text's or comment's own value; null for documents and doctypes."""
    own = rows_of(nodes, keys)
    holders = own.filter(F.col("kind").isin("element", "document_fragment", "shadow_root"))
    texts = nodes.filter(F.col("node_type") == TEXT).select("doc_id", "root_id", "pre", "value")
    joined = _inside(texts, holders)
    found = joined.groupBy("doc_id", F.col("_root").alias("node_id")).agg(_ordered("value", "pre").alias("text"))
    full = holders.select("doc_id", "node_id").join(found, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("text", F.lit("")).alias("text"))
    return full.unionByName(own.filter(~F.col("kind").isin("element", "document_fragment", "shadow_root")).select("doc_id", "node_id", F.when(F.col("kind").isin("text", "comment"), F.col("value")).alias("text")))


def _markup(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Opening and closing pieces of every node, in the order (at, side, depth)."""
    raw = parents.filter(F.col("local_name").isin(*RAW_TEXT)).select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_raw"))
    n = nodes.join(raw, ["doc_id", "parent_id"], "left")
    opening = (
        F.when(F.col("kind") == "element", start_tag())
        .when(F.col("kind") == "text", F.when(F.col("_raw"), F.col("value")).otherwise(escape_text(F.col("value"))))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("value"), F.lit("-->")))
        .when(F.col("kind") == "document_type", F.concat(F.lit("<!DOCTYPE "), F.col("local_name"), F.lit(">")))
        .otherwise("")
    )
    pieces = F.array(
        F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("order"), opening.alias("piece")),
        F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("order"), F.when(F.col("kind") == "element", end_tag()).otherwise("").alias("piece")),
    )
    return n.select("doc_id", "root_id", "node_id", "pre", F.explode(pieces).alias("p")).filter("p.piece <> ''").select("doc_id", "root_id", "node_id", "pre", "p.*")


def outer_html(nodes: DataFrame, keys: DataFrame, *, inner: bool = False) -> DataFrame:
    """(doc_id, node_id, html) of each node in ``keys``; template contents are part of their template.

    A node of void kind has no end tag, text in raw text elements is not escaped.
    """
    own = rows_of(nodes, keys)
    pieces = _markup(nodes, nodes.filter(F.col("node_type") == ELEMENT))
    met = _inside(pieces, own)
    if inner:
        met = met.filter("node_id <> _root")
    found = met.groupBy("doc_id", F.col("_root").alias("node_id")).agg(_ordered("piece", "at", "side", "order").alias("html"))
    return own.select("doc_id", "node_id").join(found, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("html", F.lit("")).alias("html"))


def inner_html(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, node_id, html) of the content of elements, fragments, shadow roots and documents."""
    return outer_html(nodes, keys, inner=True)


def text_runs(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, run): text nodes with the number of their run of adjacent texts."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("pre")
    rows = nodes.filter("parent_id is not null").withColumn("run", F.sum(F.when(F.col("node_type") != TEXT, 1).otherwise(0)).over(order))
    return rows.filter(F.col("node_type") == TEXT)


def whole_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text): for each text node the texts of its run."""
    runs = text_runs(nodes)
    full = runs.groupBy("doc_id", "parent_id", "run").agg(_ordered("value", "pre").alias("text"))
    return runs.select("doc_id", "parent_id", "run", "node_id").join(full, ["doc_id", "parent_id", "run"]).select("doc_id", "node_id", "text")


def normalized_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, value): the text nodes that normalize() leaves, with their merged values."""
    runs = text_runs(nodes).filter("value <> ''")
    # An empty text between two others does not part them.
    return runs.groupBy("doc_id", "parent_id", "run").agg(F.min_by("node_id", "pre").alias("node_id"), _ordered("value", "pre").alias("value")).select("doc_id", "node_id", "value")


def split_text(nodes: DataFrame, keys: DataFrame, offset: int) -> DataFrame:
    """(doc_id, node_id, part, value): each text of ``keys`` as two parts; an offset past its end is an error."""
    own = rows_of(nodes, keys).filter(F.col("node_type") == TEXT)
    n = F.char_length("value")
    checked = F.when(n < offset, F.raise_error(F.lit("index size"))).otherwise(F.col("value"))
    parts = F.array(F.substring(checked, F.lit(1), F.lit(offset)), F.substring(checked, F.lit(offset + 1), F.greatest(n - offset, F.lit(0))))
    return own.select("doc_id", "node_id", F.posexplode(parts).alias("part", "value"))


def subtree_digest(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, node_id, digest): equal digests for structurally equal subtrees (SHA-256 of their normal form)."""
    own = rows_of(nodes, keys)
    attributes = F.to_json(F.array_sort(F.transform("attr_list", lambda a: F.struct(a["url"], a["local"], a["value"]))))
    line = F.concat_ws("\x1f", F.col("kind"), F.coalesce("local_name", F.lit("\x00")), F.coalesce("namespace", F.lit("\x00")), F.coalesce(attributes, F.lit("\x00")), F.coalesce("value", F.lit("\x00")), F.coalesce("public_id", F.lit("")), F.coalesce("system_id", F.lit("")))
    parts = nodes.select("doc_id", "root_id", "pre", "depth", line.alias("line"))
    met = _inside(parts, own)
    met = met.withColumn("piece", F.concat((F.col("depth") - F.col("_depth")).cast("string"), F.lit("\x1e"), "line", F.lit("\x1d")))
    return met.groupBy("doc_id", F.col("_root").alias("node_id")).agg(F.sha2(_ordered("piece", "pre"), 256).alias("digest"))


def is_equal(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, node_id, other_doc, other_id) with ``equal``."""
    keys = pairs.select("doc_id", "node_id").unionByName(pairs.select(F.col("other_doc").alias("doc_id"), F.col("other_id").alias("node_id"))).distinct()
    d = subtree_digest(nodes, keys)
    other = d.select(F.col("doc_id").alias("other_doc"), F.col("node_id").alias("other_id"), F.col("digest").alias("_other"))
    return pairs.join(d, ["doc_id", "node_id"], "left").join(other, ["other_doc", "other_id"], "left").select(*pairs.columns, F.coalesce(F.col("digest") == F.col("_other"), F.lit(False)).alias("equal"))


__all__ = ["VOID", "inner_html", "is_equal", "normalized_texts", "outer_html", "split_text", "subtree_digest", "text_content", "text_runs", "whole_text"]
