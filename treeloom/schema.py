"""The node table: one row per node, labelled with nested-set intervals.

``pre`` numbers the nodes of a document in tree order, ``last`` is the ``pre`` of
a node's last descendant (its own if it has none), so d is a descendant of a if
``a.pre < d.pre <= a.last`` within one ``root_id``.
"""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTE = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("local", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("qname", T.StringType()),
    T.StructField("value", T.StringType()),
])

NODES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("root_id", T.LongType()),
    T.StructField("parent_id", T.LongType()),
    T.StructField("parent_type", T.IntegerType()),
    T.StructField("pre", T.LongType()),
    T.StructField("last", T.LongType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("sib_idx", T.IntegerType()),
    T.StructField("elem_idx", T.IntegerType()),
    T.StructField("elem_cnt", T.IntegerType()),
    T.StructField("type_idx", T.IntegerType()),
    T.StructField("type_cnt", T.IntegerType()),
    T.StructField("content_child_cnt", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("node_type", T.IntegerType()),
    T.StructField("local_name", T.StringType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("class_tokens", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attr_list", T.ArrayType(ATTRIBUTE)),
    T.StructField("value", T.StringType()),
    T.StructField("public_id", T.StringType()),
    T.StructField("system_id", T.StringType()),
    T.StructField("content_root_id", T.LongType()),
    T.StructField("shadow_root_id", T.LongType()),
    T.StructField("host_id", T.LongType()),
    T.StructField("shadow_mode", T.StringType()),
    T.StructField("slot_assignment", T.StringType()),
    T.StructField("checked", T.BooleanType()),
    T.StructField("indeterminate", T.BooleanType()),
])

ELEMENT, TEXT, COMMENT, DOCUMENT, DOCTYPE, FRAGMENT = 1, 3, 8, 9, 10, 11
KINDS = {"element": ELEMENT, "text": TEXT, "comment": COMMENT, "document": DOCUMENT, "document_type": DOCTYPE, "document_fragment": FRAGMENT, "shadow_root": FRAGMENT}

HTML = "http://www.w3.org/1999/xhtml"
SVG = "http://www.w3.org/2000/svg"
MATHML = "http://www.w3.org/1998/Math/MathML"
#: Namespaces of attribute prefixes.
ATTRIBUTE_NAMESPACES = {
    "xlink": "http://www.w3.org/1999/xlink",
    "xml": "http://www.w3.org/XML/1998/namespace",
    "xmlns": "http://www.w3.org/2000/xmlns/",
}

#: What a step of a selector needs to know of a node to relate it to others.
KEYS = ("doc_id", "node_id", "root_id", "parent_id", "pre", "last", "depth", "elem_idx")
