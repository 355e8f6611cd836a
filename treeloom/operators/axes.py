"""Axes, collections and sibling navigation over a node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ELEMENT
from .intervals import nearest_ancestor, semi, within

_SAME = [("doc_id", "doc_id"), ("node_id", "node_id")]


def rows_of(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``nodes`` named by ``keys`` (doc_id, node_id)."""
    return semi(nodes, keys, _SAME)


def parent(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    return semi(nodes, rows_of(nodes, keys), [("doc_id", "doc_id"), ("node_id", "parent_id")])


def children(nodes: DataFrame, keys: DataFrame, *, elements: bool = False) -> DataFrame:
    """Children in order of pre (at the sink), all or elements only."""
    found = semi(nodes, keys, [("doc_id", "doc_id"), ("parent_id", "node_id")])
    return found.filter(F.col("node_type") == ELEMENT) if elements else found


def descendants(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    return within(nodes, rows_of(nodes, keys).select("doc_id", "root_id", "pre", "last"))


def ancestors(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor_id, distance), nearest first by distance."""
    own = rows_of(nodes, keys).select("doc_id", "root_id", "node_id", "pre", "depth")
    met = _upwards(nodes, own.filter("depth > 0"), F.col("depth") - 1)
    return met.select("doc_id", "node_id", F.col("_up.node_id").alias("ancestor_id"), (F.col("depth") - F.col("_up.depth")).alias("distance"))


def _upwards(nodes: DataFrame, rows: DataFrame, deepest: Column) -> DataFrame:
    """``rows`` (with doc_id, root_id, pre) with _up (node_id, depth, last): the nodes above their place, one for each depth up to ``deepest``.

    In tree order the node above a place at some depth is the last one of that depth.
    """
    levels = rows.select("doc_id", "root_id", F.explode(F.sequence(F.lit(0), deepest.cast("int"))).alias("_level"), F.col("pre").alias("_at"), F.struct(*rows.columns).alias("_row"))
    up = F.struct("node_id", "depth", "last").alias("_up")
    marks = nodes.select("doc_id", "root_id", F.col("depth").alias("_level"), F.col("pre").alias("_at"), up)
    order = Window.partitionBy("doc_id", "root_id", "_level").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(levels, allowMissingColumns=True)
    return both.withColumn("_up", F.last("_up", ignorenulls=True).over(order)).filter("_row is not null").select("_row.*", "_up")


def by_tag_name(nodes: DataFrame, name: str, scope: DataFrame | None = None) -> DataFrame:
    found = nodes.filter((F.col("node_type") == ELEMENT) & (F.lit(name == "*") | (F.col("local_name") == name)))
    return found if scope is None else within(found, rows_of(nodes, scope).select("doc_id", "root_id", "pre", "last"))


def by_class_names(nodes: DataFrame, names: str, scope: DataFrame | None = None) -> DataFrame:
    """Elements with all of the space-separated names; without a name none."""
    wanted = names.split()
    test = F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col("class_tokens"))) == 0 if wanted else F.lit(False)
    found = nodes.filter((F.col("node_type") == ELEMENT) & test)
    return found if scope is None else within(found, rows_of(nodes, scope).select("doc_id", "root_id", "pre", "last"))


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter((F.col("node_type") == ELEMENT) & (F.try_element_at("attrs", F.lit("name")) == name))


def by_id(nodes: DataFrame, value: str, scope: DataFrame | None = None) -> DataFrame:
    """The first element with an id in each document (or scope's tree)."""
    found = nodes.filter(F.col("id") == value)
    if scope is not None:
        found = within(found, rows_of(nodes, scope).select("doc_id", "root_id", "pre", "last"))
    first = found.groupBy("doc_id").agg(F.min_by("node_id", "pre").alias("node_id"))
    return rows_of(found, first)


def contains(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, node_id, other_id) with ``contains``: whether node holds other, itself included."""
    a, b = _two(nodes, pairs)
    return a.select(*pairs.columns, F.coalesce((F.col("_b_root") == F.col("_a_root")) & F.col("_b_pre").between(F.col("_a_pre"), F.col("_a_last")), F.lit(False)).alias("contains"))


_PLACES = (("root_id", "root"), ("pre", "pre"), ("last", "last"), ("depth", "depth"))


def _two(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, None]:
    one = nodes.select("doc_id", "node_id", *[F.col(c).alias(f"_a_{n}") for c, n in _PLACES])
    two = nodes.select("doc_id", F.col("node_id").alias("other_id"), *[F.col(c).alias(f"_b_{n}") for c, n in _PLACES])
    return pairs.join(one, ["doc_id", "node_id"], "left").join(two, ["doc_id", "other_id"], "left"), None


def compare_position(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, node_id, other_id) with ``position``: 0 same, 20 contained by, 10 contains, 4 following, 2 preceding, 35 in another tree."""
    joined, _ = _two(nodes, pairs)
    a_pre, a_last, b_pre, b_last = map(F.col, ("_a_pre", "_a_last", "_b_pre", "_b_last"))
    position = (
        F.when(F.col("_a_root") != F.col("_b_root"), 35).when(a_pre == b_pre, 0)
        .when((b_pre > a_pre) & (b_pre <= a_last), 20).when((a_pre > b_pre) & (a_pre <= b_last), 10)
        .when(b_pre > a_pre, 4).otherwise(2)
    )
    return joined.select(*pairs.columns, position.alias("position"))


def common_ancestor(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``ancestor_id``: the deepest node that holds both."""
    joined, _ = _two(nodes, pairs)
    # The deepest of the first node's ancestors, itself included, that still holds the second.
    first = joined.filter(F.col("_a_root") == F.col("_b_root")).select(
        "doc_id", "node_id", "other_id", F.col("_a_root").alias("root_id"), F.least("_a_pre", "_b_pre").alias("pre"), F.greatest("_a_pre", "_b_pre").alias("_end"),
        F.when(F.col("_a_pre") <= F.col("_b_pre"), F.col("_a_depth")).otherwise(F.col("_b_depth")).alias("_depth"))
    met = _upwards(nodes, first, F.col("_depth")).filter(F.col("_up.last") >= F.col("_end"))
    return met.groupBy("doc_id", "node_id", "other_id").agg(F.max_by(F.col("_up.node_id"), F.col("_up.depth")).alias("ancestor_id"))


def siblings(nodes: DataFrame, *, elements: bool = False) -> DataFrame:
    """(doc_id, node_id, previous_id, next_id) among all siblings, or among elements."""
    rows = nodes.filter(F.col("node_type") == ELEMENT) if elements else nodes
    order = Window.partitionBy("doc_id", "parent_id").orderBy("pre")
    near = lambda f: F.when(F.col("parent_id").isNotNull(), f("node_id").over(order))
    return rows.select("doc_id", "node_id", near(F.lag).alias("previous_id"), near(F.lead).alias("next_id"))


def first_and_last(nodes: DataFrame, *, elements: bool = False) -> DataFrame:
    """(doc_id, node_id, first_id, last_id) of the children of each node that has some."""
    rows = nodes.filter(F.col("node_type") == ELEMENT) if elements else nodes
    return rows.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        F.min_by("node_id", "pre").alias("first_id"), F.max_by("node_id", "pre").alias("last_id"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, child_element_count, has_child_nodes) of every node."""
    counts = nodes.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("node_type") == ELEMENT).alias("n"))
    return nodes.select("doc_id", "node_id").join(counts, ["doc_id", "node_id"], "left").select(
        "doc_id", "node_id", F.coalesce("n", F.lit(0).cast("long")).alias("child_element_count"), F.col("n").isNotNull().alias("has_child_nodes"))


def document_element(nodes: DataFrame) -> DataFrame:
    """The first element child of each document."""
    top = nodes.filter((F.col("node_type") == ELEMENT) & (F.col("parent_type") == 9))
    return rows_of(nodes, top.groupBy("doc_id").agg(F.min_by("node_id", "pre").alias("node_id")))


def head_or_body(nodes: DataFrame, name: str) -> DataFrame:
    """The first ``name`` child of each document element."""
    found = children(nodes, document_element(nodes).select("doc_id", "node_id"), elements=True).filter(F.col("local_name") == name)
    return rows_of(nodes, found.groupBy("doc_id").agg(F.min_by("node_id", "pre").alias("node_id")))


def root_node(nodes: DataFrame, *, composed: bool = False) -> DataFrame:
    """(doc_id, node_id, root_id, is_connected); composed roots cross from shadow trees to their hosts.

    The loop is over levels of shadow trees, until none is left to cross; the edges
    are shadow roots only.
    """
    doc_roots = nodes.filter(F.col("kind") == "document").select(F.col("doc_id"), F.col("node_id").alias("root_id"))
    roots = nodes.select("doc_id", "node_id", "root_id")
    hosts = nodes.filter(F.col("kind") == "shadow_root").select("doc_id", F.col("node_id").alias("_shadow"), F.col("host_id").alias("_host"))
    host_root = hosts.join(nodes.select("doc_id", F.col("node_id").alias("_host"), F.col("root_id").alias("_up")), ["doc_id", "_host"]).select("doc_id", F.col("_shadow"), "_up")
    top = roots.withColumn("_top", F.col("root_id"))
    while not top.join(host_root, (top["doc_id"] == host_root["doc_id"]) & (F.col("_top") == F.col("_shadow")), "left_semi").isEmpty():
        up = host_root.withColumnRenamed("doc_id", "_d")
        top = top.join(up, (F.col("doc_id") == F.col("_d")) & (F.col("_top") == F.col("_shadow")), "left").select("doc_id", "node_id", "root_id", F.coalesce("_up", "_top").alias("_top"))
    out = top.join(doc_roots.select(F.col("doc_id").alias("_d"), F.col("root_id").alias("_doc")), (F.col("doc_id") == F.col("_d")) & (F.col("_top") == F.col("_doc")), "left")
    return out.select("doc_id", "node_id", F.col("_top").alias("root_id") if composed else F.col("root_id"), F.col("_doc").isNotNull().alias("is_connected"))


def owner_document(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, owner): the document's key, null for the document itself."""
    return nodes.select("doc_id", "node_id", F.when(F.col("kind") != "document", F.col("doc_id")).alias("owner"))


def template_content(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The content fragments of templates."""
    return semi(nodes, rows_of(nodes, keys).filter("content_root_id is not null"), [("doc_id", "doc_id"), ("node_id", "content_root_id")])


def attributes(nodes: DataFrame) -> DataFrame:
    """A row per attribute: doc_id, node_id, ord, prefix, local, url, qname, value."""
    return nodes.select("doc_id", "node_id", F.explode("attr_list").alias("a")).select("doc_id", "node_id", "a.*")


def memberships(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, kind, name): tag, id, class tokens and attributes of each element, once."""
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    lists = F.concat(
        F.array(entry("tag", F.col("local_name"))),
        F.when(F.col("id").isNotNull(), F.array(entry("id", F.col("id")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
        F.transform("class_tokens", lambda t: entry("class", t)),
        F.transform(F.map_keys("attrs"), lambda t: entry("attr", t)),
    )
    return nodes.filter(F.col("node_type") == ELEMENT).select("doc_id", "node_id", F.explode(F.array_distinct(lists)).alias("m")).select("doc_id", "node_id", "m.*")


def inherited_attribute(nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, node_id, value) of the nearest element, itself included, with the attribute."""
    elements = nodes.filter(F.col("node_type") == ELEMENT)
    carriers = elements.withColumn("_v", F.try_element_at("attrs", F.lit(name))).filter("_v is not null")
    return nearest_ancestor(elements, carriers, "_v", "value_").select("doc_id", "node_id", F.col("value_").alias("value"))
