"""HTML text to node rows: a DataFrame source and SQL table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..schema import HTML, KINDS, NODES
from ..session import merged
from . import entities, tokenizer, tree_builder
from .tree_builder import Node

_ATTR = pa.struct([("ord", pa.int32()), ("prefix", pa.string()), ("local", pa.string()), ("url", pa.string()), ("qname", pa.string()), ("value", pa.string())])
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()),
}
ARROW = pa.schema([
    (f.name, pa.list_(_ATTR) if f.name == "attr_list" else _TYPES[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in NODES
])
#: Node rows of a batch.
_ROWS = 8192


#: The first columns of a node row say where a node is, the others what it is.
PLACE = 14


def places(doc_id: int | None, root: Node, first: int = 0, ids: dict[Node, int] | None = None) -> tuple[list[tuple[Node, list]], dict[Node, int]]:
    """The nodes of a tree in order with the columns of their places, and content roots by template.

    Trees of template contents follow the tree that refers to them.  ``ids`` names
    nodes that keep their identity, else a node's id is its place.
    """
    out: list[tuple[Node, list]] = []
    contents: dict[Node, int] = {}
    waiting = [(root, None)]
    number = first
    for tree, owner in waiting:
        root_id = number if ids is None else ids[tree]
        if owner is not None:
            contents[owner] = root_id
        stack: list = [(tree, None, None, 0, 0, None, None, None, None)]
        while stack:
            item = stack.pop()
            if len(item) == 1:
                item[0][6] = number - 1
                continue
            n, parent_id, parent_type, depth, sib, k, total, t, same = item
            own = number if ids is None else ids[n]
            row = [doc_id, own, root_id, parent_id, parent_type, number, number, depth, sib, k, total, t, same, 0]
            out.append((n, row))
            if n.content is not None:
                waiting.append((n.content, n))
            number += 1
            children = n.children
            if children:
                stack.append((row,))
                totals: dict[tuple, int] = {}
                count = texts = 0
                for c in children:
                    if c.kind == "element":
                        count += 1
                        totals[c.name, c.ns] = totals.get((c.name, c.ns), 0) + 1
                    elif c.kind == "text":
                        texts += 1
                row[13] = count + texts
                node_type, seen, k, below = KINDS[n.kind], {}, 0, []
                for i, c in enumerate(children):
                    if c.kind == "element":
                        k += 1
                        key = c.name, c.ns
                        seen[key] = t = seen.get(key, 0) + 1
                        below.append((c, own, node_type, depth + 1, i, k, count, t, totals[key]))
                    else:
                        below.append((c, own, node_type, depth + 1, i, None, None, None, None))
                below.reverse()
                stack += below
    return out, contents


def payload(n: Node, content_id: int | None = None, extra: dict | None = None) -> tuple:
    """The columns of a node row behind its place; attrs holds pairs and attr_list the node's own tuples."""
    more = extra or {}
    rest = (n.value, n.public_id, n.system_id, content_id, *(more.get(c) for c in EXTRA))
    if n.kind != "element":
        return (n.kind, KINDS[n.kind], n.name, n.ns, None, None, None, None, *rest)
    by_name = {a[3]: a[4] for a in n.attrs}
    tokens = list(dict.fromkeys(by_name["class"].split())) if "class" in by_name else []
    return ("element", 1, n.name, n.ns, by_name.get("id"), tokens, list(by_name.items()), n.attrs, *rest)


#: The last columns, which a parse leaves null.
EXTRA = tuple(ARROW.names[-6:])


def node_rows(doc_id: int | None, root: Node, first: int = 0) -> list[tuple]:
    """Rows in the order of ARROW of a parsed tree; ``columns`` makes Arrow of them."""
    placed, contents = places(doc_id, root, first)
    return [(*row, *payload(n, contents.get(n))) for n, row in placed]


def _offsets(lists) -> tuple[pa.Array, list]:
    """Arrow offsets of nullable lists, and their items in one list."""
    at, flat = [], []
    for x in lists:
        at.append(None if x is None else len(flat))
        if x:
            flat.extend(x)
    return pa.array([*at, len(flat)], pa.int32()), flat


def _map(lists) -> pa.Array:
    offsets, flat = _offsets(lists)
    return pa.MapArray.from_arrays(offsets, pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string()))


def _attr_lists(lists) -> pa.Array:
    offsets, flat = _offsets(lists)
    order = [i for x in lists if x for i in range(len(x))]
    columns = [order, *(zip(*flat) if flat else [[]] * 5)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ATTR)], fields=list(_ATTR)))


def columns(rows: list[tuple], fields: list[pa.Field] | None = None) -> list[pa.Array]:
    """Arrow columns of node rows (or their part ``fields``); nested ones from flat lists, not value by value."""
    made = {"attrs": _map, "attr_list": _attr_lists}
    fields = list(ARROW) if fields is None else fields
    return [made[f.name](c) if f.name in made else pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns(rows), schema=ARROW)


def parse_pages(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """The node table of a table of HTML texts: a row in, its nodes out, no shuffle.

    A null text has no nodes.  Rows of a page come in tree order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["html"]):
                if text.is_valid:
                    rows += node_rows(key, tree_builder.parse(text.as_py()))
                    if len(rows) >= _ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(run, NODES)


def parse_distinct(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(nodes, members): every distinct text is parsed once, as the document of the smallest id that has it.

    ``members`` (doc_id, parsed_id) names the parsed document of each row, so what is
    found in a tree is joined back to all its copies.  Texts are told apart by SHA-256.
    Ids must be unique; rows with a null text or a null id have no nodes and no members.
    """
    rows = pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html")).filter("doc_id is not null and html is not null")
    keyed = rows.select("doc_id", F.unhex(F.sha2("html", 256)).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("parsed_id"))
    members = keyed.join(merged(first), "digest").select("doc_id", "parsed_id")
    texts = rows.join(merged(first.select(F.col("parsed_id").alias("doc_id"))), "doc_id", "left_semi")
    # Parsing costs far more than its bytes suggest, so the partitions are not merged by size.
    texts = texts.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return parse_pages(texts, "doc_id", "html"), members


def parse_fragments(rows: DataFrame, context: str = "div", doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """The node table of HTML fragments; each is the content of a document fragment at node 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["html"]):
                if text.is_valid:
                    root = Node("document_fragment")
                    for n in tree_builder.parse_fragment(text.as_py(), context):
                        root.append(n)
                    out += node_rows(key, root)
            if out:
                yield _batch(out)

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(run, NODES)


def to_tree(rows: list[dict]) -> Node:
    """The tree of one root's rows (dicts with parent_id, pre and the node's own columns)."""
    nodes: dict[int, Node] = {}
    root = None
    for r in sorted(rows, key=lambda r: r["pre"]):
        n = Node(r["kind"], r["local_name"], r["namespace"], [(a["prefix"], a["local"], a["url"], a["qname"], a["value"]) for a in r["attr_list"] or ()], r["value"])
        nodes[r["node_id"]] = n
        if r["parent_id"] in nodes:
            nodes[r["parent_id"]].append(n)
        elif root is None:
            root = n
    return root


TOKENS = "ord int, kind string, name string, attrs array<struct<name: string, value: string>>, self_closing boolean, data string, public_id string, system_id string"


def token_rows(tokens) -> Iterator[tuple]:
    for i, t in enumerate(tokens):
        kind = type(t).__name__
        yield (
            i, kind, getattr(t, "name", None),
            [{"name": k, "value": v} for k, v in t.attrs] if isinstance(t, tokenizer.StartTag) else None,
            t.self_closing if isinstance(t, tokenizer.StartTag) else None, getattr(t, "data", None),
            getattr(t, "public_id", None), getattr(t, "system_id", None),
        )


@udtf(returnType=TOKENS)
class HtmlTokens:
    """html_tokens(html): the tokens of a text, references decoded."""

    def eval(self, html: str):
        if html is not None:
            yield from token_rows(tokenizer.tokenize(html))


@udtf(returnType=TOKENS)
class HtmlFragmentTokens:
    """html_fragment_tokens(html, name): the tokens of the content of an element."""

    def eval(self, html: str, name: str):
        if html is not None:
            yield from token_rows(tokenizer.fragment_tokens(html, name))


_NODE_COLUMNS = "node_id long, parent_id long, pre long, last long, depth int, kind string, local_name string, namespace string, attrs map<string, string>, value string"


def _narrow(rows: list[tuple]) -> Iterator[tuple]:
    at = [ARROW.names.index(c) for c in ("node_id", "parent_id", "pre", "last", "depth", "kind", "local_name", "namespace", "attrs", "value")]
    for r in rows:
        out = [r[i] for i in at]
        out[8] = dict(out[8]) if out[8] is not None else None
        yield tuple(out)


@udtf(returnType=_NODE_COLUMNS)
class ParseHtml:
    """parse_html(html): the nodes of a document."""

    def eval(self, html: str):
        if html is not None:
            yield from _narrow(node_rows(0, tree_builder.parse(html)))


@udtf(returnType=_NODE_COLUMNS)
class ParseFragment:
    """parse_fragment(html, context): the nodes of a fragment, under a document fragment."""

    def eval(self, html: str, context: str):
        if html is not None:
            root = Node("document_fragment")
            for n in tree_builder.parse_fragment(html, context):
                root.append(n)
            yield from _narrow(node_rows(0, root)[1:])


def register(spark: SparkSession) -> None:
    """Make the table functions and ``html_unescape`` known to SQL."""
    spark.udtf.register("html_tokens", HtmlTokens)
    spark.udtf.register("html_fragment_tokens", HtmlFragmentTokens)
    spark.udtf.register("parse_html", ParseHtml)
    spark.udtf.register("parse_fragment", ParseFragment)
    spark.udf.register("html_unescape", unescape)


@F.pandas_udf(T.StringType())
def unescape(text):
    """Character references decoded, as in text."""
    return text.map(lambda t: None if t is None else entities.unescape(t))


def normalize_newlines(html):
    """CRLF and CR to LF, as a column expression."""
    return F.regexp_replace(html, "\r\n?", "\n")


def element_names(nodes: DataFrame) -> DataFrame:
    """How often each element name occurs, over the corpus."""
    return nodes.filter((F.col("node_type") == 1) & (F.col("namespace") == HTML)).groupBy("local_name").agg(F.count("*").alias("n"))
