"""Edits of documents.

A batch of edits is a table (doc_id, seq, op, target_id, parent_id, reference_id,
name, value).  Edits of one document depend on each other, so they are applied in
order, document after document in a stream of sorted rows; documents without edits
never leave the JVM, and columns that no edit changes are never turned into Python
values.  A task holds one batch of whole documents, or one document if it is larger.
node_ids survive, the numbering is made anew.  Removals of many subtrees and
changes of attributes that need no order are plain DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ATTRIBUTE_NAMESPACES, NODES
from ..sources import tree_builder
from ..sources.html import ARROW, EXTRA, PLACE, columns, payload, places
from ..sources.tree_builder import Node
from .axes import rows_of
from .intervals import semi, within

EDITS = "doc_id long, seq long, op string, target_id long, parent_id long, reference_id long, name string, value string"
MUTATION = "seq long, type string, target_id long, attribute_name string, old_value string, added array<long>, removed array<long>, prev_id long, next_id long"
#: Elements that may host a shadow tree, besides custom ones.
SHADOW_HOSTS = frozenset("article aside blockquote body div footer h1 h2 h3 h4 h5 h6 header main nav p section span".split())


class EditError(ValueError):
    """An edit that the document does not allow; kind is the name of the error."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(f"{kind}: {text}" if text else kind)
        self.kind = kind


class Stored(Node):
    """A node of the table; its attributes are read when they are asked for."""

    __slots__ = ("row", "_attrs", "_lists")

    def __init__(self, kind: str, name: str | None, ns: str | None, value: str | None, row: int, lists: pa.Array):
        self.kind, self.name, self.ns, self.value, self.row = kind, name, ns, value, row
        self.children, self.parent, self.content = [], None, None
        self.public_id = self.system_id = None
        self._attrs, self._lists = None, lists

    @property
    def attrs(self) -> list[tuple]:
        if self._attrs is None:
            self._attrs = [(a["prefix"], a["local"], a["url"], a["qname"], a["value"]) for a in self._lists[self.row].as_py() or ()]
        return self._attrs


#: The columns of every node that Python sees; the others are carried along as Arrow.
_SEEN = ("node_id", "parent_id", "kind", "local_name", "namespace", "value", "public_id", "system_id", "content_root_id", *EXTRA)


class Document:
    """The trees of one document, open for edits: the rows ``start`` to ``end`` of a table, in order of pre."""

    def __init__(self, doc_id: int | None, seen: dict[str, list], lists: pa.Array, start: int, end: int):
        self.doc_id = doc_id
        self.nodes: dict[int, Node] = {}
        self.ids: dict[Node, int] = {}
        self.extra: dict[Node, dict] = {}
        self.changed: set[Node] = set()  # stored nodes whose own columns are no longer the table's
        self.roots: list[Node] = []
        self.mutations: list[tuple] = []
        self.seq = 0
        self.top = -1
        contents = {}
        if end > start:
            self.top = max(seen["node_id"][start:end])
        node_ids, parents, kinds, names, spaces, values, publics, systems, content_ids = (seen[c] for c in _SEEN[:9])
        kept = [(c, seen[c]) for c in EXTRA if c in seen]
        for i in range(start, end):
            n = Stored(kinds[i], names[i], spaces[i], values[i], i, lists)
            if n.kind == "document_type":
                n.public_id, n.system_id = publics[i], systems[i]
            node_id, parent_id = node_ids[i], parents[i]
            self.nodes[node_id], self.ids[n] = n, node_id
            if kept and (more := {c: v[i] for c, v in kept if v[i] is not None}):
                self.extra[n] = more
            if content_ids[i] is not None:
                contents[content_ids[i]] = n
            if parent_id is not None:
                n.parent = self.nodes[parent_id]
                n.parent.children.append(n)
            elif node_id in contents:
                contents[node_id].content = n
            else:
                self.roots.append(n)

    def _own(self, n: Node) -> Node:
        node_id = self.top = self.top + 1
        self.nodes[node_id], self.ids[n] = n, node_id
        return n

    def adopt_tree(self, n: Node) -> Node:
        for m in n.walk():
            self._own(m)
            if m.content is not None:
                self.adopt_tree(m.content)
        return n

    def node(self, node_id: int | None) -> Node:
        if node_id not in self.nodes:
            raise EditError("not found", str(node_id))
        return self.nodes[node_id]

    def record(self, type_: str, target: Node, name=None, old=None, added=(), removed=(), prev=None, following=None) -> None:
        i = lambda n: None if n is None else self.ids[n]
        self.mutations.append((self.seq, type_, i(target), name, old, [i(n) for n in added], [i(n) for n in removed], i(prev), i(following)))

    # -- structure

    def check(self, parent: Node, child: Node, before: Node | None, replacing: Node | None = None) -> None:
        if parent.kind not in ("document", "element", "document_fragment", "shadow_root") or child.kind in ("document", "shadow_root"):
            raise EditError("hierarchy request")
        p: Node | None = parent
        while p is not None:
            if p is child:
                raise EditError("hierarchy request", "cycle")
            p = p.parent or next((m for m in self.nodes.values() if m.content is p), None) if p.kind == "document_fragment" else p.parent
        if before is not None and before.parent is not parent:
            raise EditError("not found", "reference")
        if child.kind == "document_type" and parent.kind != "document":
            raise EditError("hierarchy request")
        if parent.kind == "document":
            new = child.children if child.kind == "document_fragment" else [child]
            rest = [c for c in parent.children if c is not child and c is not replacing]
            count = lambda k, ns: sum(c.kind == k for c in ns)
            if count("text", new) or count("element", new) + count("element", rest) > 1 or count("document_type", new) + count("document_type", rest) > 1:
                raise EditError("hierarchy request")
            if count("document_type", new) and any(c.kind == "element" for c in (parent.children[: parent.children.index(before)] if before else rest)):
                raise EditError("hierarchy request", "doctype after element")
            if count("element", new) and before is not None and any(c.kind == "document_type" for c in parent.children[parent.children.index(before) :] if c is not replacing):
                raise EditError("hierarchy request", "element before doctype")

    def detach(self, n: Node, log: bool = True) -> None:
        parent = n.parent
        if parent is not None:
            at = parent.children.index(n)
            prev = parent.children[at - 1] if at else None
            following = parent.children[at + 1] if at + 1 < len(parent.children) else None
            n.remove()
            if log:
                self.record("child_list", parent, removed=[n], prev=prev, following=following)
            self.roots.append(n)

    def insert(self, parent: Node, child: Node, before: Node | None = None) -> None:
        self.check(parent, child, before)
        if before is child:
            at = parent.children.index(child)
            before = parent.children[at + 1] if at + 1 < len(parent.children) else None
        new = list(child.children) if child.kind == "document_fragment" else [child]
        for n in new:
            if child.kind == "document_fragment":
                n.remove()
            else:
                self.detach(n)
                self.roots.remove(n)
        if not new:
            return
        at = len(parent.children) if before is None else parent.children.index(before)
        prev = parent.children[at - 1] if at else None
        for n in new:
            parent.append(n, before)
        self.record("child_list", parent, added=new, prev=prev, following=before)

    def replace(self, parent: Node, new: Node, old: Node) -> None:
        if old.parent is not parent:
            raise EditError("not found", "child")
        self.check(parent, new, old, replacing=old)
        at = parent.children.index(old)
        following = parent.children[at + 1] if at + 1 < len(parent.children) else None
        if following is new:
            k = parent.children.index(new)
            following = parent.children[k + 1] if k + 1 < len(parent.children) else None
        if old is not new:
            self.detach(old)
        self.insert(parent, new, following)

    def replace_all(self, parent: Node, new: list[Node]) -> None:
        gone = list(parent.children)
        for n in gone:
            n.remove()
            self.roots.append(n)
        for n in new:
            parent.append(n)
        if gone or new:
            self.record("child_list", parent, added=new, removed=gone)

    def fragment(self, html: str, context: Node) -> list[Node]:
        prefix = {"http://www.w3.org/2000/svg": "svg ", "http://www.w3.org/1998/Math/MathML": "math "}.get(context.ns, "")
        return [self.adopt_tree(n) for n in tree_builder.parse_fragment(html, prefix + (context.name or "div"))]

    def create(self, kind: str, name=None, value=None, ns=None) -> Node:
        n = self._own(Node(kind, name, ns, (), value))
        if kind == "element" and name == "template":
            n.content = self._own(Node("document_fragment"))
        self.roots.append(n)
        return n

    def clone(self, n: Node, deep: bool) -> Node:
        if deep:
            copy = self.adopt_tree(n.clone())
        else:
            copy = self._own(Node(n.kind, n.name, n.ns, n.attrs, n.value))
            if n.content is not None:
                copy.content = self._own(Node("document_fragment"))
        self.roots.append(copy)
        return copy

    # -- attributes and data

    def set_attribute(self, n: Node, qname: str, value: str | None, url: str | None = None, has_ns: bool = False) -> None:
        if n.kind != "element":
            raise EditError("hierarchy request", "no element")
        prefix, _, local = qname.rpartition(":") if has_ns else ("", "", qname)
        same = (lambda a: (a[2], a[1]) == (url, local)) if has_ns else (lambda a: a[3] == qname)
        at = next((i for i, a in enumerate(n.attrs) if same(a)), None)
        old = None if at is None else n.attrs[at][4]
        self.changed.add(n)
        if value is None:
            if at is None:
                return
            del n.attrs[at]
        elif at is None:
            n.attrs.append((prefix or None, local, url, qname, value))
        else:
            n.attrs[at] = (*n.attrs[at][:4], value)
        if not has_ns or url is None:
            self.record("attributes", n, name=qname, old=old)

    def set_data(self, n: Node, value: str) -> None:
        if n.kind not in ("text", "comment"):
            raise EditError("hierarchy request", "no character data")
        old, n.value = n.value, value
        self.changed.add(n)
        self.record("character_data", n, old=old)

    def normalize(self, n: Node) -> None:
        for m in list(n.walk()):
            i = 0
            while i < len(m.children):
                c = m.children[i]
                if c.kind != "text":
                    i += 1
                elif c.value == "":
                    self.detach(c)
                else:
                    while i + 1 < len(m.children) and m.children[i + 1].kind == "text":
                        more = m.children[i + 1]
                        if more.value:
                            self.set_data(c, c.value + more.value)
                        self.detach(more)
                    i += 1

    def split(self, n: Node, at: int) -> Node:
        """Cut a text; the new one with what is behind ``at`` follows it."""
        if n.kind != "text" or at > len(n.value):
            raise EditError("index size")
        rest = self.create("text", value=n.value[at:])
        if n.parent is not None:
            k = n.parent.children.index(n) + 1
            self.insert(n.parent, rest, n.parent.children[k] if k < len(n.parent.children) else None)
        self.set_data(n, n.value[:at])
        return rest

    def surround(self, start: Node, a: int, end: Node, b: int, wrapper: Node) -> None:
        """Put what lies between two boundary points into an element, which loses its own children."""
        holder = start.parent if start.kind == "text" else start
        if holder is None or holder is not (end.parent if end.kind == "text" else end):
            raise EditError("invalid state", "an element is cut")
        if wrapper.kind != "element":
            raise EditError("hierarchy request")
        self.check(holder, wrapper, None)
        for n, at in ((start, a), (end, b)):
            if at > (len(n.value) if n.kind == "text" else len(n.children)):
                raise EditError("index size")
        if end.kind == "text":
            self.split(end, b)
        if start.kind == "text":
            rest = self.split(start, a)
            end = rest if end is start else end
        first = holder.children.index(start) + 1 if start.kind == "text" else a
        behind = holder.children.index(end) + 1 if end.kind == "text" else b
        if start.kind == "text" and end.kind != "text":
            behind += 1  # the cut of the start put one more child before it
        inside = holder.children[first:behind]
        self.replace_all(wrapper, [])
        self.insert(holder, wrapper, holder.children[first] if first < len(holder.children) else None)
        for n in inside:
            self.insert(wrapper, n)

    # -- one edit

    def apply(self, e: dict) -> None:
        self.seq = e["seq"]
        op, name, value = e["op"], e["name"], e["value"]
        target = self.node(e["target_id"]) if e["target_id"] is not None else None
        parent = self.node(e["parent_id"]) if e["parent_id"] is not None else None
        before = self.node(e["reference_id"]) if e["reference_id"] is not None else None
        if op == "create_element":
            self.create("element", name.lower(), ns=tree_builder.HTML)
        elif op == "create_element_ns":
            self.create("element", name.rpartition(":")[2], ns=value)
        elif op == "create_text":
            self.create("text", value=value)
        elif op == "create_comment":
            self.create("comment", value=value)
        elif op == "create_fragment":
            self.create("document_fragment")
        elif op == "create_doctype":
            self.create("document_type", name)
        elif op == "append_child":
            self.insert(parent, target)
        elif op == "insert_before":
            self.insert(parent, target, before)
        elif op in ("remove_child", "remove"):
            if parent is not None and target.parent is not parent:
                raise EditError("not found", "child")
            self.detach(target)
        elif op == "replace_child":
            self.replace(parent, target, before)
        elif op in ("append", "prepend", "before", "after", "replace_with"):
            new = self.create("text", value=value) if before is None else before
            up = target.parent
            if op == "append":
                self.insert(target, new)
            elif op == "prepend":
                self.insert(target, new, target.children[0] if target.children else None)
            elif up is None:
                return
            elif op == "before":
                self.insert(up, new, target)
            elif op == "after":
                at = up.children.index(target) + 1
                self.insert(up, new, up.children[at] if at < len(up.children) else None)
            else:
                self.replace(up, new, target)
        elif op == "set_attribute":
            self.set_attribute(target, name.lower() if target.ns == tree_builder.HTML else name, value or "")
        elif op == "remove_attribute":
            self.set_attribute(target, name, None)
        elif op == "toggle_attribute":
            self.set_attribute(target, name, None if target.get(name) is not None else "")
        elif op == "set_attribute_ns":
            url = ATTRIBUTE_NAMESPACES.get(name.rpartition(":")[0])
            self.set_attribute(target, name, value or "", url, True)
        elif op == "set_text_content":
            if target.kind in ("text", "comment"):
                self.set_data(target, value or "")
            elif target.kind not in ("document", "document_type"):
                new = [self._own(Node("text", value=value))] if value else []
                self.replace_all(target, new)
        elif op == "set_inner_html":
            holder = target.content if target.content is not None else target
            self.replace_all(holder, self.fragment(value or "", target))
        elif op == "set_outer_html":
            if target.parent is None:
                raise EditError("no modification allowed")
            piece = self.create("document_fragment")
            for n in self.fragment(value or "", target.parent):
                piece.append(n)
            self.replace(target.parent, piece, target)
        elif op in ("insert_adjacent_html", "insert_adjacent_text"):
            where = (name or "").lower()
            inside = where in ("afterbegin", "beforeend")
            if where not in ("beforebegin", "afterbegin", "beforeend", "afterend"):
                raise EditError("syntax", name or "")
            holder = target if inside else target.parent
            if holder is None:
                raise EditError("no modification allowed")
            piece = self.create("document_fragment")
            for n in [self._own(Node("text", value=value or ""))] if op.endswith("text") else self.fragment(value or "", holder):
                piece.append(n)
            at = {"beforebegin": target, "afterbegin": target.children[0] if target.children else None}.get(where)
            if where == "afterend":
                k = holder.children.index(target) + 1
                at = holder.children[k] if k < len(holder.children) else None
            self.insert(holder, piece, at)
        elif op == "clone_node":
            self.clone(target, value == "deep")
        elif op == "normalize":
            self.normalize(target)
        elif op == "split_text":
            self.split(target, int(value))
        elif op == "surround_contents":
            a, b = map(int, name.split(","))
            self.surround(target, a, before, b, parent)
        elif op == "replace_data":
            offset, count = map(int, name.split(","))
            if target.kind not in ("text", "comment") or offset > len(target.value):
                raise EditError("index size")
            self.set_data(target, target.value[:offset] + (value or "") + target.value[offset + count :])
        elif op == "attach_shadow":
            if target.kind != "element" or not (target.name in SHADOW_HOSTS or "-" in target.name) or self.extra.get(target, {}).get("shadow_root_id") is not None:
                raise EditError("not supported")
            shadow = self.create("shadow_root")
            self.changed.add(target)
            self.extra.setdefault(target, {})["shadow_root_id"] = self.ids[shadow]
            self.extra[shadow] = {"host_id": self.ids[target], "shadow_mode": name or "open", "slot_assignment": value or "named"}
        elif op == "set_checked":
            self.changed.add(target)
            self.extra.setdefault(target, {})["checked"] = value == "true"
        elif op == "set_indeterminate":
            self.changed.add(target)
            self.extra.setdefault(target, {})["indeterminate"] = value == "true"
        else:
            raise EditError("unknown operation", op)

    def place(self) -> tuple[list[tuple[Node, list]], dict[Node, int]]:
        """All nodes in order with the columns of their places, and the content roots by template."""
        out, contents = [], {}
        for root in self.roots:
            if root.kind == "document_fragment" and not root.children and root.parent is None and self.ids[root] > 0 and root not in self.extra:
                continue  # an emptied fragment
            more, inner = places(self.doc_id, root, len(out), self.ids)
            out += more
            contents |= inner
        return out, contents


@dataclass
class Edited:
    """What a batch of edits leads to.  Each part is a plan of its own and computes no other."""

    given: DataFrame
    untouched: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.given.mapInArrow(_running("nodes"), NODES).unionByName(self.untouched)

    @property
    def mutations(self) -> DataFrame:
        """doc_id, seq, type, target_id, attribute_name, old_value, added, removed, prev_id, next_id in order."""
        return self._thin().mapInArrow(_running("mutations"), f"doc_id long, {MUTATION}")

    @property
    def errors(self) -> DataFrame:
        """doc_id, seq, error of the edits that were refused; they changed nothing."""
        return self._thin().mapInArrow(_running("errors"), "doc_id long, seq long, error string")

    def _thin(self) -> DataFrame:
        return self.given.select("doc_id", *_SEEN, "attr_list", "_edit")


_MUTATION = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("type", pa.string()), ("target_id", pa.int64()), ("attribute_name", pa.string()), ("old_value", pa.string()), ("added", pa.list_(pa.int64())), ("removed", pa.list_(pa.int64())), ("prev_id", pa.int64()), ("next_id", pa.int64())])
_ERROR = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("error", pa.string())])
_BEHIND = list(ARROW)[PLACE:]


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list]]:
    """Tables of whole documents with their doc_ids, of rows sorted by document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _values(batch["doc_id"])
        if held and ids[0] == ids[-1] == held[-1]["doc_id"][-1].as_py():
            held.append(batch)  # a document of more than a batch
            continue
        cut = batch.num_rows
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if held and (cut or ids[0] != held[-1]["doc_id"][-1].as_py()):
            held.append(batch.slice(0, cut))
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, _values(table["doc_id"])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks(), ids[:cut]
        held.append(batch.slice(cut))
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _values(table["doc_id"])


def _values(column: pa.ChunkedArray | pa.Array) -> list:
    """Python values of a column of numbers or strings."""
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_pandas(integer_object_nulls=True).tolist()


def _edited(table: pa.Table, ids: list) -> Iterator[tuple[Document, list[tuple]]]:
    """The documents of a table after their edits, and what was refused."""
    given = table["_edit"].is_valid()
    edits = [None] * table.num_rows
    for i, e in zip(given.to_numpy().nonzero()[0].tolist(), table["_edit"].filter(given).to_pylist()):
        edits[i] = e
    # The last columns concern shadow trees and form state; mostly there is nothing in them.
    seen = {c: _values(table[c]) for c in _SEEN if c not in EXTRA or table[c].null_count < table.num_rows}
    lists = table["attr_list"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    start = 0
    while start < len(ids):
        end = start
        while end < len(ids) and ids[end] == ids[start] and edits[end] is None:
            end += 1
        doc, errors = Document(ids[start], seen, lists, start, end), []
        start_of_edits = end
        while end < len(ids) and ids[end] == ids[start]:
            end += 1
        for e in edits[start_of_edits:end]:
            try:
                doc.apply(e)
            except EditError as error:
                errors.append((doc.doc_id, e["seq"], error.kind))
        yield doc, errors
        start = end


def _running(what: str):
    """The function over sorted partitions that gives nodes, mutations or errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in _whole_documents(batches):
            rows: list[tuple] = []
            at: list[int] = []  # per node the row of its own columns: of the table, or behind it of the new ones
            fresh: list[tuple] = []
            for doc, errors in _edited(table, ids):
                if what == "errors":
                    rows += errors
                elif what == "mutations":
                    rows += [(doc.doc_id, *m) for m in doc.mutations]
                else:
                    placed, contents = doc.place()
                    for n, row in placed:
                        rows.append(row)
                        if isinstance(n, Stored) and n not in doc.changed:
                            at.append(n.row)
                        else:
                            at.append(table.num_rows + len(fresh))
                            fresh.append(payload(n, contents.get(n), doc.extra.get(n)))
            if not rows:
                continue
            if what != "nodes":
                schema = _ERROR if what == "errors" else _MUTATION
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                continue
            place = [pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)]
            behind = table.select([f.name for f in _BEHIND]).cast(pa.schema(_BEHIND))
            if fresh:
                behind = pa.concat_tables([behind, pa.Table.from_arrays(columns(fresh, _BEHIND), schema=behind.schema)])
            took = behind.take(pa.array(at, pa.int64())).combine_chunks()
            out = pa.Table.from_arrays([*place, *took.columns], schema=ARROW)
            yield from out.to_batches()

    return run


def apply_edits(nodes: DataFrame, edits: DataFrame) -> Edited:
    """Apply edits in order of seq to their documents; edits of documents without nodes are refused."""
    touched = edits.select("doc_id").distinct()
    mine = semi(nodes, touched, [("doc_id", "doc_id")])
    rest = semi(nodes, touched, [("doc_id", "doc_id")], how="left_anti")
    names = [c.split()[0] for c in EDITS.split(", ")]
    own = edits.select("doc_id", F.struct(*names[1:]).alias("_edit"))
    both = mine.select(*NODES.names).unionByName(own, allowMissingColumns=True)
    order = [F.col("doc_id"), F.col("_edit").isNotNull(), F.col("pre"), F.col("_edit.seq")]
    return Edited(both.repartition("doc_id").sortWithinPartitions(*order), rest)


# -- set-wise edits


def renumber(nodes: DataFrame) -> DataFrame:
    """``nodes`` with pre, last and all ordinals made anew after rows went; order and parents stay."""
    from pyspark.sql import Window

    tree = Window.partitionBy("doc_id", "root_id")
    by_pre = tree.orderBy("pre")
    kept = nodes.withColumn("_new", F.row_number().over(by_pre) - 1 + F.min("pre").over(tree))
    # The new last of a node: its new pre and as many nodes as its old interval still holds.
    ends = kept.select("doc_id", "root_id", F.col("last").alias("at"), F.col("node_id").alias("_of"), F.lit(1).alias("side")).unionByName(
        kept.select("doc_id", "root_id", F.col("pre").alias("at"), F.lit(None).cast("long").alias("_of"), F.lit(0).alias("side")))
    upto = Window.partitionBy("doc_id", "root_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    counted = ends.withColumn("_n", F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(upto)).filter("side = 1").select("doc_id", F.col("_of").alias("node_id"), "_n")
    out = kept.join(counted, ["doc_id", "node_id"]).withColumns({"last": F.col("_n") - 1 + F.min("pre").over(tree), "pre": F.col("_new")})
    family = Window.partitionBy("doc_id", "parent_id")
    order = family.orderBy("pre")
    element = F.when(F.col("node_type") == 1, 1).otherwise(0)
    kind = Window.partitionBy("doc_id", "parent_id", "node_type", "local_name", "namespace")
    is_element, has_parent = F.col("node_type") == 1, F.col("parent_id").isNotNull()
    out = out.withColumns({
        "sib_idx": F.when(has_parent, F.row_number().over(order) - 1).otherwise(0).cast("int"),
        "elem_idx": F.when(is_element & has_parent, F.sum(element).over(order)).cast("int"),
        "elem_cnt": F.when(is_element & has_parent, F.sum(element).over(family)).cast("int"),
        "type_idx": F.when(is_element & has_parent, F.row_number().over(kind.orderBy("pre"))).cast("int"),
        "type_cnt": F.when(is_element & has_parent, F.count("*").over(kind)).cast("int"),
    })
    content = out.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("node_type").isin(1, 3)).alias("_c"))
    out = out.join(content, ["doc_id", "node_id"], "left").withColumn("content_child_cnt", F.coalesce("_c", F.lit(0)).cast("int"))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in NODES])


def remove_subtrees(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """``nodes`` without the subtrees of ``keys``, numbered anew."""
    roots = rows_of(nodes, keys).select("doc_id", "root_id", "pre", "last")
    gone = within(nodes, roots, inclusive=True).select("doc_id", "node_id")
    return renumber(semi(nodes, gone, [("doc_id", "doc_id"), ("node_id", "node_id")], how="left_anti"))


def set_attribute_where(nodes: DataFrame, test: Column, name: str, value: Column | str | None) -> DataFrame:
    """``nodes`` with an attribute set (or removed, with None) on the elements that ``test`` selects."""
    test = F.coalesce(test, F.lit(False)) & (F.col("node_type") == 1)
    others = F.filter("attr_list", lambda a: a["qname"] != name)
    at = F.get(F.filter("attr_list", lambda a: a["qname"] == name), F.lit(0))["ord"]
    if value is None:
        changed = others
    else:
        text = F.lit(value) if isinstance(value, str) else value
        null = F.lit(None).cast("string")
        place = F.coalesce(at, F.coalesce(F.array_max(F.transform("attr_list", lambda a: a["ord"])) + 1, F.lit(0)))
        new = F.struct(place.cast("int").alias("ord"), null.alias("prefix"), F.lit(name).alias("local"), null.alias("url"), F.lit(name).alias("qname"), text.alias("value"))
        changed = F.array_sort(F.concat(others, F.array(new)))
    rows = nodes.withColumn("attr_list", F.when(test, changed).otherwise(F.col("attr_list")))
    rows = rows.withColumn("attrs", F.when(test, F.map_from_entries(F.transform("attr_list", lambda a: F.struct(a["qname"], a["value"])))).otherwise(F.col("attrs")))
    if name == "id":
        rows = rows.withColumn("id", F.when(test, F.try_element_at("attrs", F.lit("id"))).otherwise(F.col("id")))
    if name == "class":
        from ..functions.columns import tokens

        rows = rows.withColumn("class_tokens", F.when(test, tokens(F.try_element_at("attrs", F.lit("class")))).otherwise(F.col("class_tokens")))
    return rows


def transfer(nodes: DataFrame, keys: DataFrame, to_doc: int) -> DataFrame:
    """The subtrees of ``keys`` as detached trees of document ``to_doc``, with new ids there (adopt, import).

    Add them to the document's rows; for adoption also take them out of their
    own document with remove_subtrees.
    """
    roots = rows_of(nodes, keys).select(F.col("doc_id").alias("_d"), F.col("root_id").alias("_t"), F.col("pre").alias("_p"), F.col("last").alias("_l"), F.col("depth").alias("_h"))
    base = nodes.filter(F.col("doc_id") == to_doc).agg(F.coalesce(F.max("node_id"), F.lit(-1)).alias("_base"), F.coalesce(F.max("last"), F.lit(-1)).alias("_end"))
    met = nodes.join(roots, (F.col("doc_id") == F.col("_d")) & (F.col("root_id") == F.col("_t")) & (F.col("pre") >= F.col("_p")) & (F.col("pre") <= F.col("_l")))
    # A row of two numbers for the target document.
    met = met.join(F.broadcast(base))
    from pyspark.sql import Window

    starts = rows_of(nodes, keys).select(F.col("doc_id").alias("_d"), F.col("root_id").alias("_t"), F.col("pre").alias("_p"), (F.col("last") - F.col("pre") + 1).alias("n"))
    # One row per moved subtree; their numbers follow each other.
    order = Window.orderBy("_d", "_t", "_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    met = met.join(starts, ["_d", "_t", "_p"])
    place = F.col("_start") + F.col("pre") - F.col("_p")
    by_old = met.select("_d", F.col("node_id").alias("_old"), (F.col("_base") + 1 + place).alias("_new"))
    up = by_old.select("_d", F.col("_old").alias("parent_id"), F.col("_new").alias("_parent"))
    top = F.col("pre") == F.col("_p")
    out = met.withColumns({"_new": F.col("_base") + 1 + place, "_root": F.col("_base") + 1 + F.col("_start"), "_pre": F.col("_end") + 1 + place, "_top": top}).join(up, ["_d", "parent_id"], "left")
    return out.withColumns({
        "doc_id": F.lit(to_doc).cast("long"), "node_id": F.col("_new"), "root_id": F.col("_root"), "parent_id": F.when(~F.col("_top"), F.col("_parent")),
        "parent_type": F.when(~F.col("_top"), F.col("parent_type")), "last": F.col("_pre") + F.col("last") - F.col("pre"), "pre": F.col("_pre"), "depth": F.col("depth") - F.col("_h"),
        "sib_idx": F.when(F.col("_top"), 0).otherwise(F.col("sib_idx")), "elem_idx": F.when(~F.col("_top"), F.col("elem_idx")), "elem_cnt": F.when(~F.col("_top"), F.col("elem_cnt")),
        "type_idx": F.when(~F.col("_top"), F.col("type_idx")), "type_cnt": F.when(~F.col("_top"), F.col("type_cnt")),
    }).select(*[F.col(f.name).cast(f.dataType) for f in NODES])
