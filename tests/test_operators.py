"""Edits, ranges, shadow trees, events and form state on small documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from treeloom.checks import check_nodes
from treeloom.operators import axes, edits, events, ranges, shadow, text, traversal
from treeloom.plans.compile import query_selector_all
from treeloom.sources.html import parse_pages

PAGE = (
    '<form id=f><fieldset disabled><legend><input id=i1></legend><input id=i2></fieldset><input id=i3 required><input id=i4 type=email value=x>'
    '<input id=i5 type=number min=1 max=5 value=9><input type=radio name=r id=r1><input type=radio name=r id=r2><button id=b1>go</button><button id=b2>no</button>'
    '<textarea id=t1 placeholder=p></textarea><input id=i6 pattern="[a-z]+" value=abc><input id=i7 pattern="[" value=1><input type=checkbox checked id=c1></form>'
    '<div lang=en-GB dir=rtl id=d1><p id=p1>a<b id=x>b</b>c</p><p id=p2>d</p></div><progress id=g></progress><details open id=o><summary id=s>s</summary></details>'
    '<div contenteditable id=e><i id=e1>x</i></div><x-y id=xy></x-y>'
)


@pytest.fixture(scope="module")
def nodes(spark):
    df = parse_pages(spark.createDataFrame([(1, PAGE), (2, "<p id=p1>one</p><p>two</p>")], "page_id long, html string")).cache()
    yield df
    df.unpersist()


def ids(df):
    return {r["id"] for r in df.filter("doc_id = 1").collect() if r["id"]}


@pytest.mark.parametrize("selector, want", [
    (":disabled", {"i2"}), ("input:enabled:not([type])", {"i1", "i3", "i6", "i7"}), (":required", {"i3"}), (":invalid", {"i3", "i4", "i5"}), (":out-of-range", {"i5"}),
    ("input:valid", {"i1", "r1", "r2", "i6", "i7", "c1"}), (":checked", {"c1"}), (":default", {"b1", "c1"}), (":indeterminate", {"r1", "r2", "g"}), (":placeholder-shown", {"t1"}),
    ("p:lang(en)", {"p1", "p2"}), (":lang('fr')", set()), ("b:dir(rtl)", {"x"}), ("details:open", {"o"}), ("i:read-write", {"e1"}), ("input:read-write:not([required])", {"i1", "i4", "i5", "i6", "i7"}),
    (":defined[id=xy]", set()), ("b:only-child", {"x"}), ("p:has(> b)", {"p1"}), ("#p1 + p", {"p2"}),
])
def test_form_state(nodes, selector, want):
    assert ids(query_selector_all(nodes, selector)) == want


def _edit(spark, rows):
    names = [c.split()[0] for c in edits.EDITS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], edits.EDITS)


def _id(nodes, id_, doc=1):
    return nodes.filter((F.col("id") == id_) & (F.col("doc_id") == doc)).first()["node_id"]


def _body(nodes, doc=1):
    b = axes.head_or_body(nodes, "body").select("doc_id", "node_id")
    return {r["doc_id"]: r["html"] for r in text.inner_html(nodes, b).collect()}[doc]


def test_edits(spark, nodes):
    p1, p2, x = (_id(nodes, i) for i in ("p1", "p2", "x"))
    done = edits.apply_edits(nodes, _edit(spark, [
        dict(doc_id=1, seq=1, op="append_child", target_id=p1, parent_id=_id(nodes, "d1")),
        dict(doc_id=1, seq=2, op="set_attribute", target_id=p2, name="k", value="v"),
        dict(doc_id=1, seq=3, op="append_child", target_id=_id(nodes, "d1"), parent_id=x),
        dict(doc_id=1, seq=4, op="set_inner_html", target_id=p2, value="<u>1</u>2"),
        dict(doc_id=1, seq=5, op="remove", target_id=_id(nodes, "f")),
        dict(doc_id=1, seq=6, op="insert_adjacent_text", target_id=x, name="beforebegin", value="<>"),
        dict(doc_id=1, seq=7, op="clone_node", target_id=x, value="deep"),
    ]))
    out = done.nodes.cache()
    assert check_nodes(out).count() == 0
    html = _body(out)
    assert html.startswith('<div lang="en-GB" dir="rtl" id="d1"><p id="p2" k="v"><u>1</u>2</p><p id="p1">a&lt;&gt;<b id="x">b</b>c</p></div>')
    assert [r["error"] for r in done.errors.collect()] == ["hierarchy request"]
    kinds = [(r["seq"], r["type"]) for r in done.mutations.orderBy("seq").collect()]
    assert kinds == [(1, "child_list"), (1, "child_list"), (2, "attributes"), (4, "child_list"), (5, "child_list"), (6, "child_list")]
    assert _body(out, 2) == '<p id="p1">one</p><p>two</p>'
    out.unpersist()


def test_setwise_removal_equals_sequential(spark, nodes):
    keys = nodes.filter("doc_id = 1 and id in ('p1', 'f', 'i2')").select("doc_id", "node_id")
    left = edits.remove_subtrees(nodes, keys)
    assert check_nodes(left).count() == 0
    done = edits.apply_edits(nodes, _edit(spark, [dict(doc_id=1, seq=i, op="remove", target_id=_id(nodes, n)) for i, n in enumerate(("p1", "f"))])).nodes
    assert _body(left) == _body(done)


def test_transfer(spark, nodes):
    keys = nodes.filter("doc_id = 1 and id = 'd1'").select("doc_id", "node_id")
    moved = edits.transfer(nodes, keys, 2)
    both = nodes.filter("doc_id = 2").unionByName(moved)
    assert check_nodes(both).count() == 0
    top = moved.filter("parent_id is null").select("doc_id", "node_id")
    assert text.outer_html(both, top).first()["html"] == '<div lang="en-GB" dir="rtl" id="d1"><p id="p1">a<b id="x">b</b>c</p><p id="p2">d</p></div>'


def test_ranges(spark, nodes):
    p1 = _id(nodes, "p1")
    kids = {r["value"] or "b": r["node_id"] for r in nodes.filter(f"doc_id = 1 and parent_id = {p1}").collect()}
    t = {r["value"]: r["node_id"] for r in nodes.filter("doc_id = 1 and kind = 'text'").collect()}
    cols = "range_id long, doc_id long, start_id long, start_off int, end_id long, end_off int"
    r = spark.createDataFrame([(1, 1, kids["a"], 0, t["b"], 1), (2, 1, p1, 1, p1, 3), (3, 1, p1, 0, t["d"], 1)], cols)
    assert {x["range_id"]: x["text"] for x in ranges.to_text(nodes, r).collect()} == {1: "ab", 2: "bc", 3: "abcd"}
    pairs = spark.createDataFrame([(2, 1)], "range_id long, other_id long")
    assert ranges.compare_boundary_points(nodes, r, pairs, "start_to_start").first()["order"] == 1
    points = spark.createDataFrame([(1, 1, p1, 0), (1, 1, p1, 3), (1, 1, t["b"], 0)], "range_id long, doc_id long, node_id long, off int")
    assert sorted((x["off"], x["order"]) for x in ranges.compare_point(nodes, r, points).collect()) == [(0, -1), (0, 0), (3, 1)]
    cut = ranges.delete_contents(nodes, r.filter("range_id = 2"))
    assert check_nodes(cut).count() == 0
    assert '<p id="p1">a</p>' in _body(cut)
    sel = ranges.select_nodes(nodes, nodes.filter("doc_id = 1 and id = 'p1'").select("doc_id", "node_id"), contents=True)
    assert ranges.to_text(nodes, sel).first()["text"] == "abc"
    assert ranges.collapse(r, to_start=True).filter(ranges.is_collapsed()).count() == 3


def test_walker(nodes):
    root = nodes.filter("doc_id = 1 and id = 'd1'").select("doc_id", "node_id")
    seen = traversal.tree_walker(nodes, root, what_to_show=1, filter=F.when(F.col("id") == "p1", traversal.SKIP).otherwise(traversal.ACCEPT))
    rows = {r["id"]: r for r in seen.collect()}
    assert set(rows) == {"d1", "x", "p2"}
    assert rows["x"]["parent_id_"] == rows["d1"]["node_id"] and rows["x"]["next_sibling"] == rows["p2"]["node_id"]
    assert rows["d1"]["first_child"] == rows["x"]["node_id"]
    assert traversal.node_iterator(nodes, root, what_to_show=4).count() == 4


def test_text_operators(spark, nodes):
    split = edits.apply_edits(nodes, _edit(spark, [
        dict(doc_id=2, seq=1, op="split_text", target_id=nodes.filter("doc_id = 2 and value = 'one'").first()["node_id"], value="1")])).nodes.filter("doc_id = 2").cache()
    assert check_nodes(split).count() == 0
    assert sorted(r["text"] for r in text.whole_text(split).collect()) == ["one", "one", "two"]
    assert sorted(r["value"] for r in text.normalized_texts(split).collect()) == ["one", "two"]
    split.unpersist()


def test_shadow_and_slots(spark):
    nodes = parse_pages(spark.createDataFrame([(1, "<div id=h><p slot=a>1</p>t<p>2</p></div>")], "page_id long, html string"))
    h = _id(nodes, "h")
    made = edits.apply_edits(nodes, _edit(spark, [dict(doc_id=1, seq=1, op="attach_shadow", target_id=h, name="open")])).nodes.cache()
    s = made.filter("kind = 'shadow_root'").first()["node_id"]
    full = edits.apply_edits(made, _edit(spark, [dict(doc_id=1, seq=1, op="set_inner_html", target_id=s, value="<slot name=a></slot><slot></slot>")])).nodes.cache()
    assert check_nodes(full).count() == 0
    a = shadow.slot_assignment(full)
    lists = sorted(len(r["nodes"]) for r in shadow.assigned_nodes(a, full).collect())
    assert lists == [1, 2]
    assert shadow.assigned_slot(a, full).count() == 3
    assert shadow.shadow_roots(full).first()["host_id"] == h
    assert shadow.slot_changes(a, a.filter("position = 0")).count() == 1
    assert axes.root_node(full, composed=True).filter("is_connected").count() == full.count()
    slot = full.filter("local_name = 'slot'").orderBy("pre").first()["node_id"]
    e = spark.createDataFrame([(1, 1, slot, "click", True, True, True)], "event_id long, doc_id long, target_id long, type string, bubbles boolean, cancelable boolean, composed boolean").withColumn("ts", F.current_timestamp())
    path = events.composed_path(full, e)
    assert {r["seen_target"] for r in path.collect()} == {slot, h}
    assert query_selector_all(full, ":host(div)", scope=None).count() == 1
    root = full.filter("kind = 'shadow_root'").select("doc_id", "node_id")
    assert query_selector_all(full, ":host > slot", scope=root, crossing=True).count() == 2
    assert query_selector_all(full, "body slot[name=a]", scope=root, crossing=True).count() == 1
    assert query_selector_all(full, ":host > slot", scope=root).count() == 0
    made.unpersist()
    full.unpersist()


def test_dispatch(spark, nodes):
    x, p1, d1 = (_id(nodes, i) for i in ("x", "p1", "d1"))
    rows = [(1, d1, 1, "click", True, False, False, None, "a"), (1, p1, 2, "click", False, False, False, None, events.STOP), (1, p1, 3, "click", False, True, False, None, "b"),
            (1, d1, 4, "click", False, False, False, None, "c"), (1, x, 5, "click", False, False, True, None, events.PREVENT), (1, x, 6, "click", False, False, False, 9, "d")]
    listeners = spark.createDataFrame(rows, events.LISTENERS)
    e = spark.createDataFrame([(1, 1, x, "click", True, True, False, None), (2, 1, x, "click", False, True, False, None)], events.EVENTS)
    signals = spark.createDataFrame([(9, 5)], "signal_id long, aborted_at long")
    fired = events.dispatch(nodes, e, listeners, signals)
    seqs = lambda i: [r["seq"] for r in fired.filter(f"event_id = {i}").orderBy("fire_ord").collect()]
    assert seqs(1) == [1, 5, 2, 3]
    assert seqs(2) == [1, 5]
    assert [r["not_prevented"] for r in events.outcomes(e, fired).collect()] == [True, True]
    r1 = _id(nodes, "r1")
    clicks = spark.createDataFrame([(1, 1, r1, "click", True, True, False, None), (2, 1, _id(nodes, "c1"), "click", True, True, False, None), (3, 1, _id(nodes, "s"), "click", True, True, False, None)], events.EVENTS)
    acts = {(r["node_id"], r["what"]): r["value"] for r in events.default_actions(nodes, clicks, clicks.select("event_id", F.lit(True).alias("not_prevented"))).collect()}
    assert acts[(r1, "checked")] is True and acts[(_id(nodes, "c1"), "checked")] is False and acts[(_id(nodes, "o"), "open")] is False


def test_signals_and_reactions(spark, nodes):
    s = spark.createDataFrame([(1, 5, "r"), (2, None, None), (3, None, None)], "signal_id long, aborted_at long, reason string")
    d = spark.createDataFrame([(2, 1), (3, 2)], "signal_id long, source_id long")
    assert {r["signal_id"]: r["aborted_at"] for r in events.aborted_signals(s, d).collect()} == {1: 5, 2: 5, 3: 5}
    defined = spark.createDataFrame([(1, "x-y", ["k"])], "doc_id long, local_name string, observed array<string>")
    after = edits.set_attribute_where(nodes, F.col("id") == "xy", "k", "1")
    got = events.reactions(nodes, after, defined).collect()
    assert [(r["reaction"], r["new_value"]) for r in got] == [("attributeChanged", "1")]
    assert events.attribute_changes(nodes, after).count() == 1


def test_empty_tables(spark, nodes):
    none = nodes.filter("false")
    assert query_selector_all(none, "a b > c:has(d), e ~ f").count() == 0
    assert check_nodes(none).count() == 0
    assert edits.remove_subtrees(none, none.select("doc_id", "node_id")).count() == 0


def test_order_trees_of_odd_tables(spark, tmp_path):
    from treeloom.sources.orders_tree import orders_tree

    spark.createDataFrame([(0, "X")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, "a", 0, "M"), (2, "b", 5, None), (None, "c", 0, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(7, 1, "F", "1"), (5, 1, "O", None), (9, None, "F", "1"), (8, 3, "F", "1"), (None, 1, "P", "2")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    lines = [(7, 2, 21, "R"), (7, 1, 22, None), (7, 3, 23, "N"), (8, 1, 24, "R"), (9, 1, 25, "R"), (None, 1, 26, "R"), (6, 1, 27, "R")]
    spark.createDataFrame([(k, i, p, 1, 2.0, 1.0, 0.0, 0.0, f, "O", None) for k, i, p, f in lines], line).write.parquet(str(tmp_path / "lineitem.parquet"))
    tree = orders_tree(spark, str(tmp_path))
    got = {(r["doc_id"], r["pre"]): r for r in tree.filter("doc_id is not null").collect()}
    assert [(r["local_name"] or r["value"], r["last"], r["parent_id"]) for k, r in sorted(got.items()) if k[0] == 1] == [
        (None, 10, None), ("customer", 10, 0), ("order", 2, 1), ("order", 3, 1), ("order", 10, 1), ("item", 6, 4), ("22", 6, 5), ("return", 8, 4), ("21", 8, 7), ("item", 10, 4), ("23", 10, 9)]
    assert [got[1, p]["type_idx"] for p in (5, 7, 9)] == [1, 1, 2] and [got[1, p]["type_cnt"] for p in (5, 7, 9)] == [2, 1, 2]
    assert sorted(p for d, p in got if d == 2) == [0, 1] and sorted(p for d, p in got if d == 3) == [2, 3, 4]
    bare = {r["pre"]: r["last"] for r in tree.filter("doc_id is null").collect()}
    assert bare == {0: 1, 1: 1, 2: 4, 3: 4, 4: 4}


def _pair_of_ranges(spark):
    nodes = parse_pages(spark.createDataFrame([(1, "<p>ab</p><p>cd</p>")], "page_id long, html string"))
    t = {r["value"]: r["node_id"] for r in nodes.filter("kind = 'text'").collect()}
    rows = [(1, 1, t["ab"], 0, t["ab"], 2), (1, 1, t["ab"], 0, t["ab"], 2), (2, 1, t["cd"], 1, t["cd"], 1), (3, 1, 999, 0, t["cd"], 0)]
    return nodes, spark.createDataFrame(rows, "range_id long, doc_id long, start_id long, start_off int, end_id long, end_off int")


def test_compared_ends_only_are_placed(spark):
    nodes, r = _pair_of_ranges(spark)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "range_id long, other_id long")
    out = ranges.compare_boundary_points(nodes, r, pairs, "end_to_end")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6
    assert sorted(tuple(x) for x in out.collect()) == [(1, 2, -1), (1, 2, -1), (2, 1, 1), (2, 1, 1), (2, 3, 1)]


def test_both_ends_are_placed_in_one_lookup(spark):
    nodes, r = _pair_of_ranges(spark)
    out = ranges.with_points(nodes, r)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
    got = [(x["range_id"], x["start"] and x["start"]["off"], x["end"]["off"]) for x in out.collect()]
    assert sorted(got, key=str) == [(1, 0, 2), (1, 0, 2), (2, 1, 1), (3, None, 0)]
    assert out.columns == [*r.columns, "start", "end"]


def test_compare_point_without_place(spark, nodes):
    """Points of a range that is not there are left out, those without a place have no order; equal points come back as often as they were."""
    p1 = _id(nodes, "p1")
    r = spark.createDataFrame([(1, 1, p1, 0, p1, 2), (2, 1, 999, 0, 999, 0), (None, 1, p1, 0, p1, 1)], "range_id long, doc_id long, start_id long, start_off int, end_id long, end_off int")
    points = spark.createDataFrame([(1, 1, p1, 1), (1, 1, p1, 1), (1, 1, 999, 0), (1, 1, p1, 3), (2, 1, p1, 0), (3, 1, p1, 0), (None, 1, p1, 0)], "range_id long, doc_id long, node_id long, off long")
    out = ranges.compare_point(nodes, r, points)
    assert out.columns == [*points.columns, "order"] and dict(out.dtypes)["off"] == "bigint"
    got = sorted(((x["range_id"], x["node_id"], x["off"], x["order"]) for x in out.collect()), key=str)
    assert got == sorted([(1, p1, 1, 0), (1, p1, 1, 0), (1, 999, 0, None), (1, p1, 3, 1), (2, p1, 0, None)], key=str)
