"""Selector syntax, and compiled plans held against a naive matcher on random trees."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.plans import css
from treeloom.plans.compile import query_selector_all
from treeloom.sources.html import ARROW, columns, node_rows
from treeloom.sources.tree_builder import HTML, Node
from treeloom.schema import NODES


@pytest.mark.parametrize("text, canonical", [
    ("div", "div"), ("*", "*"), ("div.a#b", "div.a#b"), ("a   >  b", "a > b"), ("a\t b", "a b"), ("a,b", "a, b"), ("[x]", "[x]"), ("[ x = 'y' i ]", '[x="y" i]'),
    (":nth-child(odd)", ":nth-child(2n+1)"), (":nth-child( -n + 3 )", ":nth-child(-n+3)"), (":nth-last-child(2 of .a, b)", ":nth-last-child(2 of .a, b)"),
    (":not(a > b, .c)", ":not(a > b, .c)"), (":has(> a, + b)", ":has(> a, + b)"), ("a::before", "a::before"), ("::slotted(.x)", "::slotted(.x)"), ("*|a", "*|a"), ("|a", "|a"),
    (r"#\31 23", r"#\31 23"), (r".a\.b", r".a\.b"), (":lang(en, 'fr')", ':lang("en", "fr")'), ("é", "é"), (":before", "::before"),
])
def test_canonical(text, canonical):
    tree = css.parse(text)
    assert str(tree) == canonical
    assert css.parse(canonical) == tree


@pytest.mark.parametrize("text", ["", ",", "a,", "a >", "> a", "#", "#1", ".", "[", "[a", "[a=]", "a b,", ":not()", ":nth-child(x)", "ns|a", "[ns|a]", "a!", ":is(a", '"a"', "a || b"])
def test_errors(text):
    with pytest.raises(css.SelectorError):
        css.parse(text)


@pytest.mark.parametrize("text, ab", [("odd", (2, 1)), ("even", (2, 0)), ("3", (0, 3)), ("-2", (0, -2)), ("n", (1, 0)), ("-n+3", (-1, 3)), ("2n - 1", (2, -1)), ("+4n", (4, 0))])
def test_anb(text, ab):
    assert css.parse_anb(text) == ab


TAGS, CLASSES = ("a", "b", "c", "div", "p", "li"), ("x", "y", "z")
_name = st.sampled_from(TAGS)
_simple = st.one_of(
    st.builds(css.Class, st.sampled_from(CLASSES)), st.builds(css.Attribute, st.just("k")), st.builds(css.Attribute, st.just("k"), st.sampled_from(("=", "^=", "$=", "*=", "~=", "|=")), st.sampled_from(("u", "v", "u-v", "")), st.sampled_from((None, "i"))),
    st.builds(css.Pseudo, st.sampled_from(("first-child", "last-child", "only-child", "first-of-type", "empty", "root"))),
    st.builds(css.Nth, st.sampled_from(("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")), st.integers(-2, 3), st.integers(-2, 3)),
)


def _compound(simple):
    return st.builds(lambda t, s: css.Compound(((css.Type(t),) if t else (css.Universal(),)) + tuple(s)), st.one_of(st.none(), _name), st.lists(simple, max_size=2))


def _complex(simple):
    return st.builds(lambda first, rest: css.Complex((("", first), *rest)), _compound(simple), st.lists(st.tuples(st.sampled_from((" ", ">", "+", "~")), _compound(simple)), max_size=2))


_lists = st.builds(lambda a: css.SelectorList(tuple(a)), st.lists(_complex(_simple), min_size=1, max_size=2))
_nested = st.one_of(
    _simple, st.builds(css.Logical, st.sampled_from(("is", "not", "where")), _lists),
    st.builds(lambda c, a: css.Has(css.SelectorList((css.Complex(((c, a.steps[0][1]), *a.steps[1:])),))), st.sampled_from((" ", ">", "+", "~")), _complex(_simple)),
    st.builds(lambda n, b, of: css.Nth(n, 1, b, of), st.sampled_from(("nth-child", "nth-last-child")), st.integers(1, 2), _lists),
)
SELECTORS = st.builds(lambda a: css.SelectorList(tuple(a)), st.lists(_complex(_nested), min_size=1, max_size=2))


@settings(max_examples=300, deadline=None)
@given(SELECTORS)
def test_round_trip(tree):
    assert css.parse(str(tree)) == tree


# -- a naive matcher


def elements(n):
    return [c for c in n.children if c.kind == "element"]


def naive(n, arm, k=None):
    """Whether n matches the steps of arm up to k."""
    k = len(arm.steps) - 1 if k is None else k
    c, compound = arm.steps[k]
    if n.kind != "element" or not all(simple(n, p) for p in compound.parts):
        return False
    if k == 0:
        return True
    if c == " ":
        p = n.parent
        while p is not None:
            if naive(p, arm, k - 1):
                return True
            p = p.parent
        return False
    if c == ">":
        return n.parent is not None and naive(n.parent, arm, k - 1)
    before = elements(n.parent)[: elements(n.parent).index(n)] if n.parent else []
    return any(naive(b, arm, k - 1) for b in (before[-1:] if c == "+" else before))


def relative(n, arm):
    c = arm.steps[0][0]
    family = elements(n.parent) if n.parent else [n]
    after = family[family.index(n) + 1 :]
    if c == ">":
        starts = elements(n)
    elif c == " ":
        starts = [m for m in n.walk() if m is not n]
    else:
        starts = after[:1] if c == "+" else after
    return any(starts_at(s, arm, 0) for s in starts)


def starts_at(n, arm, k):
    if n.kind != "element" or not all(simple(n, p) for p in arm.steps[k][1].parts):
        return False
    if k == len(arm.steps) - 1:
        return True
    c = arm.steps[k + 1][0]
    family = elements(n.parent) if n.parent else [n]
    after = family[family.index(n) + 1 :]
    following = {">": elements(n), " ": [m for m in n.walk() if m is not n], "+": after[:1], "~": after}[c]
    return any(starts_at(m, arm, k + 1) for m in following)


def anb(i, a, b):
    return i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def simple(n, p):
    family = elements(n.parent) if n.parent else [n]
    if isinstance(p, css.Type):
        return n.name == p.name
    if isinstance(p, css.Universal):
        return True
    if isinstance(p, css.Class):
        return p.value in (n.get("class") or "").split()
    if isinstance(p, css.Attribute):
        v = n.get(p.name)
        if v is None or p.op is None:
            return v is not None
        w = p.value
        if p.flag == "i":
            v, w = v.lower(), w.lower()
        if p.op == "=":
            return v == w
        if p.op == "|=":
            return v == w or v.startswith(w + "-")
        if w == "":
            return False
        return {"^=": v.startswith(w), "$=": v.endswith(w), "*=": w in v, "~=": w in v.split()}[p.op]
    if isinstance(p, css.Nth):
        if p.name.endswith("of-type"):
            family = [f for f in family if f.name == n.name]
        elif p.of:
            family = [f for f in family if any(naive(f, a) for a in p.of.arms)]
        if n not in family:
            return False
        i = family.index(n)
        return anb(len(family) - i if "last" in p.name else i + 1, p.a, p.b)
    if isinstance(p, css.Logical):
        hit = any(naive(n, a) for a in p.selectors.arms)
        return not hit if p.name == "not" else hit
    if isinstance(p, css.Has):
        return any(relative(n, a) for a in p.selectors.arms)
    same = [f for f in family if f.name == n.name]
    return {
        "first-child": family[0] is n, "last-child": family[-1] is n, "only-child": len(family) == 1, "first-of-type": same[0] is n,
        "empty": not any(c.kind in ("element", "text") for c in n.children), "root": n.parent is None or n.parent.kind != "element",
    }[p.name]


def random_tree(rng, depth=0):
    if depth and rng.random() < 0.3:
        return Node("comment", value="c") if rng.random() < 0.3 else Node("text", value="t")
    attrs = []
    if rng.random() < 0.5:
        attrs.append((None, "class", None, "class", " ".join(rng.sample(CLASSES, rng.randint(1, 2)))))
    if rng.random() < 0.5:
        attrs.append((None, "k", None, "k", rng.choice(("u", "U", "u-v", "v u", ""))))
    n = Node("element", rng.choice(TAGS), HTML, attrs)
    if depth < 5:
        for _ in range(rng.randint(0, 4)):
            n.append(random_tree(rng, depth + 1))
    return n


def generate(strategy, n):
    """n examples of a strategy, as plain values."""
    out = []

    @settings(max_examples=n, deadline=None, database=None, derandomize=True)
    @given(strategy)
    def take(x):
        out.append(x)

    take()
    return out[:n]


def test_plans_against_naive_matcher(spark):
    rng = random.Random(5)
    docs = []
    for i in range(6):
        doc = Node("document")
        doc.append(random_tree(rng))
        docs.append(doc)
    rows, ids = [], {}
    for i, doc in enumerate(docs):
        rows += node_rows(i, doc)
        ids.update({(i, k): n for k, n in enumerate(doc.walk())})
    import pyarrow as pa

    table = pa.Table.from_arrays(columns(rows), schema=ARROW)
    nodes = spark.createDataFrame(table, NODES).cache()
    picks = [s for s in generate(SELECTORS, 60)][-28:]
    for tree in picks:
        want = {k for k, n in ids.items() if any(naive(n, a) for a in tree.arms)}
        got = [tuple(r) for r in query_selector_all(nodes, str(tree)).select("doc_id", "node_id").collect()]
        assert len(got) == len(set(got)), str(tree)
        assert set(got) == want, str(tree)
    nodes.unpersist()


def test_plans_have_no_cartesian_product(spark):
    from treeloom.sources.orders_tree import orders_tree

    nodes = orders_tree(spark, "/root/testdata/sf0.001")
    for s in ("customer order > return", "order:has(return) ~ order", "item:not(return + item)"):
        plan = query_selector_all(nodes, s)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_containment_is_no_range_join(spark):
    """What holds a node comes from sweeps: no join compares places."""
    from treeloom.operators import axes, text, traversal
    from treeloom.plans.compile import closest
    from treeloom.sources.orders_tree import orders_tree

    nodes = orders_tree(spark, "/root/testdata/sf0.001")
    orders = nodes.filter("local_name = 'order'").select("doc_id", "node_id")
    pairs = orders.withColumn("other_id", orders["node_id"])
    for df in (axes.ancestors(nodes, orders), axes.common_ancestor(nodes, pairs), text.text_content(nodes, orders), text.outer_html(nodes, orders), closest(nodes, "order"), traversal.tree_walker(nodes, orders)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert joins and not any(c in line for line in joins for c in ("<", ">")), joins


def test_enclosing_pairs(spark):
    """Nested scopes, a scope that is a leaf, and a node in none."""
    from treeloom.operators.intervals import enclosing, nearest_ancestor

    tree = [(0, 9), (1, 5), (2, 4), (3, 3), (4, 4), (5, 5), (6, 8), (7, 7), (8, 8), (9, 9)]
    nodes = spark.createDataFrame([(1, 0, i, a, b) for i, (a, b) in enumerate(tree)], "doc_id long, root_id long, node_id long, pre long, last long")
    scopes = nodes.filter("node_id in (1, 2, 4, 6)")
    for inclusive in (True, False):
        want = {(i, s) for i, (a, _) in enumerate(tree) for s in (1, 2, 4, 6) if tree[s][0] <= a <= tree[s][1] and (inclusive or i != s)}
        got = [(r["node_id"], r["s"]) for r in enclosing(nodes, scopes, {"s": scopes["node_id"]}, inclusive=inclusive).collect()]
        assert len(got) == len(want) and set(got) == want
        nearest = {r["node_id"]: r["n"] for r in nearest_ancestor(nodes, scopes.withColumn("v", scopes["node_id"]), "v", "n", inclusive=inclusive).collect()}
        assert nearest == {i: max((s for k, s in want if k == i), default=None) for i in range(10)}
