"""Queries over small documents made from the table supplier, with SQL from what they are made of.

Every supplier has one document per case; its id is 100 times the supplier's key
and the number of the case.  So each operation meets documents in number, and what
must come out is plain text around the supplier's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from ..functions import columns as fn
from ..operators import axes, edits, events, ranges, shadow, text
from ..session import store
from ..sources import html
from ..sources.orders_tree import orders_tree
from .compile import query_selector_all
from .registry import KEY, _keys, _read, _with_shadows, query

NAME = "\x01"  # stands for the supplier's name in the texts of cases


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.col("s_name").alias("name"))


def _documents(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """(doc_id, html): each text for each supplier."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(texts)])
    rows = _suppliers(spark, sf_dir).select("s", "name", F.explode(each).alias("c"))
    return rows.select((F.col("s") * 100 + F.col("c.i")).alias("doc_id"), F.replace("c.t", F.lit(NAME), F.col("name")).alias("html"))


def _expected(columns: str, rows: list[tuple]) -> str:
    """SQL of rows (case, value, ...) for every supplier; the values are SQL."""
    values = ", ".join(f"({', '.join(map(str, r))})" for r in rows)
    names = columns.split(", ")
    shown = ", ".join(f"replace({n}, chr(1), s_name) AS {n}" if n in ("html", "data", "value") else n for n in names)
    return f"SELECT s_suppkey::BIGINT * 100 + i AS doc_id, {shown} FROM supplier, (VALUES {values}) t(i, {columns})"


# -- edits: nodes 4 p#a, 5 its text, 6 b, 7 its text, 8 p#c, 9 its text; new ones from 10

BASE = f"<p id=a>{NAME}<b>y</b></p><p id=c>z</p>"
_A, _C = f'<p id="a">{NAME}<b>y</b></p>', '<p id="c">z</p>'


def _op(op: str, target=None, parent=None, reference=None, name=None, value=None) -> tuple:
    return (op, target, parent, reference, name, value)


STRUCTURE = [
    ([_op("insert_before", 8, 3, 4)], _C + _A, 3),
    ([_op("insert_before", 8, 4, 6)], f'<p id="a">{NAME}{_C}<b>y</b></p>', 3),
    ([_op("append_child", 4, 3)], _C + _A, 3),
    ([_op("remove_child", 6, 4)], f'<p id="a">{NAME}</p>{_C}', 2),
    ([_op("remove", 8)], _A, 2),
    ([_op("replace_child", 6, 3, 8)], f'<p id="a">{NAME}</p><b>y</b>', 2),
    ([_op("replace_with", 6, value="w")], f'<p id="a">{NAME}w</p>{_C}', 3),
    ([_op("append", 8, value="<")], f'{_A}<p id="c">z&lt;</p>', 4),
    ([_op("prepend", 8, value="0")], f'{_A}<p id="c">0z</p>', 4),
    ([_op("before", 8, value="0")], f"{_A}0{_C}", 4),
    ([_op("after", 8, reference=6)], f'<p id="a">{NAME}</p>{_C}<b>y</b>', 3),
    ([_op("set_text_content", 4, value="t")], f'<p id="a">t</p>{_C}', 2),
    ([_op("create_element", name="EM"), _op("append_child", 10, 8)], f'{_A}<p id="c">z<em></em></p>', 3),
    ([_op("create_element_ns", name="g", value="http://www.w3.org/2000/svg"), _op("append_child", 10, 8)], f'{_A}<p id="c">z<g></g></p>', 3),
    ([_op("create_text", value="&"), _op("append_child", 10, 8)], f'{_A}<p id="c">z&amp;</p>', 4),
    ([_op("create_comment", value="k"), _op("append_child", 10, 8)], f'{_A}<p id="c">z<!--k--></p>', 3),
    ([_op("create_fragment"), _op("append_child", 6, 10), _op("append_child", 5, 10), _op("append_child", 10, 8)], f'<p id="a"></p><p id="c">z<b>y</b>{NAME}</p>', 3),
    ([_op("clone_node", 6, value="deep"), _op("append_child", 10, 8)], f'{_A}<p id="c">z<b>y</b></p>', 4),
    ([_op("clone_node", 6), _op("append_child", 10, 8)], f'{_A}<p id="c">z<b></b></p>', 3),
    ([_op("append_child", 4, 6), _op("remove", 8)], _A, 2),  # the first is refused
]
MARKUP = [
    ([_op("set_inner_html", 8, value="<i>1</i>&amp;")], f'{_A}<p id="c"><i>1</i>&amp;</p>', 4),
    ([_op("set_outer_html", 6, value="<u>2</u>3")], f'<p id="a">{NAME}<u>2</u>3</p>{_C}', 4),
    ([_op("insert_adjacent_html", 8, name="beforebegin", value="<hr>")], f"{_A}<hr>{_C}", 3),
    ([_op("insert_adjacent_html", 8, name="afterend", value="<hr>5")], f"{_A}{_C}<hr>5", 4),
    ([_op("insert_adjacent_html", 8, name="beforeend", value="<i>")], f'{_A}<p id="c">z<i></i></p>', 3),
    ([_op("insert_adjacent_text", 8, name="afterbegin", value="&")], f'{_A}<p id="c">&amp;z</p>', 4),
]
VALUES = [
    ([_op("set_attribute", 8, name="TITLE", value='"<')], f'{_A}<p id="c" title="&quot;&lt;">z</p>', 3),
    ([_op("remove_attribute", 8, name="id")], f"{_A}<p>z</p>", 3),
    ([_op("toggle_attribute", 8, name="hidden")], f'{_A}<p id="c" hidden="">z</p>', 3),
    ([_op("toggle_attribute", 8, name="id")], f"{_A}<p>z</p>", 3),
    ([_op("set_attribute_ns", 8, name="xlink:href", value="v")], f'{_A}<p id="c" xlink:href="v">z</p>', 3),
    ([_op("replace_data", 9, name="0,1", value="Z")], f'{_A}<p id="c">Z</p>', 3),
    ([_op("split_text", 5, value="3")], _A + _C, 4),
    ([_op("append", 8, value="s"), _op("append", 8, value=""), _op("normalize", 8)], f'{_A}<p id="c">zs</p>', 3),
]


def _log(docs: DataFrame, cases: list) -> DataFrame:
    """The edits of every document, by the number of its case."""
    null = lambda v, t: F.lit(v).cast(t)
    every = [
        F.struct(F.lit(i).alias("i"), null(k, "long").alias("seq"), F.lit(e[0]).alias("op"), null(e[1], "long").alias("target_id"), null(e[2], "long").alias("parent_id"), null(e[3], "long").alias("reference_id"), null(e[4], "string").alias("name"), null(e[5], "string").alias("value"))
        for i, (ops, *_) in enumerate(cases) for k, e in enumerate(ops, 1)]
    return docs.select("doc_id", F.explode(F.array(*every)).alias("e")).filter(F.col("e.i") == F.col("doc_id") % 100).select("doc_id", "e.*").drop("i")


def _edited(spark: SparkSession, sf_dir: str, cases: list) -> edits.Edited:
    docs = _documents(spark, sf_dir, [BASE] * len(cases))
    return edits.apply_edits(html.parse_pages(docs, "doc_id", "html"), _log(docs, cases))


def _bodies(nodes: DataFrame) -> DataFrame:
    nodes = store(nodes)
    body = text.inner_html(nodes, _keys(axes.head_or_body(nodes, "body"))).select("doc_id", "html")
    texts = nodes.filter("kind = 'text' and root_id = 0").groupBy("doc_id").agg(F.count("*").cast("int").alias("texts"))
    return body.join(texts, "doc_id")


for _name, _cases in (("edit_structure", STRUCTURE), ("edit_markup", MARKUP), ("edit_values", VALUES)):
    query(_name, _expected("html, texts", [(i, _quote(h), n) for i, (_, h, n) in enumerate(_cases)]))(
        lambda spark, sf_dir, cases=_cases: _bodies(_edited(spark, sf_dir, cases).nodes))

REFUSED = [
    ([_op("append_child", 4, 6)], "hierarchy request"), ([_op("append_child", 8, 5)], "hierarchy request"), ([_op("insert_before", 8, 4, 9)], "not found"),
    ([_op("append_child", 4, 0)], "hierarchy request"), ([_op("remove_child", 6, 8)], "not found"), ([_op("split_text", 9, value="7")], "index size"),
    ([_op("attach_shadow", 6)], "not supported"), ([_op("remove", 77)], "not found"), ([_op("set_attribute", 5, name="x")], "hierarchy request"),
]


@query("edit_refused", _expected("seq, error", [(i, "1::BIGINT", _quote(e)) for i, (_, e) in enumerate(REFUSED)]))
def _refused(spark, sf_dir):
    return _edited(spark, sf_dir, REFUSED).errors


@query("edit_shadow", _expected("html", [(0, _quote(f"<i>{NAME}</i><slot></slot>"))]))
def _shadow_markup(spark, sf_dir):
    docs = _documents(spark, sf_dir, [BASE])
    cases = [([_op("attach_shadow", 4, name="open"), _op("set_inner_html", 10, value="<i>1</i><slot></slot>"), _op("append_child", 5, 11)],)]
    nodes = store(edits.apply_edits(html.parse_pages(docs, "doc_id", "html"), _log(docs, cases)).nodes)
    out = text.inner_html(nodes, _keys(nodes.filter("kind = 'shadow_root'")))
    return out.select("doc_id", F.replace("html", F.lit("<i>1"), F.lit("<i>")).alias("html"))


# -- the parser: what a text's body becomes

TREES = [
    ("<b>1<i>2</b>3</i>", "<b>1<i>2</i></b><i>3</i>"), (f"<b><p>{NAME}</b>2", f"<b></b><p><b>{NAME}</b>2</p>"), ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
    (f"<table>x<tr><td>{NAME}", f"x<table><tbody><tr><td>{NAME}</td></tr></tbody></table>"), ("<table><b>q</table>", "<b>q</b><table></table>"),
    ("<p><b><b><b><b><p>x", "<p><b><b><b><b></b></b></b></b></p><p><b><b><b>x</b></b></b></p>"), ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
    ("<svg viewbox=1><lineargradient/></svg>z", '<svg viewBox="1"><linearGradient></linearGradient></svg>z'), ("<svg><p>x", "<svg></svg><p>x</p>"),
    ("<math><mi>x</mi></math>y", "<math><mi>x</mi></math>y"), ("x</p></br>", "x<p></p><br>"), ("a\r\nb\rc", "a\nb\nc"), ("<pre>\n\nx", "<pre>\nx</pre>"),
    ("<textarea>&lt;b></textarea>", "<textarea>&lt;b&gt;</textarea>"), ("<div><style>a&amp;b</style>&copy;&notit;", "<div><style>a&amp;b</style>©¬it;</div>"),
    ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"), ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"), ("<p>a</p></body><p>b", "<p>a</p><p>b</p>"),
    ("<dl><dt>a<dd>b", "<dl><dt>a</dt><dd>b</dd></dl>"), ("<button>a<button>b", "<button>a</button><button>b</button>"), ("<nobr>a<nobr>b", "<nobr>a</nobr><nobr>b</nobr>"),
    ("<form>a<form>b", "<form>ab</form>"), ("x<!--c-->y", "x<!--c-->y"), ("&#128;&#x41;&amp", "€A&amp;"),
]


@query("parse_trees", _expected("html", [(i, _quote(out).replace("\n", "' || chr(10) || '")) for i, (_, out) in enumerate(TREES)]))
def _parse_trees(spark, sf_dir):
    nodes = store(html.parse_pages(_documents(spark, sf_dir, [t for t, _ in TREES]), "doc_id", "html"))
    return text.inner_html(nodes, _keys(axes.head_or_body(nodes, "body"))).select("doc_id", "html")


TOKENS = f'<p class="a">{NAME} &amp; &lt;</p><!--c--><br/><title>a&amp;b</title><style>a&amp;b</style>x\r\ny<!DOCTYPE q>'
_TOKEN_ROWS = [
    ("StartTag", "'p'", "NULL"), ("Characters", "NULL", _quote(f"{NAME} & <")), ("EndTag", "'p'", "NULL"), ("Comment", "NULL", "'c'"), ("StartTag", "'br'", "NULL"),
    ("StartTag", "'title'", "NULL"), ("Characters", "NULL", "'a&b'"), ("EndTag", "'title'", "NULL"), ("StartTag", "'style'", "NULL"), ("Characters", "NULL", "'a&amp;b'"),
    ("EndTag", "'style'", "NULL"), ("Characters", "NULL", "'x' || chr(10) || 'y'"), ("Doctype", "'q'", "NULL"),
]


@query("tokens_of_text", _expected("ord, kind, name, data", [(0, i, _quote(k), n, d) for i, (k, n, d) in enumerate(_TOKEN_ROWS)]))
def _token_rows(spark, sf_dir):
    html.register(spark)
    _documents(spark, sf_dir, [TOKENS]).createOrReplaceTempView("treeloom_token_texts")
    return spark.sql("SELECT doc_id, t.ord, t.kind, t.name, t.data FROM treeloom_token_texts, LATERAL html_tokens(html) t")


@query("tokens_of_fragment", _expected("context, kind, data", [(0, "'title'", "'Characters'", _quote(f"{NAME}&<b>")), (0, "'style'", "'Characters'", _quote(f"{NAME}&amp;<b>"))]))
def _fragment_token_rows(spark, sf_dir):
    html.register(spark)
    _documents(spark, sf_dir, [f"{NAME}&amp;<b>"]).createOrReplaceTempView("treeloom_fragment_texts")
    return spark.sql("SELECT doc_id, c AS context, t.kind, t.data FROM treeloom_fragment_texts, (SELECT explode(array('title', 'style')) AS c), LATERAL html_fragment_tokens(html, c) t")


# The SQL of page_titles knows references with a semicolon only; a text that ends in one without is decoded as well.
@query("page_titles_decoded", "SELECT page_id, replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;?', '\"', 'g'), '&amp;', '&') AS title FROM (SELECT page_id, regexp_replace(html, '&amp([^;]|$)', '&amp;\\1', 'g') AS html FROM pages)")
def _titles_decoded(spark, sf_dir):
    nodes = store(html.parse_pages(_read(spark, sf_dir, "pages")))
    found = query_selector_all(nodes, "head > title").groupBy("doc_id").agg(F.min("node_id").alias("node_id"))
    return text.text_content(nodes, found).select(F.col("doc_id").alias("page_id"), F.col("text").alias("title"))


# -- pseudo-classes: case 1 has what case 0 lacks

PAGES = [
    '<a id=l href="#k">x</a><input id=p placeholder=q><x-y id=d></x-y><details id=o><summary>s</summary></details><input id=r type=radio name=g><progress id=i></progress>'
    '<div id=k dir=rtl><b id=t>t</b></div><input id=m type=email value=a><textarea id=u pattern></textarea>',
    '<a id=l>x</a><input id=p placeholder=q value=v><x-y id=d></x-y><details id=o open><summary>s</summary></details><input id=r type=radio name=g checked><progress id=i value=1></progress>'
    '<div id=k dir=ltr><b id=t>t</b></div><input id=m type=email value=a@b.c required><textarea id=u readonly></textarea>',
]
_PSEUDO = {
    "link": (":link", ["l"], []), "any_link": (":any-link", ["l"], []), "placeholder_shown": (":placeholder-shown", ["p"], []), "defined": ("[id]:not(a):defined", list("porikmtu"), list("porikmtu")),
    "open": (":open", [], ["o"]), "indeterminate": (":indeterminate", ["r", "i"], []), "dir": ("b:dir(rtl)", ["t"], []), "valid": (":valid", ["p", "r", "u"], ["p", "r", "m", "u"]),
    "optional": (":optional", ["p", "r", "m", "u"], ["p", "r", "u"]), "read_only": ("input:read-only, textarea:read-only", ["r"], ["r", "u"]), "focus": (":focus", ["p"], ["p"]),
    "focus_visible": (":focus-visible", ["p"], ["p"]), "active": ("[id]:active", ["t", "k"], ["t", "k"]), "target": (":target", ["k"], ["k"]),
}


def _pseudo(selector: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = store(html.parse_pages(_documents(spark, sf_dir, PAGES), "doc_id", "html"))
        at = lambda name, of: F.max(F.when(F.col("id") == of, F.col("node_id"))).alias(name)
        state = nodes.groupBy("doc_id").agg(at("active_element", "p"), at("hover", "t"), at("active", "t")).withColumn("fragment", F.lit("k"))
        return query_selector_all(nodes, selector, state=state).select("doc_id", "id")

    return run


for _name, (_selector_text, *_ids) in _PSEUDO.items():
    query(f"pseudo_{_name}", _expected("id", [(i, _quote(x)) for i in (0, 1) for x in _ids[i]]))(_pseudo(_selector_text))


# -- events: a click on a customer's first or second order, by the event's number

_CLICKED = ", hit AS (SELECT event_id, user_id, ts, ord.pre, k FROM events JOIN ord ON o_custkey = user_id AND k = 1 + event_id % 2 WHERE event_type = 'click')"
_ABORTED = "2024-01-15 00:00:00"


def _clicks(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    e = _read(spark, sf_dir, "events").filter("event_type = 'click'")
    orders = nodes.filter("local_name = 'order'").select("doc_id", F.col("node_id").alias("target_id"), "elem_idx")
    return e.join(orders, (e["user_id"] == orders["doc_id"]) & (1 + F.col("event_id") % 2 == F.col("elem_idx"))).select(
        "event_id", "doc_id", "target_id", F.lit("click").alias("type"), F.lit(True).alias("bubbles"), F.lit(True).alias("cancelable"), F.lit(False).alias("composed"), "ts")


def _listener(nodes: DataFrame, test: str, seq: int, *, capture=False, once=False, signal=None, action="log") -> DataFrame:
    return nodes.filter(test).select(
        "doc_id", "node_id", F.lit(seq).cast("long").alias("seq"), F.lit("click").alias("type"), F.lit(capture).alias("capture"), F.lit(once).alias("once"), F.lit(False).alias("passive"),
        F.lit(signal).cast("long").alias("signal_id"), F.lit(action).alias("action"))


def _fired(fired: DataFrame) -> DataFrame:
    return fired.select("event_id", F.col("fire_ord").cast("long").alias("fire_ord"), "doc_id", "node_id", "seq", "phase")


@query("event_once", f"""{_CLICKED}
SELECT event_id, 1::BIGINT AS fire_ord, user_id AS doc_id, pre AS node_id, 2::BIGINT AS seq, 2 AS phase FROM hit WHERE k = 1
UNION ALL SELECT event_id, 1, user_id, 1, 1, 3 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM hit WHERE k = 2) WHERE r = 1""", tree=True)
def _once(spark, sf_dir):
    """A listener that fires once, for the first event that no order has stopped."""
    nodes = store(orders_tree(spark, sf_dir))
    listeners = _listener(nodes, "local_name = 'customer'", 1, once=True).unionByName(_listener(nodes, "local_name = 'order' and elem_idx = 1", 2, action=events.STOP))
    return _fired(events.dispatch(nodes, _clicks(spark, sf_dir, nodes), listeners))


@query("event_once_stops", f"""{_CLICKED}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM hit)
SELECT event_id, 1::BIGINT AS fire_ord, user_id AS doc_id, 1::BIGINT AS node_id, CASE WHEN r = 1 THEN 1 ELSE 2 END::BIGINT AS seq, 1 AS phase FROM n
UNION ALL SELECT event_id, 2, user_id, pre, 3, 2 FROM n WHERE r > 1""", tree=True)
def _once_stops(spark, sf_dir):
    """A listener that stops the first event only."""
    nodes = store(orders_tree(spark, sf_dir))
    root = "local_name = 'customer'"
    listeners = _listener(nodes, root, 1, capture=True, once=True, action=events.STOP_NOW).unionByName(_listener(nodes, root, 2, capture=True)).unionByName(_listener(nodes, "local_name = 'order'", 3))
    return _fired(events.dispatch(nodes, _clicks(spark, sf_dir, nodes), listeners))


@query("event_signals", f"""{_CLICKED}
SELECT event_id, 1::BIGINT AS fire_ord, user_id AS doc_id, 1::BIGINT AS node_id, 1::BIGINT AS seq, 3 AS phase FROM hit WHERE ts < TIMESTAMP '{_ABORTED}'
UNION ALL SELECT event_id, CASE WHEN ts < TIMESTAMP '{_ABORTED}' THEN 2 ELSE 1 END, user_id, 1, 2, 3 FROM hit""", tree=True)
def _signals(spark, sf_dir):
    """A listener whose signal is aborted on a day, and one without."""
    nodes = store(orders_tree(spark, sf_dir))
    listeners = _listener(nodes, "local_name = 'customer'", 1, signal=5).unionByName(_listener(nodes, "local_name = 'customer'", 2))
    signals = spark.range(1).select(F.lit(5).cast("long").alias("signal_id"), F.to_timestamp(F.lit(_ABORTED)).alias("aborted_at"))
    return _fired(events.dispatch(nodes, _clicks(spark, sf_dir, nodes), listeners, signals))


@query("signal_chain", "SELECT user_id AS signal_id, 2 * user_id AS aborted_at FROM (SELECT DISTINCT user_id FROM events)")
def _signal_chain(spark, sf_dir):
    """Chains of four signals: each depends on the one before, and the first is aborted."""
    s = _read(spark, sf_dir, "events").select(F.col("user_id").alias("root")).distinct()
    link = lambda i: F.col("root") * 4 + i
    signals = s.select(F.explode(F.array(*[F.struct(link(i).alias("signal_id"), F.when(F.lit(i) == 0, F.col("root") * 2).alias("aborted_at")) for i in range(4)])).alias("x")).select("x.*", F.lit("r").alias("reason"))
    depends = s.select(F.explode(F.array(*[F.struct(link(i).alias("signal_id"), link(i - 1).alias("source_id")) for i in range(1, 4)])).alias("x")).select("x.*")
    last = events.aborted_signals(signals, depends).filter("signal_id % 4 = 3")
    return last.select(F.expr("(signal_id - 3) div 4").alias("signal_id"), "aborted_at")


@query("element_reactions", _expected("reaction, name, value", [(0, "'attributeChanged'", "'k'", _quote(NAME)), (1, "'attributeChanged'", "'k'", _quote(NAME))]))
def _reactions(spark, sf_dir):
    nodes = store(html.parse_pages(_documents(spark, sf_dir, PAGES), "doc_id", "html"))
    defined = nodes.filter("kind = 'document'").select("doc_id", F.lit("x-y").alias("local_name"), F.array(F.lit("k"), F.lit("z")).alias("observed"))
    names = _suppliers(spark, sf_dir).select("s", "name")
    named = nodes.join(names, F.expr("doc_id div 100") == F.col("s"))
    after = edits.set_attribute_where(named, F.col("local_name") == "x-y", "k", F.col("name")).select(*nodes.columns)
    return events.reactions(nodes, after, defined).select("doc_id", "reaction", "name", F.col("new_value").alias("value"))


# -- slots, checks, ranges


@query("assigned_nodes", "SELECT o_custkey AS doc_id, string_agg(pre::VARCHAR, ',' ORDER BY k) AS nodes FROM ord GROUP BY 1", tree=True)
def _assigned(spark, sf_dir):
    nodes = store(_with_shadows(orders_tree(spark, sf_dir)))
    lists = shadow.assigned_nodes(shadow.slot_assignment(nodes), nodes, elements=True)
    return lists.select("doc_id", F.array_join("nodes", ",").alias("nodes"))


@query("assigned_slot", "SELECT o_custkey AS doc_id, pre AS node_id FROM ord", tree=True)
def _assigned_slot(spark, sf_dir):
    nodes = store(_with_shadows(orders_tree(spark, sf_dir)))
    return shadow.assigned_slot(shadow.slot_assignment(nodes), nodes).select(*KEY)


@query("slot_manual", "SELECT o_custkey AS doc_id, pre AS node_id, 0::BIGINT AS position FROM ord WHERE k = 1", tree=True)
def _manual(spark, sf_dir):
    nodes = store(_with_shadows(orders_tree(spark, sf_dir)).withColumn("slot_assignment", F.when(F.col("kind") == "shadow_root", "manual")))
    slots = nodes.filter("local_name = 'slot'").select("doc_id", F.col("node_id").alias("slot_id"))
    firsts = nodes.filter("local_name = 'order' and elem_idx = 1").select("doc_id", F.array("node_id", F.lit(0).cast("long")).alias("nodes"))
    return shadow.slot_assignment(nodes, slots.join(firsts, "doc_id")).select(*KEY, F.col("position").cast("long").alias("position"))


@query("check_finds", """
SELECT o_custkey AS doc_id, pre AS node_id, 'wrong sib_idx' AS violation FROM ord WHERE k = 1
UNION ALL SELECT o_custkey, pre, 'last before pre' FROM line WHERE i = 1 AND k = 2
UNION ALL SELECT o_custkey, pre + 1, 'not within parent' FROM line WHERE i = 1 AND k = 2
UNION ALL SELECT a.o_custkey, b.pre, 'siblings overlap' FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND b.i = 2 WHERE a.i = 1 AND a.k = 2""", tree=True)
def _check_finds(spark, sf_dir):
    """Trees with a wrong ordinal in each first order, and a first line of each second order that ends too early."""
    nodes = store(orders_tree(spark, sf_dir))
    second = nodes.filter("local_name = 'order' and elem_idx = 2").select("doc_id", F.col("node_id").alias("_order"))
    broken = nodes.join(second, "doc_id", "left")
    first_line = F.coalesce((F.col("parent_id") == F.col("_order")) & (F.col("elem_idx") == 1), F.lit(False))
    broken = broken.withColumn("last", F.when(first_line, F.col("pre") - 1).otherwise(F.col("last")))
    broken = broken.withColumn("sib_idx", F.when((F.col("local_name") == "order") & (F.col("elem_idx") == 1), 5).otherwise(F.col("sib_idx")))
    return checks.check_nodes(broken.select(*nodes.columns))


@query("range_contents", _expected("html", [(0, _quote('<p id="a"></p>' + _C))]))
def _range_contents(spark, sf_dir):
    """What is left when the contents of p#a are deleted."""
    nodes = store(html.parse_pages(_documents(spark, sf_dir, [BASE]), "doc_id", "html"))
    r = ranges.select_nodes(nodes, _keys(nodes.filter("id = 'a'")), contents=True).withColumn("range_id", F.col("doc_id"))
    left = store(ranges.delete_contents(nodes, r))
    return text.inner_html(left, _keys(axes.head_or_body(left, "body"))).select("doc_id", "html")


_SURROUNDED = "SELECT s_suppkey::BIGINT * 100 AS doc_id, '<p id=\"a\">' || substr(s_name, 1, 1) || '<u>' || substr(s_name, 2, 2) || '</u>' || substr(s_name, 4) || '<b>y</b></p><p id=\"c\">z</p>' AS html FROM supplier"


@query("range_surround", _SURROUNDED + " UNION ALL " + _expected("html", [(1, _quote(f'<p id="a"><u>{NAME}<b>y</b></u></p>{_C}')), (2, _quote(_A + _C))]))
def _range_surround(spark, sf_dir):
    """A part of a text, and all of an element, in a new element; a range that cuts an element is refused."""
    docs = _documents(spark, sf_dir, [BASE] * 3)
    of = lambda *by: F.element_at(F.array(*map(F.lit, by)), (F.col("doc_id") % 100 + 1).cast("int"))
    r = docs.select("doc_id", of(5, 4, 5).cast("long").alias("start_id"), of(1, 0, 1).alias("start_off"), of(5, 4, 9).cast("long").alias("end_id"), of(3, 2, 1).alias("end_off"), F.lit(10).cast("long").alias("new_id"))
    log = _log(docs, [([_op("create_element", name="u")],)] * 3).withColumn("seq", F.lit(-1).cast("long")).unionByName(ranges.surround_edits(r))
    return _bodies(edits.apply_edits(html.parse_pages(docs, "doc_id", "html"), log).nodes).select("doc_id", "html")


@query("range_adjust", _expected("start_id, start_off, end_id, end_off", [(0, "5::BIGINT", 6, "4::BIGINT", 3), (1, "5::BIGINT", 9, "4::BIGINT", 2), (2, "10::BIGINT", 3, "4::BIGINT", 3)]))
def _range_adjust(spark, sf_dir):
    """A range after an insertion, a replacement of data and a split."""
    n = lambda v: F.lit(v).cast("long")
    r = _documents(spark, sf_dir, [BASE] * 3).select(F.col("doc_id").alias("range_id"), "doc_id", n(5).alias("start_id"), F.lit(6).alias("start_off"), n(4).alias("end_id"), F.lit(2).alias("end_off"))
    case = lambda i: r.filter(F.col("doc_id") % 100 == i)
    one = ranges.adjust_inserted(case(0), case(0).select("doc_id", n(4).alias("parent_id"), F.lit(0).alias("at"), F.lit(1).alias("count")))
    two = ranges.adjust_replaced(case(1), case(1).select("doc_id", n(5).alias("node_id"), F.lit(0).alias("at"), F.lit(2).alias("count"), F.lit(5).alias("length")))
    three = ranges.adjust_split(case(2), case(2).select("doc_id", n(5).alias("node_id"), F.lit(3).alias("at"), n(10).alias("new_id"), n(4).alias("parent_id"), F.lit(0).alias("sib_idx")))
    return one.unionByName(two).unionByName(three).drop("range_id")


@query("doctypes", _expected("name, public_id, system_id", [(0, "'html'", "'p'", "'s'"), (1, "'html'", "NULL", "NULL")]))
def _doctypes(spark, sf_dir):
    docs = _documents(spark, sf_dir, ['<!DOCTYPE html PUBLIC "p" "s">', "<!doctype HTML>"])
    return html.parse_pages(docs, "doc_id", "html").filter("kind = 'document_type'").select("doc_id", F.col("local_name").alias("name"), "public_id", "system_id")


@query("attribute_by_namespace", _expected("value", [(0, _quote(NAME))]))
def _attribute_ns(spark, sf_dir):
    nodes = html.parse_pages(_documents(spark, sf_dir, [f'<svg><a xlink:href="{NAME}"></a></svg>']), "doc_id", "html")
    value = fn.get_attribute_ns("http://www.w3.org/1999/xlink", "href")
    return nodes.select("doc_id", value.alias("value")).filter("value is not null")


__all__ = ["BASE", "MARKUP", "PAGES", "REFUSED", "STRUCTURE", "TREES", "VALUES"]
