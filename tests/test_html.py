"""Tokenizer and tree construction after the HTML standard; outlines written for these tests."""

from __future__ import annotations

import pytest

from treeloom.sources import html, tokenizer
from treeloom.sources.entities import unescape
from treeloom.sources.tokenizer import Characters, Comment, Doctype, EndTag, StartTag, fragment_tokens, tokenize
from treeloom.sources.tree_builder import Node, outline, parse, parse_fragment


@pytest.mark.parametrize("html, tokens", [
    ("a<b c=d>e</b>", [Characters("a"), StartTag("b", [("c", "d")]), Characters("e"), EndTag("b")]),
    ("<A B='1' b=2 C>", [StartTag("a", [("b", "1"), ("c", "")])]),
    ("<br/>", [StartTag("br", [], True)]),
    ("<!--x--><!-->y", [Comment("x"), Comment(""), Characters("y")]),
    ("<!DOCTYPE html>", [Doctype("html")]),
    ('<!doctype html PUBLIC "a" "b">', [Doctype("html", "a", "b")]),
    ("<script><b></script>", [StartTag("script"), Characters("<b>"), EndTag("script")]),
    ("<title>&lt;<b></title>", [StartTag("title"), Characters("<<b>"), EndTag("title")]),
    ("<style>&lt;</style>", [StartTag("style"), Characters("&lt;"), EndTag("style")]),
    ("<?x><!y></ z>", [Comment("?x"), Comment("y"), Comment(" z")]),
    ("<a", []), ("1<2", [Characters("1<2")]), ("</>x", [Characters("x")]), ("a\r\nb\rc", [Characters("a\nb\nc")]),
    ("<a href=x?a=1&lt=2&lt;>", [StartTag("a", [("href", "x?a=1&lt=2<")])]),
])
def test_tokens(html, tokens):  # noqa: F811
    assert tokenize(html) == tokens


@pytest.mark.parametrize("text, out", [
    ("&amp;&lt;&copy;", "&<©"), ("&notit;", "¬it;"), ("&notin;", "∉"), ("&#65;&#x42;", "AB"), ("&#128;", "€"), ("&#0;", "�"), ("&#x110000;", "�"), ("&unknown;", "&unknown;"), ("&", "&"), ("&amp", "&"),
])
def test_references(text, out):
    assert unescape(text) == out


def test_fragment_tokens():
    assert fragment_tokens("a&amp;<b>", "title") == [Characters("a&<b>")]
    assert fragment_tokens("a&amp;<b>", "style") == [Characters("a&amp;<b>")]


CASES = {
    "x": '<html>\n  <head>\n  <body>\n    "x"',
    "<p>1<p>2": '<html>\n  <head>\n  <body>\n    <p>\n      "1"\n    <p>\n      "2"',
    "<b>1<i>2</b>3</i>": '<html>\n  <head>\n  <body>\n    <b>\n      "1"\n      <i>\n        "2"\n    <i>\n      "3"',
    "<b><p>1</b>2": '<html>\n  <head>\n  <body>\n    <b>\n    <p>\n      <b>\n        "1"\n      "2"',
    "<table>x<td>y": '<html>\n  <head>\n  <body>\n    "x"\n    <table>\n      <tbody>\n        <tr>\n          <td>\n            "y"',
    "<ul><li>a<li>b</ul>": '<html>\n  <head>\n  <body>\n    <ul>\n      <li>\n        "a"\n      <li>\n        "b"',
    "<title>t</title><p>x": '<html>\n  <head>\n    <title>\n      "t"\n  <body>\n    <p>\n      "x"',
    "<svg viewbox=1><lineargradient/><p>x": '<html>\n  <head>\n  <body>\n    <svg svg>\n      viewBox="1"\n      <svg linearGradient>\n    <p>\n      "x"',
    "<math><mi>x</mi></math>y": '<html>\n  <head>\n  <body>\n    <math math>\n      <math mi>\n        "x"\n    "y"',
    "<template><td>x</template>": '<html>\n  <head>\n    <template>\n      content\n        <td>\n          "x"\n  <body>',
    "<frameset><frame></frameset>": "<html>\n  <head>\n  <frameset>\n    <frame>",
    "<a href=1>x<a href=2>y": '<html>\n  <head>\n  <body>\n    <a>\n      href="1"\n      "x"\n    <a>\n      href="2"\n      "y"',
    "<p>a</p></body><!--c-->": '<html>\n  <head>\n  <body>\n    <p>\n      "a"\n  <!-- c -->',
    "<select><option>1<option>2</select>": '<html>\n  <head>\n  <body>\n    <select>\n      <option>\n        "1"\n      <option>\n        "2"',
    "<dl><dt>a<dd>b": '<html>\n  <head>\n  <body>\n    <dl>\n      <dt>\n        "a"\n      <dd>\n        "b"',
    "</p>x</p></br>": '<html>\n  <head>\n  <body>\n    "x"\n    <p>\n    <br>',
    "<table><form><tr><td></form>": "<html>\n  <head>\n  <body>\n    <table>\n      <form>\n      <tbody>\n        <tr>\n          <td>",
    "<pre>\n\nx": '<html>\n  <head>\n  <body>\n    <pre>\n      "\nx"',
}


@pytest.mark.parametrize("html", CASES)
def test_trees(html):
    got = "\n".join(line[2:] if line.startswith("| ") else line for line in outline(parse(html)).split("\n"))
    assert got == CASES[html]


def _fragment(html, context):
    root = Node("document_fragment")
    for n in parse_fragment(html, context):
        root.append(n)
    return outline(root)


def test_fragments():
    assert _fragment("<td>x", "tr") == '| <td>\n|   "x"'
    assert _fragment("<td>x", "div") == '| "x"'
    assert _fragment("<b>x", "textarea") == '| "<b>x"'
    assert _fragment("<circle/>", "svg svg") == "| <svg circle>"


@pytest.mark.parametrize("html", ["<" * 300, "<b>" * 200 + "<p>" * 200 + "</b>" * 200, "<table>" * 50 + "x", "\0<p>\0", "<svg><![CDATA[x]]>", "<!DOCTYPE", "<script><!--<script>", ""])
def test_odd_input_ends(html):
    parse(html)


def test_parse_pages(spark):
    from treeloom.checks import check_nodes
    from treeloom.operators import text
    from treeloom.sources.html import parse_pages

    pages = spark.createDataFrame([(1, "<p>a<b>b</b>&amp;"), (2, None), (3, ""), (4, "<template><p>x</template>")], "page_id long, html string")
    nodes = parse_pages(pages).cache()
    assert check_nodes(nodes).count() == 0
    assert {r[0] for r in nodes.select("doc_id").distinct().collect()} == {1, 3, 4}
    docs = nodes.filter("kind = 'document'").select("doc_id", "node_id")
    out = {r["doc_id"]: r["html"] for r in text.inner_html(nodes, docs).collect()}
    assert out[1] == "<html><head></head><body><p>a<b>b</b>&amp;</p></body></html>"
    nodes.unpersist()


def test_parse_distinct_expands_to_every_row(spark):
    texts = ["<p>a", "<p>b", "<p>a", None, "", "<p>a"]
    rows = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)] + [(None, "<p>z")], "page_id long, html string")
    nodes, members = html.parse_distinct(rows)
    got = members.join(nodes.withColumnRenamed("doc_id", "parsed_id"), "parsed_id").select("doc_id", "node_id", "kind", "local_name", "value")
    want = html.parse_pages(rows.filter("page_id is not null")).select("doc_id", "node_id", "kind", "local_name", "value")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {tuple(r) for r in members.collect()} == {(10, 10), (11, 11), (12, 10), (14, 14), (15, 10)}


def test_plain_tags_read_like_any_other():
    for text in ("<a b=c d>", "<A B='x' b=y>", '<a b="" c=/d/>', "<br a=b/>", "<a b = c>", "<a\nb=1\tc>", "<a =b>", "<a b=c&amp;d>", "<a b='&lt'>", "</a >", "</a b>", "<a1 x-y:z=1>", "<a b=>", "<a b"):
        fast = list(tokenizer.tokenize(text))
        slow = tokenizer.Tokenizer(text)
        attrs, closing, end = ([], False, -1) if text.startswith("</") else slow._attributes(slow._name(1)[1]) if slow._name(1)[1] >= 0 else ([], False, -1)
        if text.startswith("</"):
            assert fast == [tokenizer.EndTag("a")]
        elif end < 0:
            assert fast == []
        else:
            assert fast == [tokenizer.StartTag(slow._name(1)[0], attrs, closing)], text
