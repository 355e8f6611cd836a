"""Column functions: node projections, escaping, character data, token lists, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ATTRIBUTE_NAMESPACES

# Elements without an end tag, and those whose text is not escaped.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW_TEXT = ("style", "script", "xmp", "iframe", "noembed", "noframes", "plaintext")


# -- projections


def node_name() -> Column:
    """nodeName: elements in upper case if HTML, fixed names for the others."""
    html = F.col("namespace").isNull() | (F.col("namespace") == "http://www.w3.org/1999/xhtml")
    return (
        F.when(F.col("kind") == "element", F.when(html, F.upper("local_name")).otherwise(F.col("local_name")))
        .when(F.col("kind") == "document_type", F.col("local_name"))
        .when(F.col("kind") == "shadow_root", F.lit("#document-fragment"))
        .otherwise(F.concat(F.lit("#"), F.translate("kind", "_", "-")))
    )


def get_attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has_attribute(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))


def attribute_names() -> Column:
    """Qualified names in order of insertion."""
    return F.transform("attr_list", lambda a: a["qname"])


def get_attribute_ns(url: str | None, local: str) -> Column:
    found = F.filter("attr_list", lambda a: a["url"].eqNullSafe(F.lit(url).cast("string")) & (a["local"] == local))
    return F.get(F.transform(found, lambda a: a["value"]), F.lit(0))


def lookup_namespace_uri() -> Column:
    """Always null in HTML documents."""
    return F.lit(None).cast("string")


lookup_prefix = lookup_namespace_uri


def focusable() -> Column:
    """Whether an element can take the focus."""
    control = F.col("local_name").isin("button", "input", "select", "textarea") & ~has_attribute("disabled")
    hidden = (F.col("local_name") == "input") & (F.coalesce(F.lower(get_attribute("type")), F.lit("")) == "hidden")
    link = F.col("local_name").isin("a", "area") & has_attribute("href")
    edit = F.coalesce(F.lower(get_attribute("contenteditable")) != "false", F.lit(False))
    return F.coalesce((control & ~hidden) | link | has_attribute("tabindex") | edit | (F.col("local_name") == "summary"), F.lit(False)) & (F.col("node_type") == 1)


def shown(mask: Column | int) -> Column:
    """Whether the bit of a node's type is in a whatToShow mask."""
    mask = F.lit(mask) if isinstance(mask, int) else mask
    return mask.cast("long").bitwiseAND(F.expr("shiftleft(1L, node_type - 1)")) != 0


def show_mask(*node_types: int) -> int:
    return sum(1 << (t - 1) for t in set(node_types))


SHOW_ALL = 0xFFFFFFFF


# -- text


def escape_text(value: Column) -> Column:
    """Text as it is written in HTML; & first."""
    for a, b in (("&", "&amp;"), (" ", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def escape_attribute(value: Column) -> Column:
    for a, b in (("&", "&amp;"), (" ", "&nbsp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def start_tag() -> Column:
    attributes = F.transform("attr_list", lambda a: F.concat(F.lit(" "), a["qname"], F.lit('="'), escape_attribute(a["value"]), F.lit('"')))
    return F.concat(F.lit("<"), F.col("local_name"), F.array_join(F.coalesce(attributes, F.array().cast("array<string>")), ""), F.lit(">"))


def end_tag() -> Column:
    return F.when(F.col("local_name").isin(*VOID), F.lit("")).otherwise(F.concat(F.lit("</"), F.col("local_name"), F.lit(">")))


def length(value: Column) -> Column:
    """Code points of character data."""
    return F.char_length(value)


def _checked(value: Column, offset: Column, result: Column) -> Column:
    bad = (offset > F.char_length(value)) | (offset < 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("index size: offset "), offset.cast("string")))).otherwise(result)


def _column(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def substring_data(value: Column, offset: Column | int, count: Column | int) -> Column:
    """``count`` code points from ``offset``; an offset past the end is an error."""
    offset, count = _column(offset), _column(count)
    return _checked(value, offset, F.substring(value, offset + 1, count))


def replace_data(value: Column, offset: Column | int, count: Column | int, data: Column | str) -> Column:
    offset, count, data = _column(offset), _column(count), _column(data)
    n = F.char_length(value)
    end = F.least(offset + count, n)
    return _checked(value, offset, F.concat(F.substring(value, F.lit(1), offset), data, F.substring(value, end + 1, F.greatest(n - end, F.lit(0)))))


def insert_data(value: Column, offset: Column | int, data: Column | str) -> Column:
    return replace_data(value, offset, 0, data)


def delete_data(value: Column, offset: Column | int, count: Column | int) -> Column:
    return replace_data(value, offset, count, "")


def append_data(value: Column, data: Column | str) -> Column:
    return F.concat(value, _column(data))


# -- token lists


def tokens(value: Column) -> Column:
    """Distinct tokens of a space-separated list, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(value, F.lit("")), r"[ \t\n\f\r]+"), lambda t: t != ""))


def token_add(list_: Column, *new: str) -> Column:
    return F.array_union(list_, F.array(*map(F.lit, new)))


def token_remove(list_: Column, *gone: str) -> Column:
    return F.filter(list_, lambda t: ~t.isin(*gone))


def token_toggle(list_: Column, token: str, force: bool | None = None) -> Column:
    there = F.array_contains(list_, token)
    added, removed = token_add(list_, token), token_remove(list_, token)
    return F.when(there, list_ if force else removed).otherwise(list_ if force is False else added)


def token_replace(list_: Column, old: str, new: str) -> Column:
    return F.when(F.array_contains(list_, old), F.array_distinct(F.transform(list_, lambda t: F.when(t == old, new).otherwise(t)))).otherwise(list_)


def token_item(list_: Column, index: int) -> Column:
    return F.get(list_, F.lit(index))


def token_length(list_: Column) -> Column:
    return F.size(list_)


def token_contains(list_: Column, token: str) -> Column:
    return F.array_contains(list_, token)


def token_text(list_: Column) -> Column:
    return F.array_join(list_, " ")


# -- names


def split_qname(qname: Column) -> Column:
    """(prefix, local) of a qualified name."""
    at = F.instr(qname, ":")
    return F.struct(
        F.when(at > 1, F.substring(qname, F.lit(1), at - 1)).alias("prefix"),
        F.when(at > 1, F.substring(qname, at + 1, F.char_length(qname))).otherwise(qname).alias("local"),
    )


def attribute_namespace(prefix: Column) -> Column:
    """The namespace of an attribute's prefix."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ATTRIBUTE_NAMESPACES.items() for x in kv]), prefix)


def anb(position: Column, a: int, b: int) -> Column:
    """Whether position = a*k + b for some k >= 0."""
    from ..plans.compile import anb as test

    return test(position, a, b)
