"""Selectors to plans.

A compound becomes one filter, with a semi or anti join for each part that needs
other nodes.  Combinators are semi joins from left to right, so a node never
appears twice and no list of intermediate matches is built.  Everything stays a
lazy DataFrame; compiling runs nothing, but for ``crossing``, which looks whether a
further shadow tree is reached.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.intervals import containing, enclosing, false_if_null, nearest_ancestor, semi, within
from ..schema import ELEMENT, HTML, KEYS, TEXT
from . import css

# Fixed values of HTML forms.
FORM_CONTROLS = ("button", "input", "select", "textarea", "optgroup", "option", "fieldset")
BARRED_TYPES = ("hidden", "button", "reset", "submit", "image")
TEXT_TYPES = ("text", "search", "url", "tel", "email", "password", "date", "month", "week", "time", "datetime-local", "number")
RANGE_TYPES = ("number", "range", "date", "month", "week", "time", "datetime-local")


def attr(name: str) -> Column:
    """An attribute's value, null if it is missing."""
    return F.try_element_at("attrs", F.lit(name))


def has_attr(name: str) -> Column:
    return attr(name).isNotNull()


def named(*names: str) -> Column:
    return F.col("local_name").isin(*names)


def input_type() -> Column:
    return F.coalesce(F.lower(attr("type")), F.lit("text"))


def anb(position: Column, a: int, b: int) -> Column:
    """Whether position = a*k + b for some k >= 0."""
    if a == 0:
        return position == b
    return ((position - b) % a == 0) & ((position - b) / a >= 0)


def attribute_test(part: css.Attribute) -> Column:
    name = part.name
    if part.namespace == "":
        value = F.get(F.transform(F.filter("attr_list", lambda x: x["url"].isNull() & (x["local"] == name)), lambda x: x["value"]), F.lit(0))
    elif part.namespace == "*":
        value = F.get(F.transform(F.filter("attr_list", lambda x: x["local"] == name), lambda x: x["value"]), F.lit(0))
    else:
        # HTML attribute names are lower case.
        value = attr(name.lower()) if name.lower() == name else F.when(F.col("namespace") == HTML, attr(name.lower())).otherwise(attr(name))
    if part.op is None:
        return value.isNotNull()
    wanted = part.value
    if part.flag == "i":
        value, wanted = F.lower(value), wanted.lower()
    if part.op == "=":
        return value == wanted
    if part.op == "|=":
        return (value == wanted) | value.startswith(wanted + "-")
    if wanted == "" or (part.op == "~=" and any(c in wanted for c in " \t\n\r\f")):
        return F.lit(False)
    if part.op == "~=":
        return F.array_contains(F.split(value, r"[ \t\n\r\f]+"), wanted)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[part.op](wanted)


@F.pandas_udf(T.BooleanType())
def _pattern_fails(pattern: pd.Series, value: pd.Series) -> pd.Series:
    """Whether a value does not match a pattern as a whole; a bad pattern never fails."""
    import regex

    def one(p: str | None, v: str | None) -> bool:
        if p is None or not v:
            return False
        try:
            return regex.fullmatch(p, v) is None
        except regex.error:
            return False

    return pd.Series([one(p, v) for p, v in zip(pattern, value)], dtype="bool")


class Compiler:
    """Compiles against one node table.

    ``scope`` (doc_id, node_id) holds the query's roots: matches are among their
    descendants and ``:scope`` is they.  ``state`` (doc_id, active_element, hover,
    active, fragment) is the documents' interaction state, ``defined`` (doc_id,
    local_name) the registered custom elements.  With ``crossing`` the parent of a
    shadow root's children is the host, as for scopes inside shadow trees.
    """

    def __init__(self, nodes: DataFrame, *, scope: DataFrame | None = None, state: DataFrame | None = None, defined: DataFrame | None = None, crossing: bool = False):
        self.nodes, self.scope, self.state, self.defined, self.crossing = nodes, scope, state, defined, crossing
        self.elements = nodes.filter(F.col("node_type") == ELEMENT)

    # -- lists and combinators

    def select(self, selector: css.SelectorList) -> DataFrame:
        """The rows of ``nodes`` that match any arm, each once."""
        return self.among(self.elements, selector)

    def among(self, rows: DataFrame, selector: css.SelectorList) -> DataFrame:
        """The rows of ``rows`` that match any arm."""
        tests = [self.local(arm) for arm in selector.arms]
        if all(t is not None for t in tests):
            return rows.filter(reduce(lambda a, b: a | b, tests))
        if len(selector.arms) == 1:
            return self.complex(selector.arms[0], rows)
        keys = [self.complex(arm, rows).select("doc_id", "node_id") for arm in selector.arms]
        return semi(rows, reduce(DataFrame.unionByName, keys), [("doc_id", "doc_id"), ("node_id", "node_id")])

    def complex(self, selector: css.Complex, rows: DataFrame | None = None) -> DataFrame:
        """The subjects of a complex selector among ``rows``; its left parts are anywhere in the tree."""
        found = None
        for i, (combinator, compound) in enumerate(selector.steps):
            base = rows if rows is not None and i == len(selector.steps) - 1 else self.elements
            here = self.compound(compound, base)
            found = here if found is None else self.step(found, combinator, here)
        return found

    def step(self, left: DataFrame, combinator: str, right: DataFrame) -> DataFrame:
        """The rows of ``right`` that stand to one of ``left`` as the combinator says."""
        keys = left.select(*KEYS)
        same = [("doc_id", "doc_id"), ("node_id", "node_id")]
        if combinator == " ":
            if not self.crossing:
                return within(right, keys)
            parts, over = [within(right, keys).select("doc_id", "node_id")], keys
            # Shadow trees in one another, until no further one is reached.
            while True:
                covered = within(self.nodes.select(*KEYS, "kind", "host_id"), over, inclusive=True)
                over = self.shadows_of(covered).select(*KEYS)
                if over.isEmpty():
                    break
                parts.append(within(right, over).select("doc_id", "node_id"))
            return semi(right, reduce(DataFrame.unionByName, parts), same)
        if combinator == ">":
            own = semi(right, keys, [("doc_id", "doc_id"), ("parent_id", "node_id")])
            if not self.crossing:
                return own
            hosted = semi(right, self.shadows_of(keys).select("doc_id", "node_id"), [("doc_id", "doc_id"), ("parent_id", "node_id")])
            return semi(right, own.select("doc_id", "node_id").unionByName(hosted.select("doc_id", "node_id")), same)
        if combinator == "+":
            shifted = keys.withColumn("elem_idx", F.col("elem_idx") + 1)
            return semi(right, shifted, [("doc_id", "doc_id"), ("parent_id", "parent_id"), ("elem_idx", "elem_idx")])
        first = keys.groupBy("doc_id", "parent_id").agg(F.min("elem_idx").alias("first"))
        return semi(right, first, [("doc_id", "doc_id"), ("parent_id", "parent_id")], (["first"], F.col("_r_first") < right["elem_idx"]))

    def shadows_of(self, hosts: DataFrame) -> DataFrame:
        """Shadow roots whose host is in ``hosts``."""
        return semi(self.nodes.filter(F.col("kind") == "shadow_root"), hosts.select("doc_id", "node_id"), [("doc_id", "doc_id"), ("host_id", "node_id")])

    def has(self, selector: css.SelectorList, rows: DataFrame) -> DataFrame:
        """The rows of ``rows`` for which a relative selector finds something."""
        parts = []
        for arm in selector.arms:
            # From right to left: what must follow an anchor, down to the anchor.
            found = None
            for k in range(len(arm.steps) - 1, -1, -1):
                combinator, compound = arm.steps[k]
                here = self.compound(compound, self.elements)
                if found is not None:
                    here = self.back(here, arm.steps[k + 1][0], found)
                found = here
            parts.append(self.back(rows, arm.steps[0][0], found).select("doc_id", "node_id"))
        return semi(rows, reduce(DataFrame.unionByName, parts), [("doc_id", "doc_id"), ("node_id", "node_id")])

    def back(self, rows: DataFrame, combinator: str, found: DataFrame) -> DataFrame:
        """The rows of ``rows`` to which one of ``found`` stands as the combinator says."""
        keys = found.select(*KEYS)
        if combinator == " ":
            return containing(rows, keys)
        if combinator == ">":
            return semi(rows, keys, [("doc_id", "doc_id"), ("node_id", "parent_id")])
        if combinator == "+":
            shifted = keys.withColumn("elem_idx", F.col("elem_idx") - 1)
            return semi(rows, shifted, [("doc_id", "doc_id"), ("parent_id", "parent_id"), ("elem_idx", "elem_idx")])
        last = keys.groupBy("doc_id", "parent_id").agg(F.max("elem_idx").alias("latest"))
        return semi(rows, last, [("doc_id", "doc_id"), ("parent_id", "parent_id")], (["latest"], F.col("_r_latest") > rows["elem_idx"]))

    # -- compounds

    def local(self, selector: css.Complex) -> Column | None:
        """A condition on one row, if the selector is no more."""
        if len(selector.steps) != 1:
            return None
        tests = [self.test(p) for p in selector.steps[0][1].parts]
        return None if any(t is None for t in tests) else reduce(lambda a, b: a & b, map(false_if_null, tests))

    def compound(self, compound: css.Compound, rows: DataFrame) -> DataFrame:
        rest = []
        for part in compound.parts:
            test = self.test(part)
            if test is None:
                rest.append(part)
            else:
                rows = rows.filter(false_if_null(test))
        for part in rest:
            rows = self.joined(part, rows)
        return rows

    def test(self, part) -> Column | None:
        """A condition on one row for a part, null if it needs other rows."""
        if isinstance(part, css.Type):
            if part.namespace == "":
                return F.lit(False)
            low = part.name.lower()
            if low == part.name:
                return F.col("local_name") == part.name
            return F.when(F.col("namespace") == HTML, F.col("local_name") == low).otherwise(F.col("local_name") == part.name)
        if isinstance(part, css.Universal):
            return F.lit(part.namespace != "")
        if isinstance(part, css.Id):
            return F.col("id") == part.value
        if isinstance(part, css.Class):
            return F.array_contains("class_tokens", part.value)
        if isinstance(part, css.Attribute):
            return attribute_test(part)
        if isinstance(part, css.PseudoElement):
            return F.lit(False)
        if isinstance(part, css.Nth):
            if part.of is not None:
                return None
            index, count = ("type_idx", "type_cnt") if part.name.endswith("of-type") else ("elem_idx", "elem_cnt")
            position = F.col(count) - F.col(index) + 1 if "last" in part.name else F.col(index)
            return anb(position, part.a, part.b)
        if isinstance(part, css.Logical):
            if part.name not in ("is", "where", "not"):
                return None
            tests = [self.local(arm) for arm in part.selectors.arms]
            if any(t is None for t in tests):
                return None
            any_of = reduce(lambda a, b: a | b, map(false_if_null, tests))
            return ~any_of if part.name == "not" else any_of
        if isinstance(part, css.Has):
            return None
        return self.pseudo(part.name)

    def pseudo(self, name: str) -> Column | None:
        index, count, type_index, type_count = map(F.col, ("elem_idx", "elem_cnt", "type_idx", "type_cnt"))
        checked = F.coalesce("checked", has_attr("checked"))
        tests = {
            "root": lambda: F.col("parent_type").isNull() | (F.col("parent_type") != ELEMENT),
            "empty": lambda: F.col("content_child_cnt") == 0,
            "first-child": lambda: index == 1,
            "last-child": lambda: index == count,
            "only-child": lambda: count == 1,
            "first-of-type": lambda: type_index == 1,
            "last-of-type": lambda: type_index == type_count,
            "only-of-type": lambda: type_count == 1,
            "link": lambda: named("a", "area") & has_attr("href"),
            "any-link": lambda: named("a", "area") & has_attr("href"),
            "required": lambda: named("input", "select", "textarea") & has_attr("required"),
            "optional": lambda: named("input", "select", "textarea") & ~has_attr("required"),
            "checked": lambda: (named("input") & input_type().isin("checkbox", "radio") & checked) | (named("option") & has_attr("selected")),
            "open": lambda: named("details", "dialog") & has_attr("open"),
            "in-range": lambda: self.range_limited() & ~self.out_of_range(),
            "out-of-range": lambda: self.range_limited() & self.out_of_range(),
        }
        if name in tests:
            return tests[name]()
        if name == "defined" and self.defined is None:
            return ~F.col("local_name").contains("-")
        joined = ("disabled", "enabled", "default", "placeholder-shown", "defined", "indeterminate", "valid", "invalid", "read-write", "read-only", "lang", "dir", "host")
        with_state = ("focus", "focus-visible", "focus-within", "hover", "active", "target")
        if name in joined or (name in with_state and self.state is not None) or (name == "scope" and self.scope is not None):
            return None
        return F.lit(False)  # unknown ones match nothing

    @staticmethod
    def range_limited() -> Column:
        return named("input") & input_type().isin(*RANGE_TYPES) & (has_attr("min") | has_attr("max"))

    @staticmethod
    def out_of_range() -> Column:
        number = lambda n: F.expr(f"try_cast(try_element_at(attrs, '{n}') as double)")
        return false_if_null(number("value") < number("min")) | false_if_null(number("value") > number("max"))

    # -- parts that need other rows

    def joined(self, part, rows: DataFrame) -> DataFrame:
        same = [("doc_id", "doc_id"), ("node_id", "node_id")]
        if isinstance(part, css.Has):
            return self.has(part.selectors, rows)
        if isinstance(part, css.Nth):
            matched = self.among(self.elements, part.of)
            order = F.col("pre").desc() if "last" in part.name else F.col("pre").asc()
            ranked = matched.select("doc_id", "node_id", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy(order)).alias("n"))
            return semi(rows, ranked.filter(anb(F.col("n"), part.a, part.b)), same)
        if isinstance(part, css.Logical):
            if part.name == "not":
                return semi(rows, self.among(rows, part.selectors).select("doc_id", "node_id"), same, how="left_anti")
            if part.name in ("is", "where"):
                return self.among(rows, part.selectors)
            hosts = self.hosts()
            if part.name == "host":
                met = self.among(hosts, part.selectors)
            else:
                met = within(hosts, self.among(self.elements, part.selectors).select("doc_id", "root_id", "pre", "last"), inclusive=True)
            return semi(rows, met, same)
        return self.state_or_form(part, rows, same)

    def hosts(self) -> DataFrame:
        """Hosts of the shadow trees that the scope is in; of all shadow trees without a scope."""
        shadows = self.nodes.filter(F.col("kind") == "shadow_root")
        if self.scope is not None:
            inside = semi(self.nodes, self.scope, [("doc_id", "doc_id"), ("node_id", "node_id")])
            shadows = semi(shadows, inside.select("doc_id", F.col("root_id").alias("node_id")), [("doc_id", "doc_id"), ("node_id", "node_id")])
        return semi(self.elements, shadows.select("doc_id", F.col("host_id").alias("node_id")), [("doc_id", "doc_id"), ("node_id", "node_id")])

    def state_or_form(self, part: css.Pseudo, rows: DataFrame, same: list) -> DataFrame:
        name = part.name
        if name == "host":
            return semi(rows, self.hosts(), same)
        if name == "scope":
            return semi(rows, self.scope, same)
        if name in ("focus", "focus-visible"):
            return semi(rows, self.state.select("doc_id", F.col("active_element").alias("node_id")), same)
        if name in ("focus-within", "hover", "active"):
            column = {"focus-within": "active_element"}.get(name, name)
            target = semi(self.nodes, self.state.select("doc_id", F.col(column).alias("node_id")), same)
            return containing(rows, target, inclusive=True)
        if name == "target":
            by = self.state.select("doc_id", "fragment").filter("fragment is not null")
            of = self.elements.join(by, "doc_id").filter((F.col("id") == F.col("fragment")) | (named("a") & (attr("name") == F.col("fragment"))))
            first = of.groupBy("doc_id").agg(F.min_by("node_id", F.struct((F.coalesce(F.col("id") != F.col("fragment"), F.lit(True))).alias("by_name"), "pre")).alias("node_id"))
            return semi(rows, first, same)
        if name == "defined":
            known = semi(rows.filter(F.col("local_name").contains("-")), self.defined, [("doc_id", "doc_id"), ("local_name", "local_name")])
            return semi(rows, known.select("doc_id", "node_id").unionByName(rows.filter(~F.col("local_name").contains("-")).select("doc_id", "node_id")), same)
        if name == "disabled":
            return semi(rows, self.disabled(), same)
        if name == "enabled":
            return semi(rows.filter(named(*FORM_CONTROLS)), self.disabled(), same, how="left_anti")
        if name in ("read-write", "read-only"):
            return semi(rows, self.read_write(), same, how="left_semi" if name == "read-write" else "left_anti")
        if name == "placeholder-shown":
            held = rows.filter(has_attr("placeholder"))
            empty_input = held.filter(named("input") & (F.coalesce(attr("value"), F.lit("")) == ""))
            empty_area = self.control_values(held.filter(named("textarea"))).filter(F.coalesce("_value", F.lit("")) == "")
            return semi(rows, empty_input.select("doc_id", "node_id").unionByName(empty_area.select("doc_id", "node_id")), same)
        if name == "default":
            chosen = rows.filter((named("input") & has_attr("checked")) | (named("option") & has_attr("selected")))
            return semi(rows, chosen.select("doc_id", "node_id").unionByName(self.default_buttons()), same)
        if name == "indeterminate":
            group = self.elements.filter(named("input") & (input_type() == "radio")).groupBy("doc_id", attr("name").alias("name")).agg(
                F.max(F.coalesce("checked", has_attr("checked"))).alias("any"))
            radios = rows.filter(named("input") & (input_type() == "radio")).withColumn("_name", attr("name"))
            open_groups = group.filter(~F.col("any")).select(F.col("doc_id").alias("_d"), F.col("name").alias("_n"))
            loose = radios.join(open_groups, (F.col("doc_id") == F.col("_d")) & F.col("_name").eqNullSafe(F.col("_n")), "left_semi")
            alone = rows.filter((named("input") & (input_type() == "checkbox") & F.coalesce("indeterminate", F.lit(False))) | (named("progress") & ~has_attr("value")))
            return semi(rows, loose.select("doc_id", "node_id").unionByName(alone.select("doc_id", "node_id")), same)
        if name in ("valid", "invalid"):
            candidates = semi(rows.filter((named("input") & ~input_type().isin(*BARRED_TYPES)) | named("select", "textarea")), self.disabled(), same, how="left_anti")
            v = F.coalesce("_value", F.lit(""))
            kind = input_type()
            wrong = (
                (has_attr("required") & (v == ""))
                | ((v != "") & (kind == "email") & ~v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
                | ((v != "") & (kind == "url") & ~v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"))
                | (self.range_limited() & self.out_of_range())
            )
            valued = self.control_values(candidates).withColumn("_bad", false_if_null(wrong))
            # Only controls with a pattern go through Python.
            checked = valued.filter(has_attr("pattern")).withColumn("_bad", F.col("_bad") | _pattern_fails(attr("pattern"), F.col("_value")))
            both = checked.unionByName(valued.filter(~has_attr("pattern")))
            return semi(rows, both.filter(F.col("_bad") if name == "invalid" else ~F.col("_bad")).select("doc_id", "node_id"), same)
        if name == "lang":
            carried = nearest_ancestor(rows, self.elements.filter(has_attr("lang")).withColumn("_lang", attr("lang")), "_lang", "_found")
            value = F.lower("_found")
            met = reduce(lambda a, b: a | b, [(value == w.lower()) | value.startswith(w.lower() + "-") for w in part.arguments] or [F.lit(False)])
            return carried.filter(false_if_null(met)).select(*rows.columns)
        if name == "dir":
            wanted = part.arguments[0] if part.arguments else ""
            if wanted not in ("ltr", "rtl"):
                return rows.filter(F.lit(False))
            carried = nearest_ancestor(rows, self.elements.filter(has_attr("dir")).withColumn("_dir", attr("dir")), "_dir", "_found")
            return carried.filter(false_if_null(F.lower("_found") == wanted)).select(*rows.columns)
        return rows.filter(F.lit(False))

    def control_values(self, controls: DataFrame) -> DataFrame:
        """``controls`` with _value: the text of a textarea's children, else the attribute."""
        texts = self.nodes.filter(F.col("node_type") == TEXT).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("_text"))
        areas = controls.filter(named("textarea")).join(texts, ["doc_id", "node_id"], "left").withColumn("_value", F.coalesce("_text", F.lit(""))).drop("_text")
        return areas.unionByName(controls.filter(~named("textarea")).withColumn("_value", attr("value")).select(*areas.columns))

    def disabled(self) -> DataFrame:
        """Keys of the controls that are disabled, by themselves, an option group or a fieldset."""
        own = self.elements.filter(named(*FORM_CONTROLS) & has_attr("disabled"))
        groups = self.elements.filter(named("optgroup") & has_attr("disabled"))
        options = within(self.elements.filter(named("option")), groups.select(*KEYS))
        sets = self.elements.filter(named("fieldset") & has_attr("disabled"))
        first = Window.partitionBy("doc_id", "parent_id").orderBy("pre")
        legends = semi(
            self.elements.filter(named("legend")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"),
            sets.select("doc_id", "node_id"), [("doc_id", "doc_id"), ("parent_id", "node_id")])
        # A control counts the disabled fieldsets around it that do not hold it in
        # their first legend: open fieldsets less open first legends.
        subset = self.elements.filter(named("button", "input", "select", "textarea", "fieldset"))
        edges = sets.select("doc_id", "root_id", F.col("pre").alias("at"), F.lit(1).alias("d")).unionByName(
            sets.select("doc_id", "root_id", F.col("last").alias("at"), F.lit(-1).alias("d")).withColumn("at", F.col("at") + 0.5)).unionByName(
            legends.select("doc_id", "root_id", F.col("pre").alias("at"), F.lit(-1).alias("d"))).unionByName(
            legends.select("doc_id", "root_id", F.col("last").alias("at"), F.lit(1).alias("d")).withColumn("at", F.col("at") + 0.5))
        rows = subset.select("doc_id", "root_id", F.col("pre").cast("double").alias("at"), F.lit(0).alias("d"), "node_id")
        order = Window.partitionBy("doc_id", "root_id").orderBy("at", F.col("node_id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
        both = rows.unionByName(edges.withColumn("at", F.col("at").cast("double")), allowMissingColumns=True)
        inside = both.withColumn("_open", F.coalesce(F.sum("d").over(order), F.lit(0))).filter("node_id is not null and _open > 0")
        return own.select("doc_id", "node_id").unionByName(options.select("doc_id", "node_id")).unionByName(inside.select("doc_id", "node_id")).distinct()

    def read_write(self) -> DataFrame:
        same = [("doc_id", "doc_id"), ("node_id", "node_id")]
        fields = self.elements.filter((named("textarea") | (named("input") & input_type().isin(*TEXT_TYPES))) & ~has_attr("readonly"))
        mutable = semi(fields, self.disabled(), same, how="left_anti").select("doc_id", "node_id")
        hosts = self.elements.filter(has_attr("contenteditable")).withColumn("_edit", F.lower(attr("contenteditable")))
        others = nearest_ancestor(self.elements.filter(~named("input", "textarea")), hosts, "_edit", "_found")
        return mutable.unionByName(others.filter("_found is not null and _found <> 'false'").select("doc_id", "node_id"))

    def default_buttons(self) -> DataFrame:
        """The first submit control of every form."""
        submits = self.elements.filter(
            (named("button") & F.coalesce(attr("type") == "submit", F.lit(True))) | (named("input") & input_type().isin("submit", "image")))
        forms = self.elements.filter(named("form")).withColumn("_form", F.col("node_id"))
        owned = nearest_ancestor(submits, forms, "_form", "_of", inclusive=False).filter("_of is not null")
        # The first of all descendants of the form, nested forms' included.
        inner = nearest_first(submits, forms)
        return semi(owned, inner, [("doc_id", "doc_id"), ("node_id", "node_id"), ("_of", "form")]).select("doc_id", "node_id")


def nearest_first(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(doc_id, form, node_id): the first of ``nodes`` within each of ``scopes``."""
    met = enclosing(nodes.select("doc_id", "root_id", "node_id", "pre"), scopes, {"form": F.col("node_id")}, inclusive=False)
    return met.groupBy("doc_id", "form").agg(F.min_by("node_id", "pre").alias("node_id"))


def query_selector_all(nodes: DataFrame, selector: str, *, scope: DataFrame | None = None, state: DataFrame | None = None, defined: DataFrame | None = None, crossing: bool = False) -> DataFrame:
    """The nodes that match ``selector``, each once; with ``scope``, among its descendants.

    Order by (doc_id, pre) for document order; it is left to the sink.
    """
    c = Compiler(nodes, scope=scope, state=state, defined=defined, crossing=crossing)
    ast = css.parse(selector)
    if scope is None:
        return c.select(ast)
    roots = semi(nodes, scope, [("doc_id", "doc_id"), ("node_id", "node_id")])
    return within(c.select(ast), roots.select("doc_id", "root_id", "pre", "last"))


def query_selector(nodes: DataFrame, selector: str, **how) -> DataFrame:
    """The first match in document order of each document."""
    found = query_selector_all(nodes, selector, **how)
    first = found.groupBy("doc_id").agg(F.min_by("node_id", "pre").alias("node_id"))
    return semi(found, first, [("doc_id", "doc_id"), ("node_id", "node_id")])


def matches(nodes: DataFrame, selector: str, **how) -> DataFrame:
    """``nodes`` with a boolean column ``matches``."""
    found = Compiler(nodes, **how).select(css.parse(selector)).select("doc_id", "node_id", F.lit(True).alias("matches"))
    return nodes.join(found, ["doc_id", "node_id"], "left").withColumn("matches", F.coalesce("matches", F.lit(False)))


def closest(nodes: DataFrame, selector: str, **how) -> DataFrame:
    """(doc_id, node_id, closest): each element's nearest match among itself and its ancestors."""
    c = Compiler(nodes, **how)
    found = c.select(css.parse(selector)).withColumn("_id", F.col("node_id"))
    return nearest_ancestor(c.elements, found, "_id", "closest").select("doc_id", "node_id", "closest")
