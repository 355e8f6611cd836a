"""Ranges: a table (range_id, doc_id, start_id, start_off, end_id, end_off).

A boundary point has a place in tree order, a struct (pos, kind, inner, offset):
before the child at its offset, or, within text, after the text's own start.
Points compare as their structs, deeper containers first where they end together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TEXT
from ..session import merged

POINT = "struct<root: bigint, pos: bigint, kind: int, inner: int, off: int>"


def boundary_points(nodes: DataFrame, points: DataFrame, node: str, offset: str, out: str) -> DataFrame:
    """``points`` (with doc_id, ``node``, ``offset``) with ``out``: the place of each boundary point."""
    n = nodes.select("doc_id", F.col("node_id").alias(node), F.col("root_id").alias("_root"), F.col("pre").alias("_pre"), F.col("last").alias("_last"), F.col("depth").alias("_depth"), F.col("node_type").alias("_type"))
    child = nodes.filter("parent_id is not null").select("doc_id", F.col("parent_id").alias(node), F.col("sib_idx").alias(offset), F.col("pre").alias("_child"))
    joined = points.join(merged(n), ["doc_id", node], "left").join(merged(child.withColumn(offset, F.col(offset).cast(dict(points.dtypes)[offset]))), ["doc_id", node, offset], "left")
    text = F.col("_type").isin(TEXT, 8)
    place = F.struct(
        F.col("_root").alias("root"), F.when(text, F.col("_pre")).otherwise(F.coalesce("_child", F.col("_last") + 1)).alias("pos"),
        F.when(text, 1).otherwise(0).alias("kind"), F.when(text, 0).otherwise(-F.col("_depth")).cast("int").alias("inner"), F.when(text, F.col(offset)).otherwise(0).cast("int").alias("off"))
    return joined.select(*points.columns, F.when(F.col("_pre").isNotNull(), place).cast(POINT).alias(out))


def order_of(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null for points of different trees."""
    strip = lambda p: F.struct(p["pos"], p["kind"], p["inner"], p["off"])
    return F.when(a["root"] == b["root"], F.when(strip(a) < strip(b), -1).when(strip(a) > strip(b), 1).otherwise(0))


def with_points(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` with the places start and end.

    Both ends of all ranges are looked up together, in one plan for both; equal ranges are looked up once.
    """
    columns = ranges.columns
    sides = ("start", "end")
    ends = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"{s}_id").cast("long").alias("id"), F.col(f"{s}_off").cast("int").alias("off")) for i, s in enumerate(sides)])
    own = [c for c in columns if c != "doc_id"]
    points = ranges.select("doc_id", F.struct(*own).alias("_range"), F.explode(ends).alias("_end")).select("doc_id", "_range", F.col("_end.side").alias("_side"), F.col("_end.id").alias("_node"), F.col("_end.off").alias("_off"))
    placed = boundary_points(nodes, points, "_node", "_off", "_place")
    met = placed.groupBy("doc_id", "_range").agg(F.count_if(F.col("_side") == 0).alias("_n"), *[F.max(F.when(F.col("_side") == i, F.col("_place"))).alias(s) for i, s in enumerate(sides)])
    # Rows that are equal in all columns come back as often as they were.
    return met.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_range.{c}").alias(c) for c in columns], *sides)


def create_range(nodes: DataFrame) -> DataFrame:
    """A collapsed range at the start of each document."""
    docs = nodes.filter(F.col("kind") == "document")
    zero = F.lit(0)
    return docs.select(F.col("doc_id").alias("range_id"), "doc_id", F.col("node_id").alias("start_id"), zero.alias("start_off"), F.col("node_id").alias("end_id"), zero.alias("end_off"))


def set_boundary(nodes: DataFrame, ranges: DataFrame, to: DataFrame, *, end: bool = False) -> DataFrame:
    """``ranges`` with start (or end) at ``to`` (range_id, to_id, to_off); the other follows if they would cross."""
    moved = ranges.join(to, "range_id")
    own, other = ("end", "start") if end else ("start", "end")
    moved = moved.withColumns({f"{own}_id": F.col("to_id"), f"{own}_off": F.col("to_off")}).select(*ranges.columns)
    placed = with_points(nodes, moved)
    crossed = F.coalesce(order_of(F.col("start"), F.col("end")) > 0, F.lit(True))
    return placed.withColumns({f"{other}_id": F.when(crossed, F.col(f"{own}_id")).otherwise(F.col(f"{other}_id")), f"{other}_off": F.when(crossed, F.col(f"{own}_off")).otherwise(F.col(f"{other}_off"))}).select(*ranges.columns)


def collapse(ranges: DataFrame, *, to_start: bool = False) -> DataFrame:
    a, b = ("end", "start") if to_start else ("start", "end")
    return ranges.withColumns({f"{a}_id": F.col(f"{b}_id"), f"{a}_off": F.col(f"{b}_off")})


def is_collapsed() -> Column:
    return (F.col("start_id") == F.col("end_id")) & (F.col("start_off") == F.col("end_off"))


def select_nodes(nodes: DataFrame, keys: DataFrame, *, contents: bool = False) -> DataFrame:
    """Ranges (range_id = node_id) around each node of ``keys``, or around its contents."""
    from .axes import rows_of

    own = rows_of(nodes, keys)
    if contents:
        kids = nodes.filter("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_n"))
        n = F.when(F.col("node_type").isin(TEXT, 8), F.char_length("value")).otherwise(F.coalesce("_n", F.lit(0))).cast("int")
        own = own.join(kids, ["doc_id", "node_id"], "left")
        return own.select(F.col("node_id").alias("range_id"), "doc_id", F.col("node_id").alias("start_id"), F.lit(0).alias("start_off"), F.col("node_id").alias("end_id"), n.alias("end_off"))
    return own.filter("parent_id is not null").select(
        F.col("node_id").alias("range_id"), "doc_id", F.col("parent_id").alias("start_id"), F.col("sib_idx").alias("start_off"), F.col("parent_id").alias("end_id"), (F.col("sib_idx") + 1).alias("end_off"))


#: For each ``how``, the boundary of the first and of the other range that are compared.
HOW = {"start_to_start": ("start", "start"), "start_to_end": ("end", "start"), "end_to_end": ("end", "end"), "end_to_start": ("start", "end")}


def compare_boundary_points(nodes: DataFrame, ranges: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """``pairs`` (range_id, other_id) with ``order``: -1, 0, 1; null in different trees."""
    mine, other = HOW[how]
    # Only the ends that are compared are placed.
    at = lambda side: boundary_points(nodes, ranges.select("range_id", "doc_id", f"{side}_id", f"{side}_off"), f"{side}_id", f"{side}_off", "_at")
    a = at(mine).select("range_id", F.col("_at").alias("_a"))
    b = at(other).select(F.col("range_id").alias("other_id"), F.col("_at").alias("_b"))
    return pairs.join(a, "range_id").join(b, "other_id").select(*pairs.columns, order_of(F.col("_a"), F.col("_b")).alias("order"))


def compare_point(nodes: DataFrame, ranges: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (range_id, doc_id, node_id, off) with ``order``: -1 before, 0 in, 1 after the range; range ids are unique."""
    # Ends and points are looked up together, as each lookup shuffles all nodes; a range's ends and points meet in one window.
    side = lambda i, n, o: F.struct(F.lit(i).alias("_side"), F.col(n).cast("long").alias("_node"), F.col(o).cast("long").alias("_off"))
    own = points.select("range_id", "doc_id", side(2, "node_id", "off").alias("_end"), F.struct(*points.columns).alias("_point"))
    ends = ranges.select("range_id", "doc_id", F.explode(F.array(side(0, "start_id", "start_off"), side(1, "end_id", "end_off"))).alias("_end"))
    both = own.unionByName(ends, allowMissingColumns=True).filter("range_id is not null").select("range_id", "doc_id", "_end.*", "_point")
    of = Window.partitionBy("range_id")
    end = lambda i, c: F.max(F.when(F.col("_side") == i, c)).over(of)
    placed = boundary_points(nodes, both, "_node", "_off", "_at").withColumns({"_start": end(0, F.col("_at")), "_stop": end(1, F.col("_at")), "_known": end(0, F.lit(True))})
    before, after = order_of(F.col("_at"), F.col("_start")), order_of(F.col("_at"), F.col("_stop"))
    return placed.filter("_side = 2 and _known").select(*[F.col(f"_point.{c}").alias(c) for c in points.columns], F.when(before < 0, -1).when(after > 0, 1).when(before.isNotNull(), 0).alias("order"))


def covered(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes that a range holds: range_id and the node's columns, ``part`` (full, partial) and ``text``.

    A text cut by a boundary is partial, and text is the part inside; an element
    with a boundary inside is partial.
    """
    r = with_points(nodes, ranges).select("range_id", F.col("doc_id").alias("_d"), "start", "end", "start_id", "start_off", "end_id", "end_off")
    is_text = F.col("node_type").isin(TEXT, 8)
    inside = (F.col("pre") >= F.col("start.pos")) & (F.col("pre") <= F.col("end.pos"))
    met = nodes.join(merged(r), (F.col("doc_id") == F.col("_d")) & (F.col("root_id") == F.col("start.root")) & (inside | ((F.col("pre") < F.col("start.pos")) & (F.col("last") >= F.col("start.pos")) & (F.col("last") < F.col("end.pos")))))
    a = F.when(F.col("node_id") == F.col("start_id"), F.col("start_off")).otherwise(0)
    b = F.when(F.col("node_id") == F.col("end_id"), F.col("end_off")).otherwise(F.char_length("value"))
    cut = F.substring("value", a + 1, F.greatest(b - a, F.lit(0)))
    ends_before = (F.col("last") < F.col("end.pos"))
    full = F.when(is_text, (F.col("node_id") != F.col("start_id")) & (F.col("node_id") != F.col("end_id")) & ends_before).otherwise((F.col("pre") >= F.col("start.pos")) & ends_before & (F.col("start.kind") == 0) | (F.col("pre") > F.col("start.pos")) & ends_before)
    out = met.select("range_id", *nodes.columns, F.when(full, "full").otherwise("partial").alias("part"), F.when(is_text, cut).alias("text"))
    return out.filter(F.when(is_text, (F.col("part") == "full") | (F.col("text") != "")).otherwise(True))


def to_text(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, text): the text inside each range, in order."""
    texts = covered(nodes, ranges).filter(F.col("node_type") == TEXT)
    found = texts.groupBy("range_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "").alias("text"))
    return ranges.select("range_id").join(merged(found), "range_id", "left").select("range_id", F.coalesce("text", F.lit("")).alias("text"))


def delete_contents(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``nodes`` without what the ranges hold, numbered anew; cut texts keep what is outside.  Ranges of a document must not overlap."""
    from .edits import renumber
    from .intervals import semi

    held = covered(nodes, ranges)
    full = held.filter("part = 'full'").select("doc_id", "node_id")
    r = ranges.select("doc_id", "start_id", "start_off", "end_id", "end_off")
    heads = r.select("doc_id", F.col("start_id").alias("node_id"), F.col("start_off").alias("_from"))
    tails = r.select("doc_id", F.col("end_id").alias("node_id"), F.col("end_off").alias("_to"))
    is_text = F.col("node_type").isin(TEXT, 8)
    left = semi(nodes, full, [("doc_id", "doc_id"), ("node_id", "node_id")], how="left_anti").join(heads, ["doc_id", "node_id"], "left").join(tails, ["doc_id", "node_id"], "left")
    n = F.char_length("value")
    kept = F.concat(F.substring("value", F.lit(1), F.coalesce("_from", F.lit(0))), F.when(F.col("_to").isNotNull(), F.substring("value", F.col("_to") + 1, n)).otherwise(""))
    cut = is_text & (F.col("_from").isNotNull() | F.col("_to").isNotNull())
    return renumber(left.withColumn("value", F.when(cut, kept).otherwise(F.col("value"))).select(*nodes.columns))


def insert_edits(nodes: DataFrame, ranges: DataFrame, node: str = "new_id") -> DataFrame:
    """Edits that insert ``ranges.new_id`` at each range's start; texts are split there first."""
    n = nodes.select("doc_id", F.col("node_id").alias("start_id"), "node_type", F.col("parent_id").alias("_parent"))
    child = nodes.select("doc_id", F.col("parent_id").alias("start_id"), F.col("sib_idx").alias("start_off"), F.col("node_id").alias("_at"))
    met = ranges.join(n, ["doc_id", "start_id"]).join(child, ["doc_id", "start_id", "start_off"], "left")
    null = F.lit(None).cast("long")
    entry = lambda seq, op, target, parent, reference, value: F.struct(
        F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), target.alias("target_id"), parent.alias("parent_id"), reference.alias("reference_id"), F.lit(None).cast("string").alias("name"), value.alias("value"))
    text = F.array(
        entry(0, "split_text", F.col("start_id"), null, null, F.col("start_off").cast("string")),
        entry(1, "after", F.col("start_id"), null, F.col(node), F.lit(None).cast("string")))
    other = F.array(
        entry(0, "insert_before", F.col(node), F.col("start_id"), F.col("_at"), F.lit(None).cast("string")))
    return met.select("doc_id", F.explode(F.when(F.col("node_type") == TEXT, text).otherwise(other)).alias("e")).select("doc_id", "e.*")


def adjust(ranges: DataFrame, mutations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ranges`` after one batch of removals: a boundary in a removed subtree moves to where it was.

    ``nodes`` is the table before the batch; ``mutations`` has rows (doc_id,
    target_id, removed).  Offsets behind removed children of a container shrink.
    """
    gone = mutations.filter(F.size("removed") > 0).select("doc_id", F.explode("removed").alias("node_id"))
    roots = nodes.join(gone.distinct(), ["doc_id", "node_id"]).select(F.col("doc_id").alias("_d"), F.col("root_id").alias("_t"), F.col("node_id").alias("_gone"), F.col("pre").alias("_p"), F.col("last").alias("_l"), F.col("parent_id").alias("_up"), F.col("sib_idx").alias("_i"))
    out = ranges
    for side in ("start", "end"):
        at = nodes.select(F.col("doc_id"), F.col("node_id").alias(f"{side}_id"), F.col("root_id").alias("_r"), F.col("pre").alias("_pre"))
        own = out.join(at, ["doc_id", f"{side}_id"])
        hit = own.join(roots, (F.col("doc_id") == F.col("_d")) & (F.col("_r") == F.col("_t")) & (F.col("_pre") >= F.col("_p")) & (F.col("_pre") <= F.col("_l")))
        moved = hit.groupBy("range_id").agg(F.min_by(F.struct("_up", "_i"), "_p").alias("m"))
        out = out.join(moved, "range_id", "left").withColumns({
            f"{side}_id": F.coalesce("m._up", f"{side}_id"), f"{side}_off": F.coalesce("m._i", f"{side}_off")}).select(*ranges.columns)
        before = roots.select(F.col("_d").alias("doc_id"), F.col("_up").alias(f"{side}_id"), "_i")
        fewer = out.join(before, ["doc_id", f"{side}_id"]).filter(F.col("_i") < F.col(f"{side}_off")).groupBy("range_id").agg(F.count("*").alias("n"))
        out = out.join(fewer, "range_id", "left").withColumn(f"{side}_off", (F.col(f"{side}_off") - F.coalesce("n", F.lit(0))).cast(dict(ranges.dtypes)[f"{side}_off"])).select(*ranges.columns)
    return out


def _moved(ranges: DataFrame, side: str, changes: DataFrame, node: str, new: dict) -> DataFrame:
    """``ranges`` with one boundary changed where it lies in ``node`` of ``changes``; their other columns begin with _."""
    types = dict(ranges.dtypes)
    met = ranges.join(changes.withColumnRenamed(node, f"{side}_id"), ["doc_id", f"{side}_id"], "left")
    at = lambda c: new[c](F.col(f"{side}_off")).cast(types[f"{side}_{c}"])
    return met.withColumns({f"{side}_{c}": F.coalesce(at(c), f"{side}_{c}") for c in new}).select(*ranges.columns)


def adjust_inserted(ranges: DataFrame, inserted: DataFrame) -> DataFrame:
    """``ranges`` after insertions (doc_id, parent_id, at, count) of nodes before the child number ``at``: offsets behind them grow.

    Several insertions into one parent count from its children before the batch.
    """
    own = inserted.groupBy("doc_id", "parent_id").agg(F.collect_list(F.struct("at", "count")).alias("_in"))
    grown = lambda off: off + F.aggregate("_in", F.lit(0).cast("long"), lambda n, x: n + F.when(x["at"] < off, x["count"]).otherwise(0))
    for side in ("start", "end"):
        ranges = _moved(ranges, side, own, "parent_id", {"off": grown})
    return ranges


def adjust_replaced(ranges: DataFrame, replaced: DataFrame) -> DataFrame:
    """``ranges`` after a replacement (doc_id, node_id, at, count, length) in each of some texts: ``count`` code points at ``at`` by ``length``."""
    own = replaced.select("doc_id", "node_id", F.col("at").alias("_at"), F.col("count").alias("_n"), F.col("length").alias("_m"))
    at, end = F.col("_at"), F.col("_at") + F.col("_n")
    for side in ("start", "end"):
        ranges = _moved(ranges, side, own, "node_id", {"off": lambda off: F.when(off <= at, off).when(off <= end, at).otherwise(off + F.col("_m") - F.col("_n"))})
    return ranges


def adjust_split(ranges: DataFrame, splits: DataFrame) -> DataFrame:
    """``ranges`` after splits (doc_id, node_id, at, new_id, parent_id, sib_idx): boundaries behind the cut go to the new text, those of the parent behind the old text move on."""
    own = splits.select("doc_id", "node_id", F.col("at").alias("_at"), F.col("new_id").alias("_new"))
    for side in ("start", "end"):
        behind = F.col(f"{side}_off") > F.col("_at")
        # Both columns come from the boundary as it was.
        ranges = _moved(ranges, side, own, "node_id", {"id": lambda off, b=behind: F.when(b, F.col("_new")), "off": lambda off, b=behind: F.when(b, off - F.col("_at"))})
    return adjust_inserted(ranges, splits.select("doc_id", "parent_id", F.col("sib_idx").alias("at"), F.lit(1).alias("count")))


def surround_edits(ranges: DataFrame, node: str = "new_id") -> DataFrame:
    """Edits that put the contents of each range into ``ranges.new_id``; ranges that cut an element are refused when applied."""
    null = F.lit(None).cast("string")
    return ranges.select(
        "doc_id", F.lit(0).cast("long").alias("seq"), F.lit("surround_contents").alias("op"), F.col("start_id").alias("target_id"), F.col(node).alias("parent_id"), F.col("end_id").alias("reference_id"),
        F.concat_ws(",", F.col("start_off").cast("string"), F.col("end_off").cast("string")).alias("name"), null.alias("value"))
