"""Structural joins over nested-set intervals.

Containment joins are sweeps: both sides are merged in tree order in one window
over (doc_id, root_id), and a running maximum says whether an interval is still
open.  A sweep is linear in a document's nodes, where a join with a range
condition is quadratic for a large document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import merged

TREE = ("doc_id", "root_id")


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def within(nodes: DataFrame, scopes: DataFrame, *, inclusive: bool = False) -> DataFrame:
    """The rows of ``nodes`` with an ancestor (or themselves, if inclusive) in ``scopes``."""
    order = Window.partitionBy(*TREE).orderBy("pre", "_is_node").rowsBetween(Window.unboundedPreceding, -1)
    if not inclusive:  # a scope comes after a node at the same place
        order = Window.partitionBy(*TREE).orderBy("pre", F.col("_is_node").desc()).rowsBetween(Window.unboundedPreceding, -1)
    opened = scopes.select(*TREE, "pre", F.col("last").alias("_open"), F.lit(0).alias("_is_node"))
    both = nodes.withColumns({"_open": F.lit(None).cast("long"), "_is_node": F.lit(1)}).unionByName(opened, allowMissingColumns=True)
    swept = both.withColumn("_covered", F.max("_open").over(order) >= F.col("pre"))
    return swept.filter((F.col("_is_node") == 1) & F.col("_covered")).select(*nodes.columns)


def containing(nodes: DataFrame, inner: DataFrame, *, inclusive: bool = False) -> DataFrame:
    """The rows of ``nodes`` with a descendant (or themselves, if inclusive) in ``inner``."""
    # Backwards in tree order the nearest inner node after a node is the smallest.
    order = Window.partitionBy(*TREE).orderBy(F.col("pre").desc(), F.col("_is_node") if inclusive else F.col("_is_node").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marks = inner.select(*TREE, "pre", F.col("pre").alias("_mark"), F.lit(0).alias("_is_node"))
    both = nodes.withColumns({"_mark": F.lit(None).cast("long"), "_is_node": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    swept = both.withColumn("_next", F.min("_mark").over(order))
    return swept.filter((F.col("_is_node") == 1) & (F.col("_next") <= F.col("last"))).select(*nodes.columns)


def semi(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], more=None, how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join on pairs of columns (left, right), with names that cannot clash."""
    names = list(dict.fromkeys(r for _, r in on))
    extra = list(more[0]) if more else []
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in dict.fromkeys(names + extra)])
    if not extra:
        r = r.distinct()
    test = None
    for a, b in on:
        one = left[a] == F.col(f"_r_{b}")
        test = one if test is None else test & one
    if more:
        test = test & more[1]
    return left.join(merged(r), test, how)


def enclosing(nodes: DataFrame, scopes: DataFrame, out: dict[str, Column], *, inclusive: bool = True, nearest: bool = False) -> DataFrame:
    """``nodes`` paired with each of ``scopes`` that holds them, or with the nearest, with ``out`` of the scope.

    A sweep in tree order counts the scopes that are open, which is the level of a
    scope among them.  The scope open at a level is the last that was opened there,
    so a node takes one row per level, and nothing is compared with what does not
    hold it.  Nodes in no scope are left out.
    """
    at = lambda place, side, step: [F.col(place).alias("_at"), F.lit(side).alias("_side"), F.lit(step).alias("_step")]
    own, held = F.struct(*nodes.columns).alias("_node"), F.struct(*[c.alias(n) for n, c in out.items()]).alias("_scope")
    opened = scopes.select(*TREE, *at("pre", 1, 1), held)
    closed = scopes.select(*TREE, *at("last", 3, -1))
    rows = nodes.select(*TREE, *at("pre", 2 if inclusive else 0, 0), own)
    both = opened.unionByName(closed, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(*TREE).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_open", F.sum("_step").over(order)).filter("_side <> 3 and _open > 0")
    first = F.lit(1) if not nearest else F.col("_open")
    levels = F.sequence(F.when(F.col("_side") == 1, F.col("_open")).otherwise(first), F.col("_open"))
    there = Window.partitionBy(*TREE, "_level").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = counted.withColumn("_level", F.explode(levels)).withColumn("_scope", F.last("_scope", ignorenulls=True).over(there))
    return met.filter("_side <> 1").select("_node.*", *[F.col(f"_scope.{n}").alias(n) for n in out])


def nearest_ancestor(nodes: DataFrame, carriers: DataFrame, value: str, out: str, *, inclusive: bool = True) -> DataFrame:
    """``nodes`` with ``out``: ``value`` of the nearest ancestor in ``carriers``, null without one."""
    keys = nodes.select("doc_id", "root_id", "node_id", "pre")
    found = enclosing(keys, carriers, {out: F.col(value)}, inclusive=inclusive, nearest=True)
    return nodes.join(merged(found.select("doc_id", "node_id", out)), ["doc_id", "node_id"], "left")
