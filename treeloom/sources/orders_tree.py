"""The tables customer, orders and lineitem as documents: one tree per customer.

    document > customer > order > item or return > text

A line is a ``return`` if its return flag is R, its text is its part key.  The
tree is numbered by windows within a customer or an order, so the corpus scales
with the number of customers and no step sees more than one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ATTRIBUTE, DOCUMENT, ELEMENT, NODES, TEXT

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _attributes(pairs: list[tuple[str, Column]]) -> dict[str, Column]:
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(None).cast("string").alias("prefix"), F.lit(k).alias("local"), F.lit(None).cast("string").alias("url"), F.lit(k).alias("qname"), v.alias("value")) for i, (k, v) in enumerate(pairs)]
    return {
        "attrs": F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]),
        "attr_list": F.array(*entries).cast(f"array<{ATTRIBUTE.simpleString()}>"),
    }


def _shape(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES])


def _pairs(df: DataFrame, both: dict[str, Column], first: dict[str, Column], second: dict[str, Column]) -> DataFrame:
    """Two nodes for each row, so that the rows are made once for both."""
    names = dict.fromkeys([*first, *second])
    null = F.lit(None)
    either = {c: F.when(F.col("_part") == 0, first.get(c, null)).otherwise(second.get(c, null)) for c in names}
    return _shape(df.withColumn("_part", F.explode(F.array(F.lit(0), F.lit(1)))), **both, **either)


def orders_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of all customers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem")
    nation = read("nation").select("n_nationkey", "n_name")
    # 25 nations: a table of fixed size.
    customers = read("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    by_order = Window.partitionBy("o_orderkey").orderBy(*LINE_ORDER)
    counts = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = read("orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    size = 1 + 2 * F.col("n")
    orders = orders.select(
        "*", F.row_number().over(by_customer).alias("k"), F.count("*").over(Window.partitionBy("o_custkey")).alias("of"),
        (F.lit(2) + F.coalesce(F.sum(size).over(by_customer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("pre"))
    kinds = Window.partitionBy("o_orderkey", "name")
    placed = lines.join(orders.select("o_orderkey", "o_custkey", F.col("pre").alias("o_pre"), F.col("n").alias("o_n")), F.col("l_orderkey") == F.col("o_orderkey"))
    placed = placed.withColumn("name", F.when(F.col("l_returnflag") == "R", "return").otherwise("item")).select(
        "*", F.row_number().over(by_order).alias("i"), F.row_number().over(kinds.orderBy(*LINE_ORDER)).alias("t"), F.count("*").over(kinds).alias("t_n"))
    line_pre = F.col("o_pre") + 1 + 2 * (F.col("i") - 1)

    totals = orders.groupBy("o_custkey").agg(F.sum(size).alias("nodes"), F.count("*").alias("of"))
    owners = customers.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    end = F.lit(1) + F.coalesce("nodes", F.lit(0))
    one = F.lit(1)
    html = F.lit(None).cast("string")
    customer = dict(
        node_id=one, parent_id=F.lit(0), parent_type=F.lit(DOCUMENT), pre=one, last=end, depth=one, sib_idx=F.lit(0), elem_idx=one, elem_cnt=one,
        type_idx=one, type_cnt=one, content_child_cnt=F.coalesce("of", F.lit(0)), kind=F.lit("element"), node_type=F.lit(ELEMENT), local_name=F.lit("customer"), namespace=html,
        id=F.concat(F.lit("c"), F.col("c_custkey").cast("string")), class_tokens=F.array(F.lower("c_mktsegment")),
        **_attributes([("id", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), ("class", F.lower("c_mktsegment")), ("name", F.col("c_name")), ("nation", F.col("n_name"))]))
    line = dict(
        node_id=line_pre, parent_id=F.col("o_pre"), pre=line_pre, last=line_pre + 1, depth=F.lit(3), sib_idx=F.col("i") - 1, elem_idx=F.col("i"), elem_cnt=F.col("o_n"),
        type_idx=F.col("t"), type_cnt=F.col("t_n"), content_child_cnt=one, kind=F.lit("element"), node_type=F.lit(ELEMENT), local_name=F.col("name"), namespace=html,
        class_tokens=F.array().cast("array<string>"),
        **_attributes([("flag", F.col("l_returnflag")), ("status", F.col("l_linestatus")), ("quantity", F.col("l_quantity").cast("int").cast("string"))]))
    return (
        _pairs(
            owners, dict(doc_id=F.col("c_custkey"), root_id=F.lit(0)),
            dict(node_id=F.lit(0), pre=F.lit(0), last=end, depth=F.lit(0), sib_idx=F.lit(0), content_child_cnt=one, kind=F.lit("document"), node_type=F.lit(DOCUMENT)), customer)
        .unionByName(_shape(
            orders, doc_id=F.col("o_custkey"), root_id=F.lit(0), node_id=F.col("pre"), parent_id=one, parent_type=F.lit(ELEMENT), pre=F.col("pre"), last=F.col("pre") + 2 * F.col("n"),
            depth=F.lit(2), sib_idx=F.col("k") - 1, elem_idx=F.col("k"), elem_cnt=F.col("of"), type_idx=F.col("k"), type_cnt=F.col("of"), content_child_cnt=F.col("n"),
            kind=F.lit("element"), node_type=F.lit(ELEMENT), local_name=F.lit("order"), namespace=html, id=F.concat(F.lit("o"), F.col("o_orderkey").cast("string")),
            class_tokens=F.array(F.lower("o_orderstatus")),
            **_attributes([("id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))), ("class", F.lower("o_orderstatus")), ("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority"))])))
        .unionByName(_pairs(
            placed, dict(doc_id=F.col("o_custkey"), root_id=F.lit(0), parent_type=F.lit(ELEMENT)), line,
            dict(node_id=line_pre + 1, parent_id=line_pre, pre=line_pre + 1, last=line_pre + 1, depth=F.lit(4), sib_idx=F.lit(0), content_child_cnt=F.lit(0), kind=F.lit("text"),
                 node_type=F.lit(TEXT), value=F.col("l_partkey").cast("string"))))
    )


#: The same trees in SQL, from keys rather than intervals: cust, ord (with k, n,
#: of, pre) and line (with i, name, t, t_n, o_pre, pre).
PRELUDE = f"""
WITH cnt AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
ord AS (
  SELECT o.*, coalesce(n, 0) AS n,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS "of",
    2 + coalesce(sum(1 + 2 * coalesce(n, 0)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre
  FROM orders o LEFT JOIN cnt ON o_orderkey = l_orderkey),
named AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'item' END AS name FROM lineitem),
line AS (
  SELECT l.*, o_custkey, o_orderkey, o_orderstatus, o_orderpriority, n, k, ord.pre AS o_pre,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS i,
    row_number() OVER (PARTITION BY l_orderkey, name ORDER BY {", ".join(LINE_ORDER)}) AS t,
    count(*) OVER (PARTITION BY l_orderkey, name) AS t_n,
    (ord.pre + 1 + 2 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1))::BIGINT AS pre
  FROM named l JOIN ord ON l_orderkey = o_orderkey),
cust AS (SELECT c.*, n_name FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey)
"""
