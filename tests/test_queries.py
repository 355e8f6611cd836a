"""Registered queries against their SQL in DuckDB at the smallest scale, and streams against batches."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from treeloom.plans import cases
from treeloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "css_chain", "css_has_descendant", "css_nth_of", "element_closest", "axis_siblings", "common_ancestor", "document_position", "text_content", "outer_html", "range_text",
    "tree_walker", "remove_subtrees", "apply_edits", "edit_mutations", "event_dispatch", "focus_events", "focus_stream", "toggle_stream", "timers_due", "page_nav_links", "page_titles", "character_data", "token_lists",
    "event_once", "event_once_stops", "event_signals", "signal_chain", "edit_structure", "edit_markup", "edit_values", "edit_refused", "edit_shadow", "parse_trees", "tokens_of_text", "tokens_of_fragment",
    "page_titles_decoded", "element_reactions", "assigned_nodes", "slot_manual", "check_finds", "range_contents", "pseudo_indeterminate", "pseudo_target", "pseudo_valid",
)


def rows(df):
    clean = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if not isinstance(x, bool) else x
    return sorted((tuple(clean(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ("unescape_text_whole", "fragment_nodes_whole"))
def test_whole_tables(spark, con, tmp_path, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())
    texts = [None, "", "a & b", "&lt;b&gt; &amp;amp; &nbsp;\u00a0", "&notin &copy=1 &#60; &", "<p>x</p>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).collect()
    if name == "unescape_text_whole":
        assert {r["doc_id"]: r["back"] for r in got} == {i: x or "" for i, x in enumerate(texts)}
    else:
        assert {r["turn"]: r["n"] for r in got} == dict.fromkeys(range(len(texts)), 1)


def test_timer_stream(spark, tmp_path):
    import datetime as dt

    from treeloom.streaming import streams

    streams.use_rocksdb(spark)
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    data = [(1, "set", 1, 1000, at(0)), (1, "set", 2, 1000, at(0)), (1, "clear", 2, 0, at(0)), (1, "interval", 3, 2000, at(0)), (2, "set", 1, 10, at(9))]
    cols = "doc_id long, op string, timer_id long, delay_ms long, ts timestamp"
    for i, part in enumerate((data[:4], data[4:])):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.timer_stream(spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["doc_id"], r["timer_id"]) for r in spark.table("fired").collect()}
    assert (1, 2) not in got and (1, 1) in got and (1, 3) in got
    batch = streams.timers_due(spark.createDataFrame(data, cols), int(at(0).timestamp() * 1000) + 5000)
    due = sorted((r["timer_id"], r["fired_ms"] % 60000) for r in batch.filter("doc_id = 1").collect())
    assert (1, 1000) in due and sum(t == 3 for t, _ in due) == 2


def test_observer_stream(spark, tmp_path):
    from treeloom.sources.html import parse_pages
    from treeloom.streaming import streams

    nodes = parse_pages(spark.createDataFrame([(1, "<div><p>x</p></div>")], "page_id long, html string")).cache()
    p = nodes.filter("local_name = 'p'").first()["node_id"]
    body = nodes.filter("local_name = 'body'").first()["node_id"]
    m = spark.createDataFrame([(1, 1, "attributes", p, "k", "old"), (1, 2, "attributes", p, "z", None)], "doc_id long, seq long, type string, target_id long, attribute_name string, old_value string")
    m.write.parquet(str(tmp_path / "m"))
    o = spark.createDataFrame([(7, 1, body, False, True, False, True, True, False, ["k"])], "observer_id long, doc_id long, target_id long, child_list boolean, attributes boolean, character_data boolean, subtree boolean, attribute_old_value boolean, character_data_old_value boolean, attribute_filter array<string>")
    got = []
    q = streams.observe(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), nodes, o, lambda df, i: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert len(got) == 1 and got[0]["observer_id"] == 7 and [r["old_value"] for r in got[0]["records"]] == ["old"]
    nodes.unpersist()


def test_entry_imports():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cases_are_registered():
    assert len(cases.STRUCTURE) < 100 and {"edit_structure", "parse_trees"} <= set(QUERIES)


@pytest.mark.parametrize("name", ("form_lang_en", "form_read_write"))
def test_forms_broadcast_nothing(spark, name):
    """Stored nodes are far larger in memory than in their files, by which a plan would take them for small."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ("range_text", "range_points"))
def test_ranges_broadcast_nothing(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_store_leaves_no_shuffles(spark):
    """What was shuffled for a stored table is gone once it is written."""
    from treeloom.session import store

    files = lambda: {x for x in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = files()
    stored = store(spark.range(100).selectExpr("id % 7 as k").repartition("k"))
    assert files() <= before and stored.count() == 100
