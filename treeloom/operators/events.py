"""Event dispatch, focus, observers, signals and custom-element reactions, as set operations.

Listeners are rows whose action is one of a closed set of names, so a whole log
of dispatches is one plan: events x paths x listeners, ordered per event.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ELEMENT
from .axes import ancestors
from .intervals import semi

EVENTS = "event_id long, doc_id long, target_id long, type string, bubbles boolean, cancelable boolean, composed boolean, ts timestamp"
LISTENERS = "doc_id long, node_id long, seq long, type string, capture boolean, once boolean, passive boolean, signal_id long, action string"
# Phases of an event.
NONE, CAPTURING, AT_TARGET, BUBBLING = 0, 1, 2, 3
#: Actions of listeners that change the dispatch; others are names for the caller.
PREVENT, STOP, STOP_NOW = "prevent_default", "stop_propagation", "stop_immediate_propagation"


def composed_path(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, doc_id, node_id, distance, seen_target): the path from the target outwards.

    Ancestors within a tree come from intervals; from a shadow root the path goes
    on to the host if the event is composed, and there the event is seen as the
    host's; the loop is over levels of shadow trees and ends with the last path.
    """
    shadows = nodes.filter(F.col("kind") == "shadow_root").select("doc_id", F.col("node_id").alias("_shadow"), "host_id")
    here = events.select("event_id", "doc_id", "target_id", "composed").withColumns({"_from": F.col("target_id"), "_base": F.lit(0).cast("long")})
    parts = []
    nested = not shadows.isEmpty()
    while True:
        keys = here.select("doc_id", F.col("_from").alias("node_id")).distinct()
        up = ancestors(nodes, keys).select("doc_id", F.col("node_id").alias("_from"), "ancestor_id", "distance")
        own = here.select("event_id", "doc_id", "composed", F.col("_from").alias("node_id"), F.col("_base").alias("distance"), F.col("_from").alias("seen_target"), "_base")
        over = here.join(up, ["doc_id", "_from"]).select("event_id", "doc_id", "composed", F.col("ancestor_id").alias("node_id"), (F.col("_base") + F.col("distance")).alias("distance"), F.col("_from").alias("seen_target"), "_base")
        level = own.unionByName(over)
        parts.append(level.select("event_id", "doc_id", "node_id", "distance", "seen_target"))
        if not nested:
            break
        here = level.filter("composed").join(shadows, (level["doc_id"] == shadows["doc_id"]) & (F.col("node_id") == F.col("_shadow"))).select(
            "event_id", level["doc_id"], F.col("host_id").alias("target_id"), "composed", F.col("host_id").alias("_from"), (F.col("distance") + 1).alias("_base"))
        if here.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def dispatch(nodes: DataFrame, events: DataFrame, listeners: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(event_id, fire_ord, doc_id, node_id, seq, phase, seen_target, action): listeners in the order they fire.

    Capture goes from the root to the target, then the target's listeners fire in
    order of registration, then bubbling goes outwards if the event bubbles.
    stop_propagation lets the rest of its node's listeners fire,
    stop_immediate_propagation none.  Events of a document happen in order of ts and
    event_id.  A listener whose signal (signal_id, aborted_at as a timestamp or in
    seconds) is aborted by the time of the event is silent, also if the event has no
    time; one that is ``once`` fires for the first event that reaches it, stopped
    ones not counted.
    """
    path = composed_path(nodes, events)
    e = events.select("event_id", F.col("type").alias("_type"), "bubbles", "cancelable", "ts")
    met = path.join(e, "event_id").join(listeners, ["doc_id", "node_id"]).filter(F.col("type") == F.col("_type"))
    if signals is not None:
        gone = signals.filter("aborted_at is not null").select("signal_id", "aborted_at")
        if dict(gone.dtypes)["aborted_at"] not in ("timestamp", "timestamp_ntz"):
            gone = gone.withColumn("aborted_at", F.timestamp_seconds("aborted_at"))
        gone = gone.groupBy("signal_id").agg(F.min("aborted_at").alias("_aborted"))
        met = met.join(gone, "signal_id", "left").filter(F.col("_aborted").isNull() | (F.coalesce("ts", "_aborted") < F.col("_aborted"))).drop("_aborted")
    at_target = F.col("distance") == 0
    met = met.filter(F.col("capture") | at_target | F.col("bubbles"))
    round_ = F.when(at_target, 1).when(F.col("capture"), 0).otherwise(2)
    met = met.withColumns({
        "phase": F.when(at_target, AT_TARGET).when(F.col("capture"), CAPTURING).otherwise(BUBBLING), "_pass": round_,
        "_step": F.when(F.col("capture") & ~at_target, -F.col("distance")).otherwise(F.col("distance"))})
    out = ["event_id", "doc_id", "node_id", "seq", "phase", "seen_target", "action", "passive", "_pass", "_step"]
    stops = F.col("action").isin(STOP, STOP_NOW)
    # Only a once listener that stops events has a say in what later events reach.
    bound = listeners.filter(F.col("once") & stops).select("doc_id")
    free = semi(met, bound, [("doc_id", "doc_id")], how="left_anti")
    first = Window.partitionBy("doc_id", "node_id", "seq").orderBy("ts", "event_id")
    fired = _unstopped(free).withColumn("_nth", F.row_number().over(first)).filter("not once or _nth = 1").select(*out)
    sequential = semi(met, bound, [("doc_id", "doc_id")]).select(*out, "once", "ts")
    sequential = sequential.repartition("doc_id").sortWithinPartitions("doc_id", "ts", "event_id", "_pass", "_step", "seq")
    fired = fired.unionByName(sequential.mapInArrow(_in_sequence, sequential.schema).select(*out))
    order = Window.partitionBy("event_id").orderBy("_pass", "_step", "seq")
    return fired.select("event_id", F.row_number().over(order).alias("fire_ord"), "doc_id", "node_id", "seq", "phase", "seen_target", "action", "passive")


def _unstopped(met: DataFrame) -> DataFrame:
    """The candidates of each event that no earlier listener keeps from firing."""
    order = Window.partitionBy("event_id").orderBy("_pass", "_step", "seq")
    whole = Window.partitionBy("event_id")
    met = met.withColumn("_n", F.row_number().over(order))
    # The first stop of either kind ends the event behind its node, the first immediate one at once.
    halt = F.min(F.when(F.col("action").isin(STOP, STOP_NOW), F.struct("_n", "_pass", "_step"))).over(whole)
    now = F.min(F.when(F.col("action") == STOP_NOW, F.col("_n"))).over(whole)
    met = met.withColumns({"_halt": halt, "_now": now})
    same_node = (F.col("_pass") == F.col("_halt._pass")) & (F.col("_step") == F.col("_halt._step"))
    return met.filter((F.col("_halt").isNull() | (F.col("_n") <= F.col("_halt._n")) | same_node) & (F.col("_now").isNull() | (F.col("_n") <= F.col("_now"))))


def _in_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidates sorted by document, event and place those that fire; a document's spent listeners are all that is kept."""
    doc = event = stopped_at = None
    begun, ended, spent = False, False, set()
    for batch in batches:
        keep = []
        for d, e, step, listener, action, once in zip(
            batch["doc_id"].to_pylist(), batch["event_id"].to_pylist(), zip(batch["_pass"].to_pylist(), batch["_step"].to_pylist()),
            zip(batch["node_id"].to_pylist(), batch["seq"].to_pylist()), batch["action"].to_pylist(), batch["once"].to_pylist(),
        ):
            if not begun or d != doc:
                spent = set()
            if not begun or d != doc or e != event:
                stopped_at, ended = None, False
            begun, doc, event = True, d, e
            fires = not ended and (stopped_at is None or stopped_at == step) and not (once and listener in spent)
            keep.append(fires)
            if fires:
                if once:
                    spent.add(listener)
                ended = action == STOP_NOW
                if action in (STOP, STOP_NOW) and stopped_at is None:
                    stopped_at = step
        yield batch.filter(pa.array(keep, pa.bool_()))


def outcomes(events: DataFrame, fired: DataFrame) -> DataFrame:
    """(event_id, not_prevented): what dispatchEvent returns; passive listeners cannot prevent."""
    prevented = fired.filter((F.col("action") == PREVENT) & ~F.coalesce("passive", F.lit(False))).select("event_id").distinct().withColumn("_p", F.lit(True))
    return events.join(prevented, "event_id", "left").select("event_id", (~(F.coalesce("_p", F.lit(False)) & F.col("cancelable"))).alias("not_prevented"))


def default_actions(nodes: DataFrame, events: DataFrame, outcome: DataFrame) -> DataFrame:
    """(doc_id, node_id, what, value) after clicks in order of time: checkedness and open details.

    A checkbox toggles, a radio is checked and the others of its name in the
    document are not, the first summary of a details opens or closes it.
    """
    clicks = events.filter(F.col("type") == "click").join(outcome.filter("not_prevented"), "event_id", "left_semi").select("doc_id", F.col("target_id").alias("node_id"), "ts", "event_id")
    kind = F.lower(F.try_element_at("attrs", F.lit("type")))
    inputs = nodes.filter((F.col("local_name") == "input") & kind.isin("checkbox", "radio")).select(
        "doc_id", "node_id", kind.alias("kind"), F.try_element_at("attrs", F.lit("name")).alias("name"), F.coalesce("checked", F.map_contains_key("attrs", "checked")).alias("was"))
    hits = clicks.join(inputs, ["doc_id", "node_id"])
    toggles = hits.filter("kind = 'checkbox'").groupBy("doc_id", "node_id").agg(F.count("*").alias("n"), F.first("was").alias("was")).select(
        "doc_id", "node_id", F.lit("checked").alias("what"), (F.col("was") != (F.col("n") % 2 == 1)).alias("value"))
    last = hits.filter("kind = 'radio'").groupBy("doc_id", "name").agg(F.max_by("node_id", F.struct("ts", "event_id")).alias("chosen"))
    radios = inputs.filter("kind = 'radio'").join(last.withColumnsRenamed({"doc_id": "_d", "name": "_n"}), (F.col("doc_id") == F.col("_d")) & F.col("name").eqNullSafe(F.col("_n"))).select(
        "doc_id", "node_id", F.lit("checked").alias("what"), (F.col("node_id") == F.col("chosen")).alias("value"))
    summaries = nodes.filter(F.col("local_name") == "summary").groupBy("doc_id", F.col("parent_id").alias("_details")).agg(F.min_by("node_id", "pre").alias("node_id"))
    details = nodes.filter(F.col("local_name") == "details").select("doc_id", F.col("node_id").alias("_details"), F.map_contains_key("attrs", "open").alias("was"))
    opened = clicks.join(summaries, ["doc_id", "node_id"]).join(details, ["doc_id", "_details"]).groupBy("doc_id", "_details").agg(F.count("*").alias("n"), F.first("was").alias("was")).select(
        "doc_id", F.col("_details").alias("node_id"), F.lit("open").alias("what"), (F.col("was") != (F.col("n") % 2 == 1)).alias("value"))
    return toggles.unionByName(radios).unionByName(opened)


def focus_events(requests: DataFrame) -> DataFrame:
    """(doc_id, request_id, ord, type, target_id, related_id): blur, focusout, focus, focusin of focus requests in time.

    ``requests`` (doc_id, request_id, target_id, ts); a null target is a blur.
    Focusing what has the focus does nothing.
    """
    order = Window.partitionBy("doc_id").orderBy("ts", "request_id")
    r = requests.withColumn("_was", F.lag("target_id").over(order)).filter(~F.col("target_id").eqNullSafe(F.col("_was")))
    entry = lambda i, t, a, b: F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.col(a).alias("target_id"), F.col(b).alias("related_id"))
    out = F.filter(F.array(entry(1, "blur", "_was", "target_id"), entry(2, "focusout", "_was", "target_id"), entry(3, "focus", "target_id", "_was"), entry(4, "focusin", "target_id", "_was")), lambda e: e["target_id"].isNotNull())
    return r.select("doc_id", "request_id", F.explode(out).alias("e")).select("doc_id", "request_id", "e.*")


def document_state(log: DataFrame) -> DataFrame:
    """(doc_id, active_element, hover, active, fragment) from a log (doc_id, ts, what, node_id, text): the last of each."""
    last = lambda what, column: F.max_by(F.when(F.col("what") == what, F.col(column)), F.when(F.col("what") == what, F.struct("ts", F.coalesce("node_id", F.lit(-1))))).alias(what)
    return log.groupBy("doc_id").agg(last("active_element", "node_id"), last("hover", "node_id"), last("active", "node_id"), last("fragment", "text"))


def route_records(nodes: DataFrame, mutations: DataFrame, observations: DataFrame) -> DataFrame:
    """(observer_id, doc_id, seq, type, target_id, attribute_name, old_value): records by observer.

    An observer gets a record of its target, or with subtree of the target's
    descendants, of the kinds and attributes that it asks for, once, with the old
    value if one of its observations asks for it.
    """
    m = mutations.select("doc_id", "seq", "type", "target_id", "attribute_name", "old_value").join(
        nodes.select("doc_id", F.col("node_id").alias("target_id"), F.col("root_id").alias("_r"), F.col("pre").alias("_at")), ["doc_id", "target_id"])
    o = observations.join(nodes.select("doc_id", F.col("node_id").alias("target_id"), F.col("root_id").alias("_root"), F.col("pre").alias("_p"), F.col("last").alias("_l")), ["doc_id", "target_id"]).withColumnsRenamed({"target_id": "_watched", "doc_id": "_d"})
    near = (F.col("_at") == F.col("_p")) | (F.col("subtree") & (F.col("_at") > F.col("_p")) & (F.col("_at") <= F.col("_l")))
    met = m.join(o, (F.col("doc_id") == F.col("_d")) & (F.col("_r") == F.col("_root")) & near)
    wanted = (
        ((F.col("type") == "child_list") & F.col("child_list"))
        | ((F.col("type") == "attributes") & F.col("attributes") & (F.col("attribute_filter").isNull() | F.array_contains("attribute_filter", F.col("attribute_name"))))
        | ((F.col("type") == "character_data") & F.col("character_data"))
    )
    old = F.when(((F.col("type") == "attributes") & F.col("attribute_old_value")) | ((F.col("type") == "character_data") & F.col("character_data_old_value")), F.col("old_value"))
    return met.filter(F.coalesce(wanted, F.lit(False))).groupBy("observer_id", "doc_id", "seq", "type", "target_id", "attribute_name").agg(F.max(old).alias("old_value"))


def attribute_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, node_id, name, old_value, new_value): a full outer join of two snapshots' attributes."""
    rows = lambda n, v: n.filter(F.col("node_type") == ELEMENT).select("doc_id", "node_id", F.explode("attrs").alias("name", v))
    joined = rows(before, "old_value").join(rows(after, "new_value"), ["doc_id", "node_id", "name"], "full_outer")
    return joined.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def timeout_signals(created: DataFrame) -> DataFrame:
    """(signal_id, aborted_at, reason) of signals that abort by themselves: ``created`` has signal_id, ts and delay_ms."""
    due = F.timestamp_millis(F.unix_millis("ts") + F.col("delay_ms"))
    return created.select("signal_id", due.alias("aborted_at"), F.lit("timeout").alias("reason"))


def aborted_signals(signals: DataFrame, depends: DataFrame) -> DataFrame:
    """(signal_id, aborted_at, reason): signals, dependent ones (``any``) aborted with the first of their sources.

    ``depends`` (signal_id, source_id).  The loop is over levels of dependence and
    ends when nothing changes; the earliest abort can only get earlier.
    """
    now = signals.select("signal_id", "aborted_at", "reason")
    while True:
        up = depends.join(now.withColumnRenamed("signal_id", "source_id").filter("aborted_at is not null"), "source_id").groupBy("signal_id").agg(F.min(F.struct("aborted_at", "reason")).alias("_up"))
        own = F.when(F.col("aborted_at").isNotNull(), F.struct("aborted_at", "reason"))
        joined = now.join(up, "signal_id", "left").withColumn("_best", F.least(own, F.col("_up")))
        if joined.filter(~F.col("_best").eqNullSafe(own)).isEmpty():
            return now
        now = joined.select("signal_id", F.col("_best.aborted_at").alias("aborted_at"), F.col("_best.reason").alias("reason"))


def reactions(before: DataFrame, after: DataFrame, defined: DataFrame) -> DataFrame:
    """(doc_id, node_id, reaction, name, old_value, new_value) of custom elements between two snapshots.

    constructed and connected for new ones in the document's tree, disconnected
    for those gone from it, attributeChanged for observed attributes.  ``defined``
    has doc_id, local_name, observed (array of names).
    """
    def custom(n: DataFrame) -> DataFrame:
        return n.filter((F.col("node_type") == ELEMENT) & F.col("local_name").contains("-")).join(defined, ["doc_id", "local_name"]).join(
            n.filter(F.col("kind") == "document").select("doc_id", F.col("node_id").alias("_doc")), "doc_id", "left").select(
            "doc_id", "node_id", "attrs", "observed", (F.col("root_id") == F.col("_doc")).alias("on"))

    a = custom(before).select("doc_id", "node_id", F.col("attrs").alias("a"), F.col("on").alias("was_on"), F.col("observed").alias("o1"))
    b = custom(after).select("doc_id", "node_id", F.col("attrs").alias("b"), F.col("on").alias("is_on"), F.col("observed").alias("o2"))
    both = a.join(b, ["doc_id", "node_id"], "full_outer")
    null = F.lit(None).cast("string")
    row = lambda r, n=null, x=null, y=null: F.struct(F.lit(r).alias("reaction"), n.alias("name"), x.alias("old_value"), y.alias("new_value"))
    on = lambda c: F.coalesce(c, F.lit(False))
    simple = F.filter(F.array(
        F.when(F.col("was_on").isNull(), row("constructed")),
        F.when(on(F.col("is_on")) & ~on(F.col("was_on")), row("connected")),
        F.when(on(F.col("was_on")) & ~on(F.col("is_on")), row("disconnected"))), lambda x: x.isNotNull())
    value = lambda m, k: F.try_element_at(m, k)
    changed = F.filter(F.transform(F.coalesce("o2", "o1"), lambda k: F.when(~value(F.col("a"), k).eqNullSafe(value(F.col("b"), k)) & F.col("is_on").isNotNull(), F.struct(F.lit("attributeChanged").alias("reaction"), k.alias("name"), value(F.col("a"), k).alias("old_value"), value(F.col("b"), k).alias("new_value")))), lambda x: x.isNotNull())
    return both.select("doc_id", "node_id", F.explode(F.concat(simple, changed)).alias("r")).select("doc_id", "node_id", "r.*")
