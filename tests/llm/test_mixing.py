from __future__ import annotations

import re
from collections import defaultdict

from treeloom.llm import mixing


def brute_targets(sizes, weights, cap):
    """Excess above the caps reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return {**done, **share}
        done.update({s: cap * sizes[s] for s in over})


def test_mix(docs, none):
    given = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in given:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = brute_targets(sizes, (1, 2, 3), 3)
    got = mixing.mix(docs, bucket_rows=4)
    rows = got.collect()
    assert rows == got.collect() and len(rows) == len(given)
    by_id = {r["doc_id"]: r["source"] for r in given}
    taken = defaultdict(int)
    for r in rows:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    firsts = [r["positions"][0] for r in rows if r["positions"]]
    assert firsts == sorted(firsts)
    order = [r["position"] for r in mixing.training_order(got).collect()]
    assert order == sorted(order) and len(order) == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0


def test_whole_documents(docs):
    rows = mixing.mix(docs, whole_documents=True).collect()
    assert all(r["taken"] == r["copies"] * r["size"] for r in rows)
    assert all(r["copies"] <= 3 for r in rows)


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    df = spark.range(1, 100).select((F.col("id") / 100).alias("t"))
    for s in (-0.5, 0.0, 0.9):
        share = F.col("t") + s * (F.col("t") * F.col("t") - F.col("t"))
        assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select("t", mixing.invert_demand(share, F.lit(s))).collect())
