from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import near_dedup
from treeloom.llm.components import connected_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((40, 120, 300)))]
        for c in range((3, 12, 60, 25)[g]):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 14))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "one two", "ONE  two", "one two three", "one\ttwo\nthree", "é É", "x" * 4000])]
    return rows


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, words, percent)
    got = near_dedup.near_duplicates(docs, words=words, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_for_what_turns_leave(spark, monkeypatch):
    """Without turns all pairs come from the last step; the result is the same."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "_SMALL", 4)
    monkeypatch.setattr(near_dedup, "_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "_INNER", -1.0)
    got = near_dedup.near_duplicates(docs, turns=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85)


def test_odd_rows(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(dict(rows).items(), 3, 85)
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(60)] + rng.integers(100, 160, (40, 2)).tolist() + [(500, 500)]
    links = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a long, b long")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(int(a)), find(int(b))
            parent[max(x, y)] = min(x, y)
    assert {r["id"]: r["component"] for r in connected_components(links).collect()} == {x: find(x) for x in parent}
    assert connected_components(links.filter(F.lit(False))).count() == 0


def test_misses_of_query(monkeypatch):
    """A pair at op4's threshold meets in no table with a probability of 2.2e-5 at most."""
    from treeloom.llm import queries

    given = {}
    monkeypatch.setattr(queries, "table", lambda *a: None)
    monkeypatch.setattr(queries.near_dedup, "near_duplicates", lambda docs, **kw: given.update(kw))
    queries.op4_near_dedup(None, "")
    halves = near_dedup.halves_for(85, 3, given.get("miss", 2e-4))
    assert halves == 12 and 2 * (1 - 0.85**3) ** halves <= 2.2e-5


def test_labels_leave_out_what_is_linked(spark):
    """A family linked to one leader has no rows in the tables behind the diagonal; a stranger in its bucket has."""
    entries = spark.createDataFrame([(k, i, 9 - i, 1) for k in (1, 2) for i in (1, 2, 3)] + [(2, 7, 1, 1)], "key long, id long, known long, late int")
    measured = spark.createDataFrame([(1, 2, 90, 100, 100), (1, 3, 95, 100, 100)], "a long, b long, both long, n_a long, n_b long")
    rows = {tuple(r) for r in near_dedup.led_by_labels(entries, measured, 80).collect()}
    assert rows == {(2, 7, 1, 1)}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8), (3, "x y z", 9, 9)], "doc_id long, text string, _id int, __id int")
    got = {r["doc_id"]: (r["_id"], r["__id"]) for r in near_dedup.drop_near_duplicates(docs).collect()}
    assert got == {1: (5, 6), 3: (9, 9)}
