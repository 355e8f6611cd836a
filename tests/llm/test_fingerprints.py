from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import fingerprints as fp

_text = st.text(alphabet="ab é\n", max_size=60)


@settings(max_examples=200, deadline=None)
@given(_text, _text, st.data())
def test_span_equality_and_extension(a, b, data):
    x, y = fp.PrefixHashes(fp.code_points(a)), fp.PrefixHashes(fp.code_points(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert fp.common_extension(x, i, y, j) == want
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (x.spans(i, n)[0] == y.spans(j, n)[0]) == (a[i : i + n] == b[j : j + n])


def test_extend_equals_anew():
    a, tail = "hello world " * 30, "other words"
    one = fp.PrefixHashes(fp.code_points(a)).extend(100, fp.code_points(tail))
    two = fp.PrefixHashes(fp.code_points(a[:100] + tail))
    assert all((p == q).all() for p, q in zip(one.tables, two.tables))
    long = "xyz" * 50_000  # more than one step of powers
    h = fp.PrefixHashes(fp.code_points(long))
    assert h.spans(0, 30)[0] == h.spans(140_001, 30)[0] != h.spans(140_000, 30)[0]


def test_likeness():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh "), 4000))
    other = "".join(rng.choice(list("abcdefgh "), 4000))
    make = lambda t: fp.Fingerprint(fp.PrefixHashes(fp.code_points(t)))
    a, b, c = make(text), make(text[:3000] + other[:1000]), make(other)
    assert a.likeness(a) == 1 and 0.5 < a.likeness(b) < 0.95 and a.likeness(c) < 0.1
    assert str(fp.parse(str(a))) == str(a) and fp.parse(str(a)).likeness(b) == a.likeness(b)
    assert make("").likeness(make("x")) == 0 and make("").likeness(make("")) == 1


def test_edits_against_brute_force(docs, none):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    for size in (7, 1000):
        got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in fp.fingerprint_edits(docs, rows_per_range=size).collect())
        want = []
        for i, (d, t) in enumerate(rows):
            cut = len(t) // 4
            edited = t[: len(t) - cut] + rows[(i + 1) % len(rows)][1][:cut]
            make = lambda x: str(fp.Fingerprint(fp.PrefixHashes(fp.code_points(x))))
            want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), make(t), make(edited)))
        assert got == sorted(want)
    assert fp.fingerprint_edits(none).count() == 0
    one = fp.fingerprint_edits(docs.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "abcdefgh"), (5, "XXXX"), (2**60, "zz")], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fp.fingerprint_edits(d, rows_per_range=1).collect()}
    assert got[None] == hashlib.sha256(b"abcdefXX").hexdigest() and got[5] == hashlib.sha256(b"XXXz").hexdigest()
