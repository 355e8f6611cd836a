from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import secret_scan
from treeloom.llm.queries import op3_secret_scan  # noqa: F401  (the query module imports)

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda f: (f[0], f[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "secret", "passwd", "=", ":", " ", '"', "'", "abc", "0123456789ab", "AKIA", "ABCDEFGH12", "deadbeefdeadbeef", "ſ", "K", "é", "\n", "zz9/"]), max_size=20))
def test_base_spans(parts):
    text = "".join(parts)
    assert [f for f in secret_scan.scan_text(text) if f[2] < 3] == brute(text)


def test_extra_kinds():
    text = "-----BEGIN RSA PRIVATE KEY-----\nAuthorization: Bearer abcdefghijklmnopqrstuvwxyz ghp_" + "a" * 36 + " eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij"
    assert {secret_scan.KINDS[k] for _, _, k in secret_scan.scan_text(text)} >= {"private_key", "bearer", "provider", "jwt"}


def test_scan(docs, none):
    got = secret_scan.scan(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert [(f["start"], f["end"], f["kind"]) for f in r["findings"] if f["kind"] < 3] == brute(r["text"] or "")
        assert bytes(r["blob"]).hex() == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert secret_scan.scan(none).count() == 0


def test_ledger_scans_only_unseen(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = secret_scan.scan(docs.filter("doc_id < 15"), ledger_path=path).count()
    blobs = spark.read.parquet(path).count()
    again = secret_scan.scan(docs, ledger_path=path).collect()
    ledger = spark.read.parquet(path).collect()
    keys = [(bytes(r["blob"]), r["rules"]) for r in ledger]
    assert first > blobs and len(keys) == len(set(keys)) == docs.select("text").na.fill("").distinct().count()
    assert sorted((r["doc_id"], len(r["findings"])) for r in again) == sorted((r["doc_id"], len(r["findings"])) for r in secret_scan.scan(docs).collect())
