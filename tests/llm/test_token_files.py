from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import token_files
from treeloom.llm.elias_fano import EliasFano
from treeloom.llm.tokenization import UnitEncoder, _load, tokenizer_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    ef = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
    assert ef.decode().tolist() == values
    assert [ef.get(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.get(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 5000))
    assert 8 * len(EliasFano.encode(values).to_bytes()) < 5000 * (2 + np.log2(2000) + 1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBé ,.'sS\n1!%ḰΣΑİſ<|>", max_size=30))
def test_unit_encoder_equals_library(text):
    e = _encoder()
    assert np.frombuffer(e.encode_batch([text])[0], "<u2").tolist() == e.library.encode(text, add_special_tokens=False).ids


def _encoder(cache=[]):  # noqa: B006
    if not cache:
        cache.append(UnitEncoder("word_bpe_49k.json", "<u2", max_units=200))
    return cache[0]


def test_round_trip(docs, none):
    library = _load(tokenizer_path("word_bpe_49k.json"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    want, start = [], 0
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for size in (9, 1000):
        got = token_files.round_trip(docs, docs_per_file=size, with_ids=True).collect()
        assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    assert token_files.round_trip(none).count() == 0


def test_file():
    f = token_files.TokenFile(token_files.pack_file([None, 3, 9], [b"\1\0", b"", b"\2\0\3\0"], 2))
    assert [f.doc_id(i) for i in range(3)] == [None, 3, 9] and [f[i].tolist() for i in range(3)] == [[1], [], [2, 3]]
    with pytest.raises(ValueError):
        token_files.TokenFile(token_files.pack_file([1], [b"\1\0"], 2)[:-1])


def test_spans_of_boundaries():
    import numpy as np

    from treeloom.llm.elias_fano import EliasFano

    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (2, 5), (700, 3), (3000, 10_000_000), (5000, 0)):
        values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        ef = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
        for i, j in ((0, n), (0, 1), (n - 1, n), (n // 3, n // 3 + max(1, n // 2))):
            assert ef.span(i, j).tolist() == values[i:j].tolist()


def test_files_end_at_their_bytes(spark, tmp_path):
    from treeloom.llm import token_files

    docs = spark.createDataFrame([(i, "word " * 50) for i in range(40)], "doc_id long, text string")
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write(docs, folder, bytes_per_file=500)
    rows = token_files.read(folder, manifest).orderBy("doc_id").collect()
    assert manifest.count() > 5 and [r["start"] for r in rows] == [51 * i for i in range(40)] and len(rows) == 40
