from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from treeloom.llm import packing
from treeloom.llm.tokenization import _load, byte_encoder, tokenizer_path


def test_tree_places_leftmost():
    tree = packing.TournamentTree(3, 10)
    assert [tree.place(n) for n in (7, 4, 3, 6, 9)] == [0, 1, 0, 1, 2]
    with pytest.raises(ValueError):
        tree.place(11)


def test_first_fit_decreasing_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 101, 60).tolist(), reverse=True)
        room: list[int] = []
        want = []
        for n in lengths:
            at = next((i for i, r in enumerate(room) if r >= n), len(room))
            if at == len(room):
                room.append(100)
            room[at] -= n
            want.append(at)
        assert packing.first_fit_decreasing(lengths, 100) == want


def test_fill_gaps_keeps_all_tokens():
    bins = [[(60, 0, 0)], [(70, 0, 1)], [(20, 0, 2), (10, 0, 3)], [(100, 0, 4)]]
    out = packing.fill_gaps([list(b) for b in bins], 100, 5)
    assert sum(p[0] for b in out for p in b) == 260 and all(sum(p[0] for p in b) <= 100 for b in out) and len(out) == 3


def test_byte_encoder_equals_library():
    library, own = _load(tokenizer_path("byte_bpe_50k.json")), byte_encoder("byte_bpe_50k.json")
    for t in ("", " a  b   c \n\n d", "it's 12,345 o'clock!", "é 中文 🙂\x00", "<|endoftext|>x", "a" * 3000, "\t\r\n  "):
        assert own(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_pack(docs, none):
    rows = packing.pack(docs, group_docs=20, with_ids=True).collect()
    library = _load(tokenizer_path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    copies = Counter({d: len(v) for d, v in want.items()})
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
    assert set(pieces) == set(want)
    for d, ps in pieces.items():
        ids = want[d][0]
        cover = Counter()
        for p in ps:
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids[p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(ids)
            cover.update(range(p["start"], p["start"] + p["length"]))
        assert cover == Counter({i: copies[d] for i in range(len(ids))})
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_very_long_white_space():
    """A run of blanks on which the fast engine's pattern gives up has the library's ids."""
    import numpy as np

    from treeloom.llm.tokenization import _load, byte_encoder, tokenizer_path

    encode = byte_encoder("byte_bpe_50k.json")
    library = _load(tokenizer_path("byte_bpe_50k.json"))
    for text in ("a" + " " * 1_200_000 + "b", "\n" * 1_200_000):
        assert np.array_equal(encode(text), np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
