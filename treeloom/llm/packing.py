"""Packing of documents into fixed-length training sequences.

First-fit decreasing, run independently in randomised groups of documents.  A
tournament tree over the free room of a group's bins finds the leftmost bin that
takes a piece in O(log bins).  All pieces go through one shuffle by group,
whole sequences cut from long documents too.  A group is a hash of doc_id, so a
frequent source is spread over all groups, but one huge document, or one doc_id in
very many rows, is one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text
from .tokenization import byte_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
_SCHEMA = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in _COLUMNS])
#: Rows of a batch sent back to Spark.
_ROWS = 4096


class TournamentTree:
    """The free room of bins; ``place`` takes the leftmost bin with enough of it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)
        self.used = 0

    def place(self, length: int) -> int:
        best, at = self.best, 1
        if best[1] < length:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if best[at] < length:
                at += 1
        found = at - self.leaves
        best[at] -= length
        while at > 1:
            at //= 2
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if left >= right else right
        self.used = max(self.used, found + 1)
        return found


def first_fit_decreasing(lengths: list[int], room: int) -> list[int]:
    """The bin of each piece; ``lengths`` must not increase."""
    tree = TournamentTree(max(1, len(lengths)), room)
    return [tree.place(n) for n in lengths]


def fill_gaps(bins: list[list[tuple]], room: int, least: int) -> list[list[tuple]]:
    """Pour the emptiest bins into gaps of at least ``least`` in the others.

    A bin is a list of (length, start, owner) parts; documents may be cut
    anywhere, and cutting the few in the emptiest bins removes padding that
    first-fit decreasing leaves at its end.
    """
    order = sorted(bins, key=lambda b: sum(p[0] for p in b))
    gaps = [room - sum(p[0] for p in b) for b in order]
    low, high = 0, len(order) - 1
    while low < high:
        if gaps[high] < least:
            high -= 1
            continue
        if not order[low]:
            low += 1
            continue
        length, start, owner = order[low].pop()
        part = min(length, gaps[high])
        order[high].append((part, start, owner))
        gaps[high] -= part
        gaps[low] += part
        if part < length:
            order[low].append((length - part, start + part, owner))
    return [b for b in order if b]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def pack(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", seq_len: int = 1024, end_id: int = 0,
         group_docs: int = 2048, least_gap: int = 32, seed: int = 17, with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``seq_len`` ids.

    A row for each piece: doc_id, start (the document's ids before it), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens
    (with the end id), sequence_id, offset (place in the sequence) and ids
    (little-endian unsigned 32-bit, null unless ``with_ids``).

    A null or empty text is a document of the end id alone.  Repeated rows are
    documents of their own.  A null doc_id stays null.  No documents give no
    pieces.  Columns other than the two are not read.
    """
    n_groups = max(1, -(-docs.count() // group_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer)
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype(np.uint32)
                n = len(ids)
                for start in range(0, n, seq_len):
                    part = ids[start : start + seq_len]
                    whole = len(part) == seq_len
                    kept = part.astype("<u4").tobytes() if with_ids else None if whole else part.astype("<u4").tobytes()
                    rows.append((doc_id, start, len(part), _crc(part) if whole else None, n, None, 0 if whole else None, kept))
                    held += len(kept or b"")
                if len(rows) >= _ROWS or held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def arrange(pieces: pa.Table) -> pa.Table:
        group = pieces["grp"][0].as_py()
        doc, start, length, tokens, whole = (pieces[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids_crc32"))
        ids = pieces["ids"]
        order = sorted(range(len(doc)), key=lambda i: (-length[i], doc[i] is not None, doc[i], start[i]))
        full = [i for i in order if whole[i] is not None]
        rest = [i for i in order if whole[i] is None]
        bins: list[list[tuple]] = [[] for _ in rest]
        for i, b in zip(rest, first_fit_decreasing([length[i] for i in rest], seq_len)):
            bins[b].append((length[i], start[i], i))
        packed = fill_gaps([b for b in bins if b], seq_len, least_gap)
        rows, base = [], group << 32
        for i in full:
            rows.append((doc[i], start[i], length[i], whole[i], tokens[i], base, 0, ids[i].as_py() if with_ids else None))
            base += 1
        for parts in packed:
            offset = 0
            for n, at, i in parts:
                own = np.frombuffer(ids[i].as_py(), "<u4")[at - start[i] : at - start[i] + n]
                rows.append((doc[i], at, n, _crc(own), tokens[i], base, offset, own.tobytes() if with_ids else None))
                offset += n
            base += 1
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    pieces = texts.mapInArrow(cut, PIECES)
    group = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_groups)).alias("grp")
    return pieces.select("*", group).groupBy("grp").applyInArrow(arrange, PIECES)
