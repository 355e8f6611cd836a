"""Token-id files with Elias-Fano encoded document boundaries.

A file holds the ids of a range of documents in ascending order of doc_id, one
after the other, and no table of offsets: the boundaries are Elias-Fano encoded.

Layout, little-endian: the magic, the lengths of the three parts (64-bit each),
width of an id in bytes and the number of leading documents without an id (64-bit
each); the boundaries (n + 1 of them, from 0), the doc_ids (64-bit), the token ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import full_text, scratch_path, staged
from .elias_fano import EliasFano
from .ranges import in_ranges
from .tokenization import unit_encoder, vocabulary_size

_MAGIC = b"TLTOKEN1"
_HEAD = struct.Struct("<8sQQQQQ")


def pack_file(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The file of documents in order; ids are little-endian integers of ``width`` bytes."""
    lengths = np.array([len(x) // width for x in ids], dtype=np.uint64)
    bounds = EliasFano.encode(np.concatenate([np.zeros(1, np.uint64), np.cumsum(lengths)])).to_bytes()
    nulls = sum(d is None for d in doc_ids)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    body = b"".join(ids)
    return b"".join([_HEAD.pack(_MAGIC, len(bounds), len(keys), len(body), width, nulls), bounds, keys, body])


class TokenFile:
    """A file's content; documents are found by select, without a table."""

    def __init__(self, data: bytes):
        magic, n_bounds, n_keys, n_body, self.width, self.nulls = _HEAD.unpack_from(data)
        if magic != _MAGIC or len(data) != _HEAD.size + n_bounds + n_keys + n_body:
            raise ValueError("not a whole token file")
        view = memoryview(data)[_HEAD.size :]
        self.bounds = EliasFano.from_bytes(view[:n_bounds])
        self.keys = np.frombuffer(view[n_bounds : n_bounds + n_keys], "<i8")
        self.ids = np.frombuffer(view[n_bounds + n_keys :], f"<u{self.width}")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.keys[i])

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of document i."""
        return self.ids[self.bounds.get(i) : self.bounds.get(i + 1)]


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole: under another name first, so a lost task leaves no part of it."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def _get(folder: str, name: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read()


def write(docs: DataFrame, folder: str, *, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, docs_per_file: int = 2048, bytes_per_file: int = 64 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) to token files in ``folder``; returns the manifest.

    The manifest has a row per file: range and part (files ascend by them), n_docs,
    n_tokens, file.  A file has at most ``docs_per_file`` documents and ends
    with the one that reaches ``bytes_per_file``.  Every document ends with ``end_id``.  A null text is empty, a null
    doc_id comes first, repeated ids are in order of their texts.  A task that is
    run again writes the same file again.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    ranged, _ = in_ranges(docs, docs_per_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
        encoder = unit_encoder(tokenizer, f"<u{width}")
        end = int(end_id).to_bytes(width, "little")
        now, number, keys, ids, held = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{now:06d}-{number:06d}.tok"
            _put(folder, name, pack_file(keys, ids, width))
            return pa.RecordBatch.from_pydict({"range": pa.array([now], pa.int32()), "part": pa.array([number], pa.int32()), "n_docs": [len(keys)], "n_tokens": [sum(map(len, ids)) // width], "file": [name]})

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                encoded = encoder.encode_batch(part["text"].to_pylist())
                for r, d, x in zip(part["range"].to_pylist(), part["doc_id"].to_pylist(), encoded):
                    if r != now or len(keys) >= docs_per_file or held >= bytes_per_file:
                        if keys:
                            yield close()
                        now, number, keys, ids, held = r, number + 1 if r == now else 0, [], [], 0
                    keys.append(d)
                    ids.append(x + end)
                    held += len(ids[-1])
        if keys:
            yield close()

    rows = ranged.repartition("range").sortWithinPartitions("range", "doc_id", "text")
    return staged(rows.mapInArrow(run, "range int, part int, n_docs long, n_tokens long, file string"), "token-manifest")


def read(folder: str, manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """A row per document of the files that ``manifest`` lists: doc_id, start, n_tokens, ids_crc32, ids.

    start is the number of ids in all documents before, over all files; ids are
    little-endian unsigned 32-bit integers (null unless ``with_ids``), ids_crc32
    is of them.
    """
    spark = manifest.sparkSession
    none = F.lit(0).cast("long")
    # One row per range goes into one task, and within a range one per file.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = manifest.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", F.coalesce(F.sum("n").over(before), none).alias("first"))
    within = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(ranges, "range").select("file", (F.col("first") + F.coalesce(F.sum("n_tokens").over(within), none)).alias("base"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, name in zip(batch["base"].to_pylist(), batch["file"].to_pylist()):
                f = TokenFile(_get(folder, name))
                for at in range(0, len(f), 512):
                    own = range(at, min(len(f), at + 512))
                    bounds = f.bounds.span(at, own.stop + 1)
                    ids = [f.ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([f.doc_id(i) for i in own], pa.int64()), "start": pa.array(base + bounds[:-1]),
                        "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        "ids": pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                    })

    # Every task opens its own files; no table of them is sent to all.
    return files.repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, *, with_ids: bool = False, **how) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read(folder, write(docs, folder, **how), with_ids=with_ids)
