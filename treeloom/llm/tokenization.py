"""Encoders for the public tokenizer files.

``byte_encoder`` reads a byte-level BPE from its ``tokenizers`` JSON and runs it
with the rank-merging engine of ``tiktoken``; it checks that the file's ids are
in merge order, which makes the two engines equal, and otherwise uses the
``tokenizers`` library itself.  ``UnitEncoder`` encodes with the ``tokenizers``
library and keeps the ids of the units between single spaces, bounded in
number, because a corpus repeats most of its words.
"""

from __future__ import annotations

import functools
import json
import os
import string
import unicodedata
from collections.abc import Callable

import numpy as np


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, to bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def vocabulary_size(name_or_path: str) -> int:
    return _load(tokenizer_path(name_or_path)).get_vocab_size()


@functools.lru_cache(maxsize=4)
def byte_encoder(name_or_path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, equal to ``encode(text, add_special_tokens=False).ids``."""
    path = tokenizer_path(name_or_path)
    spec = json.loads(open(path, encoding="utf-8").read())
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    chars = _byte_characters()
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in special}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    in_order = all(vocabulary.get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges))
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    if not (in_order and plain and len(vocabulary) == 256 + len(merges)):
        library = _load(path)
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(chars[c] for c in k): v for k, v in vocabulary.items()}
    engine = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return engine.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its pattern gives up on white space of a million characters or more
            return np.array(_load(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


class UnitEncoder:
    """Ids of whole texts, little-endian, from the ids of their space-separated units.

    For a tokenizer that lower-cases, drops white space before it looks at words
    and marks the ends of words (as its vocabulary shows), a text's ids are those
    of the parts between spaces, one after the other.  At most ``max_units`` units
    are kept; then the memory is emptied and filled anew.
    """

    #: Words encoded in one call; the marks of their ends part their ids again.
    _TOGETHER = 500

    def __init__(self, name_or_path: str, dtype: str, max_units: int = 400_000):
        self.library = _load(tokenizer_path(name_or_path))
        self.dtype, self.max_units = dtype, max_units
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Units that are one word each."""
        groups = [words[i : i + self._TOGETHER] for i in range(0, len(words), self._TOGETHER)]
        for group, found in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, dtype=np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                packed, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
                at = 0
                for word, stop in zip(group, (stops * width).tolist()):
                    self.known[word] = packed[at:stop]
                    at = stop
            else:
                self._learn_units(group)

    def _learn_units(self, units: list[str]) -> None:
        for unit, found in zip(units, self.library.encode_batch_fast(units, add_special_tokens=False)):
            self.known[unit] = self._bytes(found.ids)

    def _learn(self, units: set[str]) -> None:
        if len(self.known) + 2 * len(units) > self.max_units:
            self.known = {"": b""}
        known = self.known
        # ASCII punctuation after a letter or digit is a word of its own.
        cut = {}
        for u in units:
            base = u.rstrip(string.punctuation)
            # Some letters are followed by a mark when lower-cased.
            if base != u and base and base[-1].isalnum() and len(base[-1].lower()) == 1 and "<|" not in u:
                cut[u] = base
        bare = {cut.get(u, u) for u in units}.union(u[len(base) :] for u, base in cut.items()).difference(known)
        words = [u for u in bare if u.isalpha()]
        if words:
            self._learn_words(words)
        if others := [u for u in bare if not u.isalpha()]:
            self._learn_units(others)
        for unit, base in cut.items():
            known[unit] = known[base] + known[unit[len(base) :]]

    @staticmethod
    def _plain(text: str) -> str:
        """The text with fewer different units, if that changes no id."""
        text = text.replace("\n", " ")
        if "<|" in text:  # may be a special token, which counts as written
            return text
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return low if low.isascii() or unicodedata.is_normalized("NFC", low) else text

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = [self._plain(t).split(" ") for t in texts]
        found = [list(map(self.known.get, units)) for units in parts]
        new = {u for units, ids in zip(parts, found) if None in ids for u, x in zip(units, ids) if x is None}
        if new:
            self._learn(new)
            known = self.known
            for units, ids in zip(parts, found):
                if None in ids:
                    for i, x in enumerate(ids):
                        if x is None:
                            ids[i] = known[units[i]]
        return [b"".join(ids) for ids in found]


@functools.lru_cache(maxsize=2)
def unit_encoder(name_or_path: str, dtype: str) -> UnitEncoder:
    """One encoder for each worker process."""
    return UnitEncoder(name_or_path, dtype)
