from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, keep_id long, size int"

TEXTS = [
    None, "", " ", "a", "Same text here.", "same TEXT here.", "SAME text here.", "two words", "three little words", "é É ñ Ñ ß", "x" * 5000, "word " * 3000,
    "token = \"abcdef\" and api_key: 123456 Passwd='zzzzz' password=ABC/+=.-_9", "AKIA" + "B" * 16 + " AKIA123 " + "0123456789abcdef" * 2 + " deadbeef",
    "Released under the MIT License.\nunder the mit license under the mit license", "Licensed under the Apache License, Version 2.0.\nCC BY-NC 4.0", "under the mit-license\nCC by-nc", "<|endoftext|> ,,, a.b.c",
    "you are an idiot and a moron, you pathetic clown", "🙂 emoji ‮ text 中文 字", "\t tabs\nand\r\nlines\x0b\x0c", "Kſ ſecret=abcdefgh toKen:12345678",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "e", i, i) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"document number {i} " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 40)), "de", "big", 0, None, None, None) for i in range(60)]
    rows += [rows[4], rows[4], rows[30]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
