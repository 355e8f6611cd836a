"""Character references of HTML text and attribute values."""

from __future__ import annotations

import html.entities
import re

_NAMES = html.entities.html5
_LONGEST = max(map(len, _NAMES))
_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([a-zA-Z][a-zA-Z0-9]*;?))")
# What numeric references in the C1 range stand for (Windows-1252).
_C1 = dict(zip(
    (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F),
    "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ",
))


def _number(code: int) -> str:
    if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "�"
    return _C1.get(code) or chr(code)


def unescape(text: str, *, attribute: bool = False) -> str:
    """Decode character references; the longest name wins.

    In an attribute value a name without a semicolon stays as it is before ``=``
    or a letter or digit.
    """
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1] is not None or m[2] is not None:
            digits, base = (m[1], 16) if m[1] is not None else (m[2], 10)
            return _number(int(digits, base) if len(digits) < 16 else 0x110000)
        name = m[3]
        for n in range(min(len(name), _LONGEST), 1, -1):
            found = _NAMES.get(name[:n])
            if found is not None:
                if attribute and name[n - 1] != ";":
                    after = name[n : n + 1] or text[m.end() : m.end() + 1]
                    if after == "=" or after.isascii() and after.isalnum():
                        return m[0]
                return found + name[n:]
        return m[0]

    return _REFERENCE.sub(one, text)
