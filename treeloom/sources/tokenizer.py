"""The HTML tokenizer.

A pull tokenizer: the tree builder asks for tokens and sets the content model
(``rcdata``, ``rawtext``, ``script``, ``plaintext``) after start tags, so raw text
and foreign content need no second pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from .entities import unescape

SPACE = "\t\n\f\r "


@dataclass
class StartTag:
    name: str
    attrs: list[tuple[str, str]] = field(default_factory=list)
    self_closing: bool = False


@dataclass
class EndTag:
    name: str


@dataclass
class Characters:
    data: str


@dataclass
class Comment:
    data: str


@dataclass
class Doctype:
    name: str | None
    public_id: str | None = None
    system_id: str | None = None
    force_quirks: bool = False


Token = StartTag | EndTag | Characters | Comment | Doctype

RCDATA = ("title", "textarea")
RAWTEXT = ("style", "xmp", "iframe", "noembed", "noframes")

_NAME_END = re.compile(r"[\t\n\f />]")
_ATTRIBUTE_NAME_END = re.compile(r"[\t\n\f />=]")
_SPACES = re.compile(r"[\t\n\f ]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]*")
_COMMENT_END = re.compile(r"--!?>")
#: Tags without references, nulls or errors; any other is read attribute by attribute.
_VALUE = r"\"([^\"&\0]*)\"|'([^'&\0]*)'|([^\t\n\f\r \"'`=<>&\0]+)"
_PLAIN_ATTRIBUTE = re.compile(rf"[\t\n\f ]+([A-Za-z_][A-Za-z0-9_.:-]*)(?:=(?:{_VALUE}))?")
_PLAIN_START = re.compile(r"<([A-Za-z][A-Za-z0-9]*)((?:[\t\n\f ]+[A-Za-z_][A-Za-z0-9_.:-]*(?:=(?:\"[^\"&\0]*\"|'[^'&\0]*'|[^\t\n\f\r \"'`=<>&\0]+))?+)*+)[\t\n\f ]*+>")
_PLAIN_END = re.compile(r"</([A-Za-z][A-Za-z0-9]*)[\t\n\f ]*>")


def normalize_newlines(html: str) -> str:
    return html.replace("\r\n", "\n").replace("\r", "\n") if "\r" in html else html


def lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


@lru_cache(maxsize=16384)
def _plain_attributes(text: str) -> tuple[tuple[str, str], ...]:
    """The attributes of a plain start tag; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _PLAIN_ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return tuple(out.items())


class Tokenizer:
    def __init__(self, html: str):
        self.text = normalize_newlines(html)
        self.at = 0
        self.model: str | None = None  # rcdata, rawtext, script, plaintext
        self.last_start = ""
        self.cdata_allowed = False  # set by the tree builder in foreign content

    def __iter__(self) -> Iterator[Token]:
        while (t := self.next()) is not None:
            yield t

    def next(self) -> Token | None:
        """The next token; None at the end."""
        while self.at < len(self.text):
            if self.model is not None:
                if (t := self._raw()) is not None:
                    return t
                continue
            text, at = self.text, self.at
            if text[at] != "<":
                end = text.find("<", at)
                end = len(text) if end < 0 else end
                self.at = end
                return Characters(unescape(text[at:end]))
            following = text[at + 1 : at + 2]
            if following.isascii() and following.isalpha():
                if (t := self._start_tag()) is not None:
                    return t
                continue
            if following == "/":
                after = text[at + 2 : at + 3]
                if after.isascii() and after.isalpha():
                    if (t := self._end_tag()) is not None:
                        return t
                    continue
                if after == ">":
                    self.at = at + 3
                    continue
                if after == "":
                    self.at = len(text)
                    return Characters("</")
                return self._bogus(at + 2)
            if following == "!":
                return self._declaration()
            if following == "?":
                return self._bogus(at + 1)
            self.at = at + 1
            return Characters("<")
        return None

    # -- raw text

    def _raw(self) -> Token | None:
        text, at, model = self.text, self.at, self.model
        if model == "plaintext":
            self.at = len(text)
            return Characters(text[at:].replace("\0", "�"))
        end = self._script_end(at) if model == "script" else self._closing(at)
        if end < 0:
            self.at = len(text)
            self.model = None if model != "plaintext" else model
            data = text[at:]
        else:
            self.at, data = end, text[at:end]
            self.model = None
        if not data:
            return None
        data = data.replace("\0", "�")
        return Characters(unescape(data) if model == "rcdata" else data)

    def _closing(self, at: int) -> int:
        m = re.compile(rf"</{re.escape(self.last_start)}(?=[\t\n\f />])", re.I | re.A).search(self.text, at)
        return m.start() if m else -1

    def _script_end(self, at: int) -> int:
        """Where the script's end tag is; one in an escaped inner script is not."""
        text = self.text
        step = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I | re.A)
        escaped = double = False
        pos = at
        while True:
            m = step.search(text, pos)
            if not m:
                return -1
            pos = m.end()
            if m[0] == "<!--":
                escaped = True
                pos = m.start() + 2  # "<!-->" ends at once
            elif m[0] == "-->":
                escaped = double = False
            elif m[1]:
                if not double:
                    return m.start()
                double = False
            elif escaped:
                double = True

    # -- tags

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """Attributes from ``at``, whether the tag closes itself, and its end, -1 if it has none."""
        text, n = self.text, len(self.text)
        attrs: list[tuple[str, str]] = []
        seen: set[str] = set()
        while True:
            at = _SPACES.match(text, at).end()
            if at >= n:
                return attrs, False, -1
            c = text[at]
            if c == ">":
                return attrs, False, at + 1
            if c == "/":
                if text[at + 1 : at + 2] == ">":
                    return attrs, True, at + 2
                at += 1
                continue
            m = _ATTRIBUTE_NAME_END.search(text, at + 1)  # a leading "=" is part of the name
            if not m:
                return attrs, False, -1
            name = lower(text[at : m.start()]).replace("\0", "�")
            at = _SPACES.match(text, m.start()).end()
            value = ""
            if text[at : at + 1] == "=":
                at = _SPACES.match(text, at + 1).end()
                quote = text[at : at + 1]
                if quote and quote in "\"'":
                    end = text.find(quote, at + 1)
                    if end < 0:
                        return attrs, False, -1
                    value, at = text[at + 1 : end], end + 1
                elif quote == ">":
                    pass
                else:
                    end = _UNQUOTED.match(text, at).end()
                    if end >= n:
                        return attrs, False, -1
                    value, at = text[at:end], end
            if name not in seen:
                seen.add(name)
                attrs.append((name, unescape(value, attribute=True).replace("\0", "�")))

    def _name(self, at: int) -> tuple[str, int]:
        m = _NAME_END.search(self.text, at)
        if not m:
            return "", -1
        return lower(self.text[at : m.start()]).replace("\0", "�"), m.start()

    def _start_tag(self) -> Token | None:
        if m := _PLAIN_START.match(self.text, self.at):
            self.at, self.last_start = m.end(), m[1].lower()
            # Only short texts are worth keeping.
            read = _plain_attributes if m.end(2) - m.start(2) < 256 else _plain_attributes.__wrapped__
            return StartTag(self.last_start, list(read(m[2])) if m[2] else [])
        name, at = self._name(self.at + 1)
        attrs, closing, end = self._attributes(at) if at >= 0 else ([], False, -1)
        if end < 0:  # the text ends within the tag
            self.at = len(self.text)
            return None
        self.at, self.last_start = end, name
        return StartTag(name, attrs, closing)

    def _end_tag(self) -> Token | None:
        if m := _PLAIN_END.match(self.text, self.at):
            self.at = m.end()
            return EndTag(m[1].lower())
        name, at = self._name(self.at + 2)
        end = self._attributes(at)[2] if at >= 0 else -1
        if end < 0:
            self.at = len(self.text)
            return None
        self.at = end
        return EndTag(name)

    # -- declarations

    def _bogus(self, at: int) -> Token:
        end = self.text.find(">", at)
        data = self.text[at:] if end < 0 else self.text[at:end]
        self.at = len(self.text) if end < 0 else end + 1
        return Comment(data.replace("\0", "�"))

    def _declaration(self) -> Token:
        text, at = self.text, self.at
        if text.startswith("<!--", at):
            return self._comment(at + 4)
        if text[at + 2 : at + 9].lower() == "doctype":
            return self._doctype(at + 9)
        if self.cdata_allowed and text.startswith("<![CDATA[", at):
            end = text.find("]]>", at + 9)
            self.at = len(text) if end < 0 else end + 3
            return Characters(text[at + 9 :] if end < 0 else text[at + 9 : end])
        return self._bogus(at + 2)

    def _comment(self, at: int) -> Token:
        text = self.text
        for early in (">", "->"):
            if text.startswith(early, at):
                self.at = at + len(early)
                return Comment("")
        m = _COMMENT_END.search(text, at)
        if m:
            self.at = m.end()
            return Comment(text[at : m.start()].replace("\0", "�"))
        self.at = len(text)
        data = text[at:]
        for tail in ("--!", "--", "-"):
            if data.endswith(tail):
                data = data[: -len(tail)]
                break
        return Comment(data.replace("\0", "�"))

    def _doctype(self, at: int) -> Token:
        text = self.text
        end = text.find(">", at)
        # A ">" inside a quoted identifier still ends the doctype.
        body = text[at:] if end < 0 else text[at:end]
        self.at = len(text) if end < 0 else end + 1
        m = re.compile(r"[\t\n\f ]*([^\t\n\f ]*)[\t\n\f ]*(.*)\Z", re.S).match(body)
        name = lower(m[1]).replace("\0", "�") or None
        t = Doctype(name, force_quirks=end < 0 or name is None)
        rest = m[2]
        if not rest:
            return t
        key = rest[:6].lower()
        if key not in ("public", "system"):
            t.force_quirks = True
            return t
        quoted = re.compile(r"[\t\n\f ]*(?:\"([^\"]*)(\"|\Z)|'([^']*)('|\Z))", re.S)
        first = quoted.match(rest, 6)
        if not first:
            t.force_quirks = True
            return t
        value = lambda q: (q[1] if q[1] is not None else q[3]).replace("\0", "�")
        whole = lambda q: bool(q[2] or q[4])
        if key == "system":
            t.system_id = value(first)
        else:
            t.public_id = value(first)
            second = quoted.match(rest, first.end()) if whole(first) else None
            if second:
                t.system_id = value(second)
                first = second
        if not whole(first):
            t.force_quirks = True
        return t


def tokenize(html: str) -> list[Token]:
    """All tokens of a document's text; adjacent characters are one token."""
    t = Tokenizer(html)
    out: list[Token] = []
    for token in t:
        if isinstance(token, StartTag):
            t.model = content_model(token.name)
        if isinstance(token, Characters) and out and isinstance(out[-1], Characters):
            out[-1] = Characters(out[-1].data + token.data)
        else:
            out.append(token)
    return out


def content_model(name: str) -> str | None:
    """How the text after a start tag is read."""
    if name in RCDATA:
        return "rcdata"
    if name in RAWTEXT:
        return "rawtext"
    return name if name in ("script", "plaintext") else None


def fragment_tokens(html: str, context: str) -> list[Token]:
    """Tokens of the content of a ``context`` element."""
    t = Tokenizer(html)
    t.model, t.last_start = content_model(context), context
    out = []
    for token in t:
        if isinstance(token, StartTag):
            t.model = content_model(token.name)
        out.append(token)
    return out
