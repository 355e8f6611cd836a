"""Tree construction after the HTML standard, scripting disabled.

One document is sequential by nature; a corpus is parallel across documents.
"""

from __future__ import annotations

from ..schema import ATTRIBUTE_NAMESPACES, HTML, MATHML, SVG
from .tokenizer import SPACE, Characters, Comment, Doctype, EndTag, StartTag, Token, Tokenizer, content_model

# Fixed values of the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details"
    " dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext"
    " pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
SPECIAL_FOREIGN = frozenset([(MATHML, n) for n in "mi mo mn ms mtext annotation-xml".split()] + [(SVG, n) for n in ("foreignObject", "desc", "title")])
SCOPE = frozenset("applet caption html table td th marquee object select template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IMPLIED_ALL = IMPLIED | frozenset("caption colgroup tbody td tfoot th thead tr".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main"
    " menu nav ol p search section summary ul".split()
)
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p"
    " pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SVG_TAGS = {n.lower(): n for n in (
    "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer"
    " feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG"
    " feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile"
    " feTurbulence foreignObject glyphRef linearGradient radialGradient textPath").split()}
SVG_ATTRIBUTES = {n.lower(): n for n in (
    "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef"
    " gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle"
    " markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform"
    " patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur"
    " requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles"
    " surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan").split()}
_FOREIGN_ATTRIBUTES = frozenset("xlink:actuate xlink:arcrole xlink:href xlink:role xlink:show xlink:title xlink:type xml:lang xml:space xmlns xmlns:xlink".split())
_QUIRKY_PREFIXES = tuple(p.lower() for p in (
    "+//Silmaril//dtd html Pro v0r11 19970101//", "-//AS//DTD HTML 3.0 asWedit + extensions//", "-//IETF//DTD HTML ", "-//IETF//DTD HTML//",
    "-//W3C//DTD HTML 3", "-//W3C//DTD HTML 4.0 Frameset//", "-//W3C//DTD HTML 4.0 Transitional//", "-//W3C//DTD W3 HTML//",
    "-//Netscape Comm. Corp.//DTD", "-//Microsoft//DTD Internet Explorer", "-//O'Reilly and Associates//DTD HTML", "-//WebTechs//DTD Mozilla HTML"))


class Node:
    """A node of the tree under construction; attributes are (prefix, local, url, qname, value)."""

    __slots__ = ("kind", "name", "ns", "attrs", "children", "parent", "value", "public_id", "system_id", "content")

    def __init__(self, kind: str, name: str | None = None, ns: str | None = None, attrs=(), value: str | None = None):
        self.kind, self.name, self.ns, self.value = kind, name, ns, value
        self.attrs = list(attrs)
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.public_id = self.system_id = None
        self.content: Node | None = None

    def append(self, child: Node, before: Node | None = None) -> None:
        if child.parent is not None:
            child.remove()
        child.parent = self
        if before is None:
            self.children.append(child)
        else:
            self.children.insert(self.children.index(before), child)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def get(self, qname: str) -> str | None:
        return next((a[4] for a in self.attrs if a[3] == qname), None)

    def clone(self) -> Node:
        out = Node(self.kind, self.name, self.ns, self.attrs, self.value)
        out.public_id, out.system_id = self.public_id, self.system_id
        if self.content is not None:
            out.content = self.content.clone()
        for c in self.children:
            out.append(c.clone())
        return out

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


def plain(attrs: list[tuple[str, str]]) -> list[tuple]:
    return [(None, n, None, n, v) for n, v in attrs]


def foreign(attrs: list[tuple[str, str]], ns: str) -> list[tuple]:
    out = []
    for n, v in attrs:
        if ns == SVG:
            n = SVG_ATTRIBUTES.get(n, n)
        elif n == "definitionurl":
            n = "definitionURL"
        if n in _FOREIGN_ATTRIBUTES:
            prefix, _, local = n.rpartition(":")
            out.append((prefix or None, local, ATTRIBUTE_NAMESPACES[prefix or "xmlns"], n, v))
        else:
            out.append((None, n, None, n, v))
    return out


_MARKER = object()


class TreeBuilder:
    def __init__(self, html: str, context: str | None = None):
        self.tokens = Tokenizer(html)
        self.document = Node("document")
        self.open: list[Node] = []
        self.formatting: list = []
        self.modes: list = []  # of templates
        self.mode = self.initial
        self.back = self.initial
        self.head: Node | None = None
        self.form: Node | None = None
        self.frameset_ok = True
        self.foster = False
        self.quirks = False
        self.pending: list[str] = []
        self.skip_newline = False
        self.context: Node | None = None
        self.done = False
        if context is not None:
            self._start_fragment(context)

    # -- running

    def run(self) -> Node:
        while not self.done and (token := self.tokens.next()) is not None:
            if self.skip_newline:
                self.skip_newline = False
                if isinstance(token, Characters) and token.data.startswith("\n"):
                    token = Characters(token.data[1:])
                    if not token.data:
                        continue
            self.process(token)
            node = self.adjusted()
            self.tokens.cdata_allowed = node is not None and node.ns != HTML
        self.process(None)
        reflect_selected(self.document)
        return self.document

    def process(self, token: Token | None) -> None:
        (self.foreign if self.is_foreign(token) else self.mode)(token)

    def again(self, mode, token) -> None:
        self.mode = mode
        self.process(token)

    def _start_fragment(self, context: str) -> None:
        prefix, _, name = context.rpartition(" ")
        ns = {"svg": SVG, "math": MATHML}.get(prefix, HTML)
        self.context = Node("element", name, ns)
        if ns == HTML:
            self.tokens.model, self.tokens.last_start = content_model(name), name
        root = Node("element", "html", HTML)
        self.document.append(root)
        self.open.append(root)
        if name == "template" and ns == HTML:
            self.modes.append(self.in_template)
        self.reset()
        if name == "form" and ns == HTML:
            self.form = self.context

    # -- the stack of open elements

    @property
    def current(self) -> Node:
        return self.open[-1]

    def adjusted(self) -> Node | None:
        if self.context is not None and len(self.open) == 1:
            return self.context
        return self.open[-1] if self.open else None

    def is_open(self, name: str) -> bool:
        return any(n.name == name and n.ns == HTML for n in self.open)

    def in_scope(self, names, extra=(), only=None) -> bool:
        names = {names} if isinstance(names, str) else names
        for n in reversed(self.open):
            if n.ns == HTML and n.name in names:
                return True
            if only is not None:
                if n.ns == HTML and n.name in only:
                    return False
            elif n.ns == HTML and (n.name in SCOPE or n.name in extra) or (n.ns, n.name) in SPECIAL_FOREIGN:
                return False
        return False

    def in_button_scope(self, name: str) -> bool:
        return self.in_scope(name, ("button",))

    def in_table_scope(self, names) -> bool:
        return self.in_scope(names, only=("html", "table", "template"))

    def node_in_scope(self, node: Node) -> bool:
        for n in reversed(self.open):
            if n is node:
                return True
            if n.ns == HTML and n.name in SCOPE or (n.ns, n.name) in SPECIAL_FOREIGN:
                return False
        return False

    def pop_until(self, *names: str) -> None:
        while self.open:
            n = self.open.pop()
            if n.ns == HTML and n.name in names:
                return

    def clear_to(self, *names: str) -> None:
        while not (self.current.ns == HTML and self.current.name in names):
            self.open.pop()

    def imply(self, but: str | None = None, names=IMPLIED) -> None:
        while self.open and self.current.ns == HTML and self.current.name in names and self.current.name != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_button_scope("p"):
            self.imply("p")
            self.pop_until("p")

    # -- insertion

    def place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """The parent and the child to insert before."""
        target = target or self.current
        if self.foster and target.ns == HTML and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name == "table" and self.open[i].ns == HTML), None)
            template = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name == "template" and self.open[i].ns == HTML), None)
            if template is not None and (table is None or template > table):
                return self.open[template].content, None
            if table is None:
                return self.open[0], None
            node = self.open[table]
            if node.parent is not None:
                return node.parent, node
            target = self.open[table - 1]
        if target.content is not None:
            return target.content, None
        return target, None

    def insert(self, name: str, attrs=(), ns: str = HTML) -> Node:
        node = Node("element", name, ns, attrs)
        if name == "template" and ns == HTML:
            node.content = Node("document_fragment")
        parent, before = self.place()
        if parent.kind != "document" or not any(c.kind == "element" for c in parent.children):
            parent.append(node, before)
        self.open.append(node)
        return node

    def insert_tag(self, t: StartTag) -> Node:
        return self.insert(t.name, plain(t.attrs))

    def insert_void(self, t: StartTag) -> None:
        self.insert_tag(t)
        self.open.pop()

    def text(self, data: str) -> None:
        parent, before = self.place()
        if parent.kind == "document" or not data:
            return
        at = len(parent.children) if before is None else parent.children.index(before)
        if at and parent.children[at - 1].kind == "text":
            parent.children[at - 1].value += data
        else:
            parent.append(Node("text", value=data), before)

    def comment(self, t: Comment, parent: Node | None = None) -> None:
        before = None
        if parent is None:
            parent, before = self.place()
        parent.append(Node("comment", value=t.data), before)

    def raw(self, t: StartTag, model: str) -> None:
        self.insert_tag(t)
        self.tokens.model = model
        self.back, self.mode = self.mode, self.in_text

    def merge(self, node: Node, t: StartTag) -> None:
        have = {a[3] for a in node.attrs}
        node.attrs += [a for a in plain(t.attrs) if a[3] not in have]

    # -- active formatting elements

    def push_formatting(self, node: Node) -> None:
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            f = self.formatting[i]
            if f is _MARKER:
                break
            if f.name == node.name and f.ns == node.ns and sorted(f.attrs, key=str) == sorted(node.attrs, key=str):
                same.append(i)
        if len(same) >= 3:
            del self.formatting[same[-1]]
        self.formatting.append(node)

    def reconstruct(self) -> None:
        f = self.formatting
        if not f or f[-1] is _MARKER or f[-1] in self.open:
            return
        i = len(f) - 1
        while i > 0 and f[i - 1] is not _MARKER and f[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(f)):
            f[k] = self.insert(f[k].name, f[k].attrs)

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not _MARKER:
            pass

    def find_formatting(self, name: str) -> Node | None:
        for f in reversed(self.formatting):
            if f is _MARKER:
                return None
            if f.name == name:
                return f
        return None

    def adopt(self, name: str) -> bool:
        """The adoption agency; False asks for the rules of any other end tag."""
        if self.current.ns == HTML and self.current.name == name and self.current not in self.formatting:
            self.open.pop()
            return True
        for _ in range(8):
            element = self.find_formatting(name)
            if element is None:
                return False
            if element not in self.open:
                self.formatting.remove(element)
                return True
            if not self.node_in_scope(element):
                return True
            at = self.open.index(element)
            furthest = next((n for n in self.open[at + 1 :] if self.special(n)), None)
            if furthest is None:
                del self.open[at:]
                self.formatting.remove(element)
                return True
            ancestor = self.open[at - 1]
            bookmark = self.formatting.index(element)
            last = furthest
            i = self.open.index(furthest)
            inner = 0
            while True:
                inner += 1
                i -= 1
                node = self.open[i]
                if node is element:
                    break
                if inner > 3 and node in self.formatting:
                    k = self.formatting.index(node)
                    del self.formatting[k]
                    if k < bookmark:
                        bookmark -= 1
                if node not in self.formatting:
                    del self.open[i]
                    continue
                copy = Node("element", node.name, node.ns, node.attrs)
                self.formatting[self.formatting.index(node)] = copy
                self.open[i] = copy
                if last is furthest:
                    bookmark = self.formatting.index(copy) + 1
                copy.append(last)
                last = copy
            last.remove()
            parent, before = self.place(ancestor)
            parent.append(last, before)
            copy = Node("element", element.name, element.ns, element.attrs)
            for child in list(furthest.children):
                copy.append(child)
            furthest.append(copy)
            k = self.formatting.index(element)
            del self.formatting[k]
            self.formatting.insert(bookmark - 1 if k < bookmark else bookmark, copy)
            self.open.remove(element)
            self.open.insert(self.open.index(furthest) + 1, copy)
        return True

    @staticmethod
    def special(n: Node) -> bool:
        return n.ns == HTML and n.name in SPECIAL or (n.ns, n.name) in SPECIAL_FOREIGN

    def any_other_end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            n = self.open[i]
            if n.ns == HTML and n.name == name:
                self.imply(name)
                del self.open[i:]
                return
            if self.special(n):
                return

    def reset(self) -> None:
        """The insertion mode that the open elements call for."""
        for i in range(len(self.open) - 1, -1, -1):
            last = i == 0
            node = self.context if last and self.context is not None else self.open[i]
            name = node.name if node.ns == HTML else ""
            if name in ("td", "th") and not last:
                self.mode = self.in_cell
            elif name in _RESET:
                self.mode = getattr(self, _RESET[name])
            elif name == "template":
                self.mode = self.modes[-1]
            elif name == "head" and not last:
                self.mode = self.in_head
            elif name == "html":
                self.mode = self.before_head if self.head is None else self.after_head
            elif last:
                self.mode = self.in_body
            else:
                continue
            return

    # -- modes: the document's head

    def split_space(self, t: Characters) -> tuple[str, str]:
        rest = t.data.lstrip(SPACE)
        return t.data[: len(t.data) - len(rest)], rest

    def initial(self, t) -> None:
        if isinstance(t, Characters):
            t = Characters(t.data.lstrip(SPACE))
            if not t.data:
                return
        elif isinstance(t, Comment):
            return self.comment(t, self.document)
        elif isinstance(t, Doctype):
            node = Node("document_type", t.name or "")
            node.public_id, node.system_id = t.public_id, t.system_id
            self.document.append(node)
            public = (t.public_id or "").lower()
            self.quirks = t.force_quirks or t.name != "html" or public.startswith(_QUIRKY_PREFIXES) or public == "html" or (
                t.system_id is None and public.startswith(("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")))
            self.mode = self.before_html
            return None
        else:
            self.quirks = True
        if isinstance(t, Characters):
            self.quirks = True
        self.again(self.before_html, t)

    def before_html(self, t) -> None:
        if isinstance(t, Doctype):
            return
        if isinstance(t, Comment):
            return self.comment(t, self.document)
        if isinstance(t, Characters):
            t = Characters(t.data.lstrip(SPACE))
            if not t.data:
                return
        if isinstance(t, EndTag) and t.name not in ("head", "body", "html", "br"):
            return
        root = Node("element", "html", HTML, plain(t.attrs) if isinstance(t, StartTag) and t.name == "html" else ())
        self.document.append(root)
        self.open.append(root)
        if isinstance(t, StartTag) and t.name == "html":
            self.mode = self.before_head
        else:
            self.again(self.before_head, t)

    def before_head(self, t) -> None:
        if isinstance(t, Comment):
            return self.comment(t)
        if isinstance(t, Doctype):
            return
        if isinstance(t, Characters):
            t = Characters(t.data.lstrip(SPACE))
            if not t.data:
                return
        if isinstance(t, StartTag) and t.name == "html":
            return self.in_body(t)
        if isinstance(t, EndTag) and t.name not in ("head", "body", "html", "br"):
            return
        is_head = isinstance(t, StartTag) and t.name == "head"
        self.head = self.insert("head", plain(t.attrs) if is_head else ())
        if is_head:
            self.mode = self.in_head
        else:
            self.again(self.in_head, t)

    def in_head(self, t) -> None:
        if isinstance(t, Characters):
            space, rest = self.split_space(t)
            self.text(space)
            if not rest:
                return
            t = Characters(rest)
        elif isinstance(t, Comment):
            return self.comment(t)
        elif isinstance(t, Doctype):
            return
        elif isinstance(t, StartTag):
            n = t.name
            if n == "html":
                return self.in_body(t)
            if n in ("base", "basefont", "bgsound", "link", "meta"):
                return self.insert_void(t)
            if n == "title":
                return self.raw(t, "rcdata")
            if n in ("noframes", "style"):
                return self.raw(t, "rawtext")
            if n == "noscript":
                self.insert_tag(t)
                self.mode = self.in_head_noscript
                return
            if n == "script":
                return self.raw(t, "script")
            if n == "template":
                self.insert_tag(t)
                self.formatting.append(_MARKER)
                self.frameset_ok = False
                self.mode = self.in_template
                self.modes.append(self.in_template)
                return
            if n == "head":
                return
        elif isinstance(t, EndTag):
            if t.name == "head":
                self.open.pop()
                self.mode = self.after_head
                return
            if t.name == "template":
                if not self.is_open("template"):
                    return
                self.imply(names=IMPLIED_ALL)
                self.pop_until("template")
                self.clear_formatting()
                self.modes.pop()
                self.reset()
                return
            if t.name not in ("body", "html", "br"):
                return
        self.open.pop()
        self.again(self.after_head, t)

    def in_head_noscript(self, t) -> None:
        if isinstance(t, Doctype):
            return
        if isinstance(t, StartTag):
            if t.name == "html":
                return self.in_body(t)
            if t.name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
                return self.in_head(t)
            if t.name in ("head", "noscript"):
                return
        if isinstance(t, EndTag):
            if t.name == "noscript":
                self.open.pop()
                self.mode = self.in_head
                return
            if t.name != "br":
                return
        if isinstance(t, Comment):
            return self.in_head(t)
        if isinstance(t, Characters):
            space, rest = self.split_space(t)
            self.text(space)
            if not rest:
                return
            t = Characters(rest)
        self.open.pop()
        self.again(self.in_head, t)

    def after_head(self, t) -> None:
        if isinstance(t, Characters):
            space, rest = self.split_space(t)
            self.text(space)
            if not rest:
                return
            t = Characters(rest)
        elif isinstance(t, Comment):
            return self.comment(t)
        elif isinstance(t, Doctype):
            return
        elif isinstance(t, StartTag):
            if t.name == "html":
                return self.in_body(t)
            if t.name == "body":
                self.insert_tag(t)
                self.frameset_ok = False
                self.mode = self.in_body
                return
            if t.name == "frameset":
                self.insert_tag(t)
                self.mode = self.in_frameset
                return
            if t.name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                self.open.append(self.head)
                self.in_head(t)
                if self.head in self.open:
                    self.open.remove(self.head)
                return
            if t.name == "head":
                return
        elif isinstance(t, EndTag):
            if t.name == "template":
                return self.in_head(t)
            if t.name not in ("body", "html", "br"):
                return
        self.insert("body")
        self.again(self.in_body, t)

    # -- in body

    def in_body(self, t) -> None:
        if isinstance(t, Characters):
            data = t.data.replace("\0", "")
            if data:
                self.reconstruct()
                self.text(data)
                if data.strip(SPACE):
                    self.frameset_ok = False
        elif isinstance(t, Comment):
            self.comment(t)
        elif isinstance(t, StartTag):
            self.body_start(t)
        elif isinstance(t, EndTag):
            self.body_end(t)
        elif t is None and self.modes:
            self.in_template(t)

    def body_start(self, t: StartTag) -> None:
        n = t.name
        if n == "html":
            if not self.is_open("template"):
                self.merge(self.open[0], t)
        elif n in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.in_head(t)
        elif n == "body":
            if len(self.open) > 1 and self.open[1].name == "body" and not self.is_open("template"):
                self.frameset_ok = False
                self.merge(self.open[1], t)
        elif n == "frameset":
            if len(self.open) > 1 and self.open[1].name == "body" and self.frameset_ok:
                self.open[1].remove()
                del self.open[1:]
                self.insert_tag(t)
                self.mode = self.in_frameset
        elif n in BLOCKS:
            self.close_p()
            self.insert_tag(t)
        elif n in HEADINGS:
            self.close_p()
            if self.current.ns == HTML and self.current.name in HEADINGS:
                self.open.pop()
            self.insert_tag(t)
        elif n in ("pre", "listing"):
            self.close_p()
            self.insert_tag(t)
            self.skip_newline = True
            self.frameset_ok = False
        elif n == "form":
            template = self.is_open("template")
            if self.form is not None and not template:
                return
            self.close_p()
            node = self.insert_tag(t)
            if not template:
                self.form = node
        elif n == "li":
            self.frameset_ok = False
            self.close_item(("li",))
            self.close_p()
            self.insert_tag(t)
        elif n in ("dd", "dt"):
            self.frameset_ok = False
            self.close_item(("dd", "dt"))
            self.close_p()
            self.insert_tag(t)
        elif n == "plaintext":
            self.close_p()
            self.insert_tag(t)
            self.tokens.model = "plaintext"
        elif n == "button":
            if self.in_scope("button"):
                self.imply()
                self.pop_until("button")
            self.reconstruct()
            self.insert_tag(t)
            self.frameset_ok = False
        elif n == "a":
            old = self.find_formatting("a")
            if old is not None:
                self.adopt("a")
                if old in self.formatting:
                    self.formatting.remove(old)
                if old in self.open:
                    self.open.remove(old)
            self.reconstruct()
            self.push_formatting(self.insert_tag(t))
        elif n == "nobr":
            self.reconstruct()
            if self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.push_formatting(self.insert_tag(t))
        elif n in FORMATTING:
            self.reconstruct()
            self.push_formatting(self.insert_tag(t))
        elif n in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert_tag(t)
            self.formatting.append(_MARKER)
            self.frameset_ok = False
        elif n == "table":
            if not self.quirks:
                self.close_p()
            self.insert_tag(t)
            self.frameset_ok = False
            self.mode = self.in_table
        elif n in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.insert_void(t)
            self.frameset_ok = False
        elif n == "input":
            if self.is_open("select") and self.in_scope("select", only=("html", "table", "template")) and self.context is None:
                self.pop_until("select")
            self.reconstruct()
            self.insert_void(t)
            if not any(k == "type" and v.lower() == "hidden" for k, v in t.attrs):
                self.frameset_ok = False
        elif n in ("param", "source", "track"):
            self.insert_void(t)
        elif n == "hr":
            self.close_p()
            if self.is_open("select"):
                self.imply()
            self.insert_void(t)
            self.frameset_ok = False
        elif n == "image":
            self.process(StartTag("img", t.attrs, t.self_closing))
        elif n == "textarea":
            self.skip_newline = True
            self.frameset_ok = False
            self.raw(t, "rcdata")
        elif n == "xmp":
            self.close_p()
            self.reconstruct()
            self.frameset_ok = False
            self.raw(t, "rawtext")
        elif n == "iframe":
            self.frameset_ok = False
            self.raw(t, "rawtext")
        elif n == "noembed":
            self.raw(t, "rawtext")
        elif n == "select":
            if self.in_scope("select"):  # a select in a select closes it
                self.pop_until("select")
                return
            self.reconstruct()
            self.insert_tag(t)
            self.frameset_ok = False
        elif n == "option":
            if self.in_scope("select"):
                self.imply("optgroup")
            elif self.current.name == "option" and self.current.ns == HTML:
                self.open.pop()
            self.reconstruct()
            self.insert_tag(t)
        elif n == "optgroup":
            if self.in_scope("select"):
                self.imply()
            elif self.current.name == "option" and self.current.ns == HTML:
                self.open.pop()
            self.reconstruct()
            self.insert_tag(t)
        elif n in ("rb", "rtc"):
            if self.in_scope("ruby"):
                self.imply()
            self.insert_tag(t)
        elif n in ("rp", "rt"):
            if self.in_scope("ruby"):
                self.imply("rtc")
            self.insert_tag(t)
        elif n in ("math", "svg"):
            ns = MATHML if n == "math" else SVG
            self.reconstruct()
            self.insert(n, foreign(t.attrs, ns), ns)
            if t.self_closing:
                self.open.pop()
        elif n not in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.reconstruct()
            self.insert_tag(t)

    def close_item(self, names) -> None:
        for n in reversed(self.open):
            if n.ns == HTML and n.name in names:
                self.imply(n.name)
                self.pop_until(n.name)
                return
            if self.special(n) and not (n.ns == HTML and n.name in ("address", "div", "p")):
                return

    def body_end(self, t: EndTag) -> None:
        n = t.name
        if n == "template":
            self.in_head(t)
        elif n in ("body", "html"):
            if self.in_scope("body"):
                self.mode = self.after_body
                if n == "html":
                    self.process(t)
        elif n in BLOCKS - {"p"} or n in ("button", "listing", "pre", "select"):
            if self.in_scope(n):
                self.imply()
                self.pop_until(n)
        elif n == "form":
            if self.is_open("template"):
                if self.in_scope("form"):
                    self.imply()
                    self.pop_until("form")
                return
            node, self.form = self.form, None
            if node is not None and self.node_in_scope(node):
                self.imply()
                self.open.remove(node)
        elif n == "p":
            if not self.in_button_scope("p"):
                self.insert("p")
            self.close_p()
        elif n == "li":
            if self.in_scope("li", ("ol", "ul")):
                self.imply("li")
                self.pop_until("li")
        elif n in ("dd", "dt"):
            if self.in_scope(n):
                self.imply(n)
                self.pop_until(n)
        elif n in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply()
                self.pop_until(*HEADINGS)
        elif n in FORMATTING:
            if not self.adopt(n):
                self.any_other_end(n)
        elif n in ("applet", "marquee", "object"):
            if self.in_scope(n):
                self.imply()
                self.pop_until(n)
                self.clear_formatting()
        elif n == "br":
            self.body_start(StartTag("br"))
        else:
            self.any_other_end(n)

    def in_text(self, t) -> None:
        if isinstance(t, Characters):
            self.text(t.data)
        else:
            self.open.pop()
            self.mode = self.back
            if not isinstance(t, EndTag):
                self.process(t)

    # -- tables

    def in_table(self, t) -> None:
        if isinstance(t, Characters) and self.current.ns == HTML and self.current.name in ("table", "tbody", "template", "tfoot", "thead", "tr"):
            self.pending = []
            self.back = self.mode
            self.again(self.in_table_text, t)
            return
        if isinstance(t, Comment):
            return self.comment(t)
        if isinstance(t, Doctype):
            return
        if isinstance(t, StartTag):
            n = t.name
            if n == "caption":
                self.clear_to("table", "template", "html")
                self.formatting.append(_MARKER)
                self.insert_tag(t)
                self.mode = self.in_caption
                return
            if n in ("colgroup", "col"):
                self.clear_to("table", "template", "html")
                if n == "col":
                    self.insert("colgroup")
                    return self.again(self.in_column_group, t)
                self.insert_tag(t)
                self.mode = self.in_column_group
                return
            if n in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to("table", "template", "html")
                if n in ("td", "th", "tr"):
                    self.insert("tbody")
                    return self.again(self.in_table_body, t)
                self.insert_tag(t)
                self.mode = self.in_table_body
                return
            if n == "table":
                if self.in_table_scope("table"):
                    self.pop_until("table")
                    self.reset()
                    self.process(t)
                return
            if n in ("style", "script", "template"):
                return self.in_head(t)
            if n == "input" and any(k == "type" and v.lower() == "hidden" for k, v in t.attrs):
                return self.insert_void(t)
            if n == "form":
                if self.form is None and not self.is_open("template"):
                    self.form = self.insert_tag(t)
                    self.open.pop()
                return
        elif isinstance(t, EndTag):
            if t.name == "table":
                if self.in_table_scope("table"):
                    self.pop_until("table")
                    self.reset()
                return
            if t.name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return
            if t.name == "template":
                return self.in_head(t)
        elif t is None:
            return self.in_body(t)
        self.foster = True
        self.in_body(t)
        self.foster = False

    def in_table_text(self, t) -> None:
        if isinstance(t, Characters):
            self.pending.append(t.data.replace("\0", ""))
            return
        data = "".join(self.pending)
        self.mode = self.back
        if data.strip(SPACE):
            self.foster = True
            self.in_body(Characters(data))
            self.foster = False
        else:
            self.text(data)
        self.process(t)

    def in_caption(self, t) -> None:
        outer = ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        ends = isinstance(t, EndTag) and t.name in ("caption", "table")
        if ends or isinstance(t, StartTag) and t.name in outer:
            if not self.in_table_scope("caption"):
                return
            self.imply()
            self.pop_until("caption")
            self.clear_formatting()
            self.mode = self.in_table
            if not (ends and t.name == "caption"):
                self.process(t)
        elif not (isinstance(t, EndTag) and t.name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr")):
            self.in_body(t)

    def in_column_group(self, t) -> None:
        if isinstance(t, Characters):
            space, rest = self.split_space(t)
            self.text(space)
            if not rest:
                return
            t = Characters(rest)
        elif isinstance(t, Comment):
            return self.comment(t)
        elif isinstance(t, Doctype):
            return
        elif isinstance(t, StartTag):
            if t.name == "html":
                return self.in_body(t)
            if t.name == "col":
                return self.insert_void(t)
            if t.name == "template":
                return self.in_head(t)
        elif isinstance(t, EndTag):
            if t.name == "colgroup":
                if self.current.name == "colgroup":
                    self.open.pop()
                    self.mode = self.in_table
                return
            if t.name == "col":
                return
            if t.name == "template":
                return self.in_head(t)
        elif t is None:
            return self.in_body(t)
        if self.current.name == "colgroup":
            self.open.pop()
            self.again(self.in_table, t)

    def in_table_body(self, t) -> None:
        groups = ("tbody", "tfoot", "thead")
        if isinstance(t, StartTag) and t.name in ("tr", "td", "th"):
            self.clear_to(*groups, "template", "html")
            if t.name != "tr":
                self.insert("tr")
                return self.again(self.in_row, t)
            self.insert_tag(t)
            self.mode = self.in_row
        elif isinstance(t, EndTag) and t.name in groups:
            if self.in_table_scope(t.name):
                self.clear_to(*groups, "template", "html")
                self.open.pop()
                self.mode = self.in_table
        elif isinstance(t, StartTag) and t.name in ("caption", "col", "colgroup", *groups) or isinstance(t, EndTag) and t.name == "table":
            if self.in_table_scope(groups):
                self.clear_to(*groups, "template", "html")
                self.open.pop()
                self.again(self.in_table, t)
        elif not (isinstance(t, EndTag) and t.name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr")):
            self.in_table(t)

    def in_row(self, t) -> None:
        groups = ("tbody", "tfoot", "thead")
        if isinstance(t, StartTag) and t.name in ("td", "th"):
            self.clear_to("tr", "template", "html")
            self.insert_tag(t)
            self.mode = self.in_cell
            self.formatting.append(_MARKER)
            return
        end_row = isinstance(t, EndTag) and t.name == "tr"
        starts = isinstance(t, StartTag) and t.name in ("caption", "col", "colgroup", *groups, "tr")
        ends = isinstance(t, EndTag) and t.name in ("table", *groups)
        if end_row or starts or ends:
            if not self.in_table_scope("tr") or ends and t.name in groups and not self.in_table_scope(t.name):
                return
            self.clear_to("tr", "template", "html")
            self.open.pop()
            self.mode = self.in_table_body
            if not end_row:
                self.process(t)
        elif not (isinstance(t, EndTag) and t.name in ("body", "caption", "col", "colgroup", "html", "td", "th")):
            self.in_table(t)

    def close_cell(self) -> None:
        self.imply()
        self.pop_until("td", "th")
        self.clear_formatting()
        self.mode = self.in_row

    def in_cell(self, t) -> None:
        if isinstance(t, EndTag) and t.name in ("td", "th"):
            if self.in_table_scope(t.name):
                self.imply()
                self.pop_until(t.name)
                self.clear_formatting()
                self.mode = self.in_row
        elif isinstance(t, StartTag) and t.name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self.in_table_scope(("td", "th")):
                self.close_cell()
                self.process(t)
        elif isinstance(t, EndTag) and t.name in ("body", "caption", "col", "colgroup", "html"):
            return
        elif isinstance(t, EndTag) and t.name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self.in_table_scope(t.name):
                self.close_cell()
                self.process(t)
        else:
            self.in_body(t)

    # -- templates, framesets and the end

    def in_template(self, t) -> None:
        if isinstance(t, StartTag):
            n = t.name
            if n in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                return self.in_head(t)
            mode = self.in_body
            if n in ("caption", "colgroup", "tbody", "tfoot", "thead"):
                mode = self.in_table
            elif n == "col":
                mode = self.in_column_group
            elif n == "tr":
                mode = self.in_table_body
            elif n in ("td", "th"):
                mode = self.in_row
            self.modes[-1] = mode
            self.again(mode, t)
        elif isinstance(t, EndTag):
            if t.name == "template":
                self.in_head(t)
        elif t is None:
            if self.is_open("template"):
                self.pop_until("template")
                self.clear_formatting()
                self.modes.pop()
                self.reset()
                self.process(t)
        else:
            self.in_body(t)

    def keep_space(self, t: Characters) -> None:
        self.text("".join(c for c in t.data if c in SPACE))

    def in_frameset(self, t) -> None:
        if isinstance(t, Characters):
            self.keep_space(t)
        elif isinstance(t, Comment):
            self.comment(t)
        elif isinstance(t, StartTag):
            if t.name == "html":
                self.in_body(t)
            elif t.name == "frameset":
                self.insert_tag(t)
            elif t.name == "frame":
                self.insert_void(t)
            elif t.name == "noframes":
                self.in_head(t)
        elif isinstance(t, EndTag) and t.name == "frameset" and len(self.open) > 1:
            self.open.pop()
            if self.context is None and self.current.name != "frameset":
                self.mode = self.after_frameset

    def after_frameset(self, t) -> None:
        if isinstance(t, Characters):
            self.keep_space(t)
        elif isinstance(t, Comment):
            self.comment(t)
        elif isinstance(t, StartTag) and t.name == "html":
            self.in_body(t)
        elif isinstance(t, StartTag) and t.name == "noframes":
            self.in_head(t)
        elif isinstance(t, EndTag) and t.name == "html":
            self.mode = self.after_after_frameset

    def after_after_frameset(self, t) -> None:
        if isinstance(t, Comment):
            self.comment(t, self.document)
        elif isinstance(t, Characters):
            space = "".join(c for c in t.data if c in SPACE)
            if space:
                self.in_body(Characters(space))
        elif isinstance(t, StartTag) and t.name == "html":
            self.in_body(t)
        elif isinstance(t, StartTag) and t.name == "noframes":
            self.in_head(t)

    def after_body(self, t) -> None:
        if isinstance(t, Characters) and not t.data.strip(SPACE):
            self.in_body(t)
        elif isinstance(t, Comment):
            self.comment(t, self.open[0])
        elif isinstance(t, Doctype) or t is None:
            return
        elif isinstance(t, StartTag) and t.name == "html":
            self.in_body(t)
        elif isinstance(t, EndTag) and t.name == "html":
            if self.context is None:
                self.mode = self.after_after_body
        else:
            self.again(self.in_body, t)

    def after_after_body(self, t) -> None:
        if isinstance(t, Comment):
            self.comment(t, self.document)
        elif isinstance(t, Characters) and not t.data.strip(SPACE) or isinstance(t, StartTag) and t.name == "html":
            self.in_body(t)
        elif isinstance(t, Doctype) or t is None:
            return
        else:
            self.again(self.in_body, t)

    # -- foreign content

    def is_foreign(self, t) -> bool:
        node = self.adjusted()
        if node is None or node.ns == HTML or t is None:
            return False
        if node.ns == MATHML and node.name in ("mi", "mo", "mn", "ms", "mtext"):
            if isinstance(t, Characters) or isinstance(t, StartTag) and t.name not in ("mglyph", "malignmark"):
                return False
        if node.ns == MATHML and node.name == "annotation-xml":
            if isinstance(t, StartTag) and t.name == "svg":
                return False
        return not (self.html_point(node) and isinstance(t, (StartTag, Characters)))

    @staticmethod
    def html_point(node: Node) -> bool:
        if node.ns == MATHML and node.name == "annotation-xml":
            return (node.get("encoding") or "").lower() in ("text/html", "application/xhtml+xml")
        return node.ns == SVG and node.name in ("foreignObject", "desc", "title")

    def foreign(self, t) -> None:
        if isinstance(t, Characters):
            data = t.data.replace("\0", "�")
            self.text(data)
            if data.strip(SPACE + "�"):
                self.frameset_ok = False
        elif isinstance(t, Comment):
            self.comment(t)
        elif isinstance(t, StartTag):
            if t.name in BREAKOUT or t.name == "font" and any(k in ("color", "face", "size") for k, _ in t.attrs):
                return self.breakout(t)
            ns = self.adjusted().ns
            name = SVG_TAGS.get(t.name, t.name) if ns == SVG else t.name
            self.insert(name, foreign(t.attrs, ns), ns)
            if t.self_closing:
                self.open.pop()
        elif isinstance(t, EndTag):
            if t.name in ("br", "p"):
                return self.breakout(t)
            for i in range(len(self.open) - 1, -1, -1):
                n = self.open[i]
                if i < len(self.open) - 1 and n.ns == HTML:
                    return self.mode(t)
                if n.name.lower() == t.name and n.ns != HTML:
                    if i:
                        del self.open[i:]
                    return
                if n.ns == HTML:
                    return self.mode(t)

    def breakout(self, t) -> None:
        while True:
            n = self.current
            if n.ns == HTML or self.html_point(n) or n.ns == MATHML and n.name in ("mi", "mo", "mn", "ms", "mtext"):
                break
            if len(self.open) == 1:
                break
            self.open.pop()
        self.mode(t)


_RESET = {
    "select": "in_body", "tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body",
    "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "body": "in_body", "frameset": "in_frameset",
}


def reflect_selected(document: Node) -> None:
    """Copy the selected option's children into each selectedcontent of its select."""
    for select in [n for n in document.walk() if n.name == "select" and n.ns == HTML]:
        shown = [n for n in select.walk() if n.name == "selectedcontent"]
        options = [n for n in select.walk() if n.name == "option" and n.ns == HTML]
        if shown and options:
            chosen = next((o for o in reversed(options) if o.get("selected") is not None), options[0])
            copies = [[c.clone() for c in chosen.children] for _ in shown]
            for target, children in zip(shown, copies):
                for c in children:
                    target.append(c)


def parse(html: str) -> Node:
    """The document node of a text."""
    return TreeBuilder(html).run()


def parse_fragment(html: str, context: str = "div") -> list[Node]:
    """The nodes of a fragment in a ``context`` element ("div", "svg path")."""
    root = TreeBuilder(html, context).run().children[0]
    out = list(root.children)
    for n in out:
        n.parent = None
    return out


def outline(node: Node) -> str:
    """The indented outline of a tree, for tests and debugging."""
    lines: list[str] = []
    names = {SVG: "svg ", MATHML: "math "}

    def show(n: Node, depth: int) -> None:
        pad = "| " + "  " * depth
        if n.kind == "element":
            lines.append(f"{pad}<{names.get(n.ns, '')}{n.name}>")
            for a in sorted(n.attrs, key=lambda a: a[3]):
                name = f"{a[0]} {a[1]}" if a[0] else a[3]
                lines.append(f'{pad}  {name}="{a[4]}"')
            if n.content is not None:
                lines.append(f"{pad}  content")
                for c in n.content.children:
                    show(c, depth + 2)
        elif n.kind == "text":
            lines.append(f'{pad}"{n.value}"')
        elif n.kind == "comment":
            lines.append(f"{pad}<!-- {n.value} -->")
        elif n.kind == "document_type":
            ids = "" if not n.public_id and not n.system_id else f' "{n.public_id or ""}" "{n.system_id or ""}"'
            lines.append(f"{pad}<!DOCTYPE {n.name}{ids}>")
        for c in n.children:
            show(c, depth + 1)

    for child in node.children:
        show(child, 0)
    return "\n".join(lines)
