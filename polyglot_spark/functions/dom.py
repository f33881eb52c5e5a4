"""A small HTML tree: tokens, implied and misnested tags as browsers treat them, and a canonical serialisation.

It serves one page at a time inside a task.  Where a formatting element is closed across
a block, the block stays inside it; the full adoption procedure is not followed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from html.entities import html5

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW, TEXT_ONLY = frozenset(("script", "style", "noscript", "iframe", "noframes", "xmp")), frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
IN_HEAD = frozenset("base link meta title style script noscript template".split())
SCOPE = frozenset("html table td th caption button marquee object template body".split())
TABLE_CLOSE = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "option": ("option",)}

ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


#: A character reference that its semicolon ends.
CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")

NAME_END, UNQUOTED = re.compile(r"[\s/>]|\Z"), re.compile(r"[^>\"']*")


class Scanner:
    """Tags and comments of a page, in time in proportion to its length, whatever is left unclosed in it.

    A tag has a name and, up to its ``>``, anything in which quotes are paired; a ``<`` that begins no
    tag, no comment and no declaration is text.  What an attempt in vain has read is remembered: one that
    comes to the same place outside of quotes is in vain too.
    """

    def __init__(self, source: str):
        self.source, self.last_end = source, source.rfind(">")
        self.last_quote = {q: source.rfind(q) for q in "\"'"}
        self.vain: bytearray | None = None
        self.name_end = self.vain_name = -1

    def closing(self, at: int) -> int:
        """Place of the ``>`` that ends a tag of which ``at`` is a place outside of quotes, or -1."""
        source, read = self.source, []
        while self.vain is None or at >= len(source) or not self.vain[at]:
            stop = UNQUOTED.match(source, at).end()
            read.append((at, stop + 1))
            sign = source[stop : stop + 1]
            if sign == ">":
                return stop
            if not sign or stop >= self.last_quote[sign]:
                break
            at = source.find(sign, stop + 1) + 1
        if self.vain is None:
            self.vain = bytearray(len(source) + 1)
        for first, stop in read:
            self.vain[first:stop] = b"\x01" * (min(stop, len(source) + 1) - first)
        return -1

    def tag(self, at: int) -> tuple[int, str, str] | None:
        """(end, name, attributes) of a tag whose name begins at ``at``."""
        source = self.source
        if at > self.name_end:
            self.name_end = NAME_END.search(source, at).start()
        if self.name_end == self.vain_name:
            return None  # all that could end this name has been tried for an earlier one
        end = self.name_end
        while True:
            if (close := self.closing(end)) >= 0:
                return close + 1, source[at:end], source[end:close]
            end = max(source.rfind(q, at + 1, end) for q in "\"'")
            if end < 0:
                self.vain_name = self.name_end
                return None

    def tokens(self):
        """(start, end, comment, closing, name, attributes): comment is null for tags, name is empty for declarations."""
        source, at = self.source, 0
        while (start := source.find("<", at)) >= 0:
            sign = source[start + 1 : start + 2]
            closing = sign == "/"
            letter = source[start + 2 : start + 3] if closing else sign
            found = None
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                found = (len(source), source[start + 4 :]) if end < 0 else (end + 3, source[start + 4 : end])
                found = (start, found[0], found[1], False, "", "")
            elif start < self.last_end:
                if letter.isascii() and letter.isalpha() and (tag := self.tag(start + 1 + closing)):
                    found = (start, tag[0], None, closing, tag[1], tag[2])
                elif sign in ("!", "?", "/") and (end := source.find(">", start + 2)) >= 0:
                    found = (start, end + 1, None, False, "", "")
            if found is None:
                at = start + 1
            else:
                at = yield found
                if at is None:
                    at = found[1]


@dataclass(eq=False)
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes, texts, or comments as ("comment", text)

    def add_text(self, text: str) -> None:
        if self.children and isinstance(self.children[-1], str):
            self.children[-1] += text
        elif text:
            self.children.append(text)

    def text(self) -> str:
        return "".join(x for x, _ in walked(self) if isinstance(x, str))


def walked(node):
    """(part, entering) for a node and all below it in document order; a node comes again when it ends.

    Without recursion, so that no page is too deep.
    """
    stack = [(node, True)]
    while stack:
        part, entering = stack.pop()
        yield part, entering
        if entering and isinstance(part, Node):
            stack.append((part, False))
            stack += [(c, True) for c in reversed(part.children)]


def closed_only(text: str) -> str:
    """Text with its character references decoded, but for those without a semicolon, which browsers decode too."""
    return CLOSED.sub(lambda m: entities.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], text)


def attributes_of(source: str, decode=entities.unescape) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), decode(a or b or c))
    return found


class Builder:
    def __init__(self, context: str | None = None, decode=entities.unescape):
        self.decode = decode
        self.root = Node("html")
        self.head, self.body = Node("head"), Node(context or "body")
        self.root.children = [self.head, self.body]
        self.started = context is not None
        self.open = [self.body]
        self.names, self.ids = Counter(), {id(self.body)}  # of the open elements, so that deep stacks are searched only for what is there
        self.active: list[Node] = []
        self.pending, self.target, self.place = [], None, None  # pieces of text, the node they go to, and where in it

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.names[node.name] += 1
        self.ids.add(id(node))

    def close(self, first: int, last: int | None = None) -> None:
        """Take the elements from ``first`` on, or up to ``last``, off the stack of open elements."""
        for node in self.open[first:last]:
            self.names[node.name] -= 1
            self.ids.discard(id(node))
        del self.open[first:last]

    def pop_to(self, names) -> bool:
        """Close the nearest open element of one of the names, unless a scope boundary lies above it."""
        if not any(self.names[n] > 0 for n in names):
            return False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                self.close(k)
                return True
            if self.open[k].name in SCOPE and self.open[k].name not in names:
                return False
        return False

    def reconstruct(self) -> None:
        """Open again the formatting elements that a block has closed."""
        first = len(self.active)
        while first and id(self.active[first - 1]) not in self.ids:
            first -= 1
        for k in range(first, len(self.active)):
            again = Node(self.active[k].name, dict(self.active[k].attributes))
            self.open[-1].children.append(again)
            self.push(again)
            self.active[k] = again

    def put_text(self, text: str) -> None:
        if not text:
            return
        if not self.started:
            if not text.strip():
                return
            self.started = True
        if text.strip():
            self.reconstruct()
        node = self.open[-1]
        if self.place != (id(node), len(node.children)):
            self.flush()
            self.target, self.place = node, (id(node), len(node.children))
        self.pending.append(self.decode(text) if "&" in text else text)

    def flush(self) -> None:
        """Put the pieces of text together that nothing but tags without effect has parted."""
        if self.pending:
            text, before = "".join(self.pending), self.target.children[self.place[1] - 1 : self.place[1]]
            if before and isinstance(before[0], str):
                self.target.children[self.place[1] - 1] += text
            else:
                self.target.children.insert(self.place[1], text)
        self.pending, self.target, self.place = [], None, None

    def start(self, name: str, attributes: dict[str, str]) -> Node | None:
        if name in ("html", "body"):
            own = self.root if name == "html" else self.body
            own.attributes.update({k: v for k, v in attributes.items() if k not in own.attributes})
            self.started |= name == "body"
            return None
        if name == "head":
            self.head.attributes.update(attributes)
            return None
        node = Node(name, attributes)
        if not self.started and name in IN_HEAD:
            self.head.children.append(node)
            return node
        self.started = True
        if name in ENDS_PARAGRAPH:
            self.pop_to(("p",))
            if name == "li":
                self.close_item(("li",), ("ul", "ol"))
            elif name in ("dd", "dt"):
                self.close_item(("dd", "dt"), ("dl",))
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.close(len(self.open) - 1)
        elif name in TABLE_CLOSE:
            for k in range(len(self.open) - 1, 0, -1) if any(self.names[n] > 0 for n in TABLE_CLOSE[name]) else ():
                if self.open[k].name in TABLE_CLOSE[name]:
                    self.close(k)
                    break
                if self.open[k].name in ("table", "select") or (name in ("td", "th") and self.open[k].name == "tr"):
                    break
        else:
            if name == "a":
                self.close_formatting("a")
            self.reconstruct()
        self.open[-1].children.append(node)
        if name not in VOID:
            self.push(node)
            if name in FORMATTING:
                same = [n for n in self.active if n.name == name and n.attributes == attributes]
                if len(same) >= 3:
                    self.active = [n for n in self.active if n is not same[0]]
                self.active.append(node)
        return node

    def close_item(self, names, stops) -> None:
        for k in range(len(self.open) - 1, 0, -1) if any(self.names[n] > 0 for n in names) else ():
            if self.open[k].name in names:
                self.close(k)
                return
            if self.open[k].name in stops or self.open[k].name in SCOPE:
                return

    def close_formatting(self, name: str) -> None:
        for node in reversed(self.active):
            if node.name == name:
                self.active = [n for n in self.active if n is not node]
                for k in range(len(self.open) - 1, 0, -1) if id(node) in self.ids else ():
                    if self.open[k] is node:
                        above = any(n.name in ENDS_PARAGRAPH or n.name in SCOPE for n in self.open[k + 1 :])
                        self.close(k, k + 1 if above else None)
                        return
                return

    def end(self, name: str) -> None:
        if name in ("html", "body", "head"):
            self.started |= name == "head"
        elif name in FORMATTING:
            self.close_formatting(name)
        elif name == "br":
            self.start("br", {})
        elif name == "p":
            if not self.pop_to(("p",)):
                self.open[-1].children.append(Node("p"))
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.pop_to(("h1", "h2", "h3", "h4", "h5", "h6"))
        else:
            self.pop_to((name,))

    def feed(self, source: str) -> None:
        tokens, at, jump = Scanner(source).tokens(), 0, None
        while True:
            try:
                start, end, comment, closing, name, attributes = tokens.send(jump)
            except StopIteration:
                break
            jump = None
            self.put_text(source[at:start])
            at, name = end, name.lower()
            if comment is not None:
                self.flush()
                (self.open[-1] if self.started else self.head).children.append(("comment", comment))
            elif closing:
                self.end(name)
            elif name:
                node = self.start(name, attributes_of(attributes, self.decode))
                if name in RAW or name in TEXT_ONLY:
                    close = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(source, at)
                    inside = source[at : close.start()]
                    at = jump = close.end()
                    if node is not None:
                        node.add_text(self.decode(inside) if name in TEXT_ONLY else inside)
                        if self.open[-1] is node:
                            self.close(len(self.open) - 1)
        self.put_text(source[at:])
        self.flush()


def parse(source: str, open_references: bool = True) -> Node:
    """The tree of a page; without ``open_references`` a character reference needs its semicolon."""
    builder = Builder(decode=entities.unescape if open_references else closed_only)
    builder.feed(source)
    return builder.root


def parse_fragment(source: str, context: str) -> list:
    builder = Builder(context)
    builder.feed(source)
    return builder.body.children


def start_tag(node: Node, ordered: bool = False) -> str:
    names = sorted(node.attributes, key=lambda n: n.encode("utf-16-be")) if ordered else node.attributes
    escaped = lambda v: v.replace("&", "&amp;").replace('"', "&quot;")
    if ordered:
        escaped = lambda v: v.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
    return f"<{node.name}" + "".join(f' {n}="{escaped(node.attributes[n])}"' for n in names) + ">"


def serialized(node) -> str:
    """Canonical markup: attributes in source order, text and attributes escaped, void elements unclosed."""
    out: list[str] = []
    raw = 0  # open elements whose text is written as it is
    for part, entering in walked(node):
        if isinstance(part, str):
            out.append(part if raw else part.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif isinstance(part, tuple):
            out.append("" if raw else f"<!--{part[1]}-->")
        elif part.name in VOID:
            out.append(start_tag(part) if entering else "")
        else:
            raw += (1 if entering else -1) * (part.name in RAW)
            out.append(start_tag(part) if entering else f"</{part.name}>")
    return "".join(out)
