"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks, each the text between two block
boundaries, described by the tags, classes and roles of its ancestors and by its text.
The field is trained on labelled pages and decodes which blocks are main text by Viterbi.
The default training pages are laid out here at random, with the layouts and names that
web pages commonly use; ``train`` takes any other labelled pages.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .crf import Chain, fit

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements without text of the page that are left out as far as their end tag; without one only their start tag is.
HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("noscript", "template", "svg", "select", "canvas")}
NAMES = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot "
    "th thead tr ul button".split()
)
#: Elements whose start closes an open element of one of the given names.
CLOSES = {**{t: ("p",) for t in BLOCKS - {"body", "html"}}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",)}
HINTS = ("cookie", "copyright", "©", "subscribe", "comment", "reply", "share", "advert", "sponsored", "newsletter", "rights reserved", "privacy", "log in", "sign up", "search", "read more", "related")


def names_of(attributes: str) -> tuple[str, ...]:
    found = []
    for name, *values in NAMES.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "").lower()
        if name.lower() in ("hidden", "aria-hidden") and value != "false":
            found.append("hidden")
        found += [f"c={x}" for x in re.split(r"[^a-z0-9]+", value) if x and not x.isdigit()]
    return tuple(found)


def leaf_blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of the leaf blocks of a page, in page order."""
    blocks, stack, buffer = [], [], []
    linked = link_from = at = 0
    link, unclosed = False, set()

    def flush():
        nonlocal buffer, linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append((text, features(text, stack, linked / max(1, len(raw)))))
        buffer, linked = [], 0

    def put(text):
        nonlocal linked
        if text:
            buffer.append(text)
            if link:
                linked += len(text)

    while m := TAG.search(page or "", at):
        put(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            buffer.append("" if m[1] is None else " ")
            continue
        name, closing = name.lower(), bool(m[2] or m[5])
        if name in HIDDEN and not closing and name not in unclosed:
            if name != "svg" or not m[0].endswith("/>"):
                if end := HIDDEN[name].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(name)
            buffer.append(" ")
        elif name == "a":
            link = not closing
        elif name == "br":
            buffer.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                while stack and stack[-1][0] in CLOSES.get(name, ()):
                    stack.pop()
                if name != "hr":
                    stack.append((name, names_of(m[4] or m[7] or "")))
    put((page or "")[at:])
    flush()
    for k, (_, fs) in enumerate(blocks):
        fs.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "inner")
    return blocks


def features(text: str, stack: list, links: float) -> list[str]:
    out = ["bias"]
    for name, names in stack:
        out.append(f"t={name}")
        out += names
    if stack:
        out.append(f"leaf={stack[-1][0]}")
        if len(stack) > 1:
            out.append(f"in={stack[-2][0]}>{stack[-1][0]}")
    n = text.count(" ") + 1
    out += [f"words={min(7, int(math.log2(n)))}", f"links={'none' if not links else 'some' if links < 0.5 else 'most'}"]
    out.append(f"end={'stop' if text[-1] in '.!?。' else 'none'}")
    low = text.lower()
    out += [f"has={h}" for h in HINTS if h in low]
    return list(dict.fromkeys(out))


def made_page(rng: random.Random) -> list[tuple[str, int]]:
    """Pieces (markup, label) of a random page; label 1 marks main text, 0 other text, markup alone has -1."""
    syllables = [rng.choice("bcdfghlmnprstvw") + rng.choice("aeiouéäñ") + rng.choice(["", "n", "r", "s"]) for _ in range(60)]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low=4, high=14):
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def paragraph(most=8):
        return " ".join(sentence() for _ in range(rng.randint(1, most)))

    def element(tag, inside, names="", label=-1):
        attribute = f' {rng.choice(["class", "class", "id"])}="{names}"' if names else ""
        return [(f"<{tag}{attribute}>", -1), *([(inside, label)] if isinstance(inside, str) else inside), (f"</{tag}>", -1)]

    def several(made, low, high):
        return [x for _ in range(rng.randint(low, high)) for x in made()]

    def links():
        item = lambda: element("li", [(f'<a href="/{word()}">', -1), (" ".join(word() for _ in range(rng.randint(1, 3))), 0), ("</a>", -1)])
        return element(rng.choice(["ul", "ul", "ol"]), several(item, 2, 8))

    def filler():
        kind = rng.random()
        if kind < 0.4:
            return several(lambda: element("p", paragraph(4), "", 0), 1, 3)
        return [(sentence(), 0)] if kind < 0.7 else links()

    def titled(inside):
        return [*element(rng.choice(["h2", "h3", "h4", "div", "p"]), sentence(1, 4), "", 0), *inside] if rng.random() < 0.5 else inside

    def other(where):
        name = rng.choice(where)
        tag, _, names = name.partition(".")
        if tag == "nav" or "menu" in names or "nav" in names or "crumb" in names:
            return element(tag, links(), names)
        if tag == "form":
            return element(tag, [*element("label", sentence(1, 4), "", 0), *element("button", word(), "", 0), *(element("p", sentence(), "", 0) if rng.random() < 0.5 else [])], names)
        if "comment" in names:
            one = lambda: element(rng.choice(["div", "li", "article"]), [*element("span", word(), "", 0), *several(lambda: element("p", paragraph(5), "", 0), 1, 2)], rng.choice(["comment", "comment-body", "reply", ""]))
            return element(tag, titled(several(one, 1, 5)), names)
        return element(tag, titled(filler()), names)

    top = ["header", "nav", "nav", "div.header", "div.menu", "div.topbar", "div.navbar", "div.breadcrumb", "ul.nav-menu", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.cookie-notice", "div.cookie", "div.notice", "div.banner", "div.alert", "div.announcement", "div.promo", "form.search", "form", "aside", "div.sidebar", "div.consent", "dialog.modal", "div.popup", "div.masthead", "div.site-header"]
    low = ["footer", "footer", "div.footer", "div.copyright", "div.site-footer", "section.comments", "div.comments", "div.comment-list", "ol.commentlist", "aside", "aside.related", "div.sidebar", "div.widget", "div.related", "div.share", "div.social", "div.tags", "div.pagination", "div.newsletter", "form.newsletter", "form", "form.comment-form", "div.ad", "div.advert", "div.sponsor", "div.sponsored", "div.recommended", "nav", "div.legal", "div.disclaimer", "div.subscribe", "div.author-bio"]
    amid = ["div.ad", "div.ad", "div.advert", "div.ads", "div.advertisement", "aside", "aside.related", "div.promo", "div.newsletter", "form", "div.share", "div.sponsored", "nav.toc", "div.notice", "div.social"]

    def main_block():
        kind = rng.random()
        if kind < 0.72:
            return element("p", paragraph(), "", 1)
        if kind < 0.8:
            return element(rng.choice(["h2", "h3"]), sentence(1, 6), "", 1)
        if kind < 0.88:
            return element(rng.choice(["ul", "ol"]), several(lambda: element("li", sentence(2, 12), "", 1), 2, 5))
        if kind < 0.94:
            return element("blockquote", element("p", paragraph(3), "", 1) if rng.random() < 0.5 else [(paragraph(3), 1)])
        return element("table", several(lambda: element("tr", several(lambda: element("td", sentence(1, 5), "", 1), 2, 3)), 1, 3))

    body = []
    title = sentence(2, 8)
    heading = element("h1", title, "", 1)
    if rng.random() < 0.85:
        body += element("header", heading) if rng.random() < 0.15 else heading
    for _ in range(rng.randint(1, 9)):
        body += main_block()
        if rng.random() < 0.12:
            body += other(amid)
    shell = rng.choice(["article"] * 6 + ["main", "main>article", "div.content", "div.post", "div.entry-content", "div.article-body", "div.article", "div.story", "div.main-content", "div.post-content", "div.text", "section.content", "div.page>div.content", "div.main", "div"])
    for part in reversed(shell.split(">")):
        tag, _, names = part.partition(".")
        body = element(tag, body, names)
    page = [*several(lambda: other(top), 1, 4), *body, *several(lambda: other(low), 0, 4)]
    if rng.random() < 0.3:
        page = element("div", page, rng.choice(["wrapper", "container", "page", "site", "layout"]))
    return [("<html><body>", -1), *page, ("</body></html>", -1)]


def labelled_pages(n: int = 500, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages with a label for each of their leaf blocks."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        pieces = made_page(rng)
        labels = [y for _, y in pieces if y >= 0]
        page = "".join(x for x, _ in pieces)
        if len(leaf_blocks(page)) == len(labels):  # pages where two texts run into one block have no label for it
            out.append((page, labels))
    return out


def train(pages: list[tuple[str, list[int]]]) -> Chain:
    """Fit the field on pages with one label for each leaf block."""
    return fit([[fs for _, fs in leaf_blocks(page)] for page, _ in pages], [labels for _, labels in pages], rounds=80, penalty=0.1)


@functools.cache
def default_model() -> Chain:
    return train(labelled_pages())


def main_text(chain: Chain, page: str | None) -> str:
    blocks = leaf_blocks(page)
    get = chain.weights.get
    path = chain.viterbi([sum(get(f, 0.0) for f in fs) for _, fs in blocks])
    return "\n\n".join(text for (text, _), y in zip(blocks, path, strict=True) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """All columns of ``pages`` but ``html``, plus (text, n_chars): the main text of each page.

    Character references are decoded, white space inside a block becomes one blank, and
    blocks are joined in page order by two line feeds.

    Defined results: a null or empty page, and one without main text, gives an empty
    text; unclosed or stray tags are read as browsers do for blocks; repeated rows are
    extracted alike; no rows give no rows; columns named text or n_chars are replaced.
    """
    chain = chain or default_model()
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in others]).add("text", "string").add("n_chars", "long")

    def batches(frames):
        for frame in frames:
            for first in range(0, len(frame), 500):
                part = frame.slice(first, 500)
                texts = [main_text(chain, p) for p in part["html"].to_pylist()]
                added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in others], *added], schema.names)

    return pages.select(*[f"`{c}`" for c in others], "html").mapInArrow(batches, schema)
