"""Pages to translatable segments and back: title, description and one segment for each leaf block.

The tree exists only inside a task, one page at a time; segments are rows in between.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COMPATIBLE, EngineConfig
from ..functions.dom import Node, parse, parse_fragment, serialized, start_tag, walked

#: Elements whose content stays, blocks, inline elements, white space, letters that may stand alone, and numbers.
SKIPPED = frozenset("script style noscript svg canvas iframe code pre textarea".split())
BLOCK = frozenset("p div li td th h1 h2 h3 h4 h5 h6 section article blockquote label".split())
INLINE = frozenset("a span strong em b i small u sup sub".split())
BLANKS = re.compile("[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
LETTER = re.compile("[A-Za-z\\u00C0-\\u017F\\u0400-\\u04FF\\u0600-\\u06FF\\u4E00-\\u9FFF]")
NUMERIC = re.compile(r"[\d\s.,:+\-/%()]+", re.A)

#: Pages of a batch that a task has as Python objects at a time.
AT_ONCE = 50
SEGMENT = "seq int, kind string, text string, tag_map array<struct<token:string,tag:string>>, node_ord int"
#: The rules added to a page that is turned right to left.
RTL_RULES = """
[dir="rtl"] {
  direction: rtl;
}
[dir="rtl"] body {
  text-align: right;
}
[dir="rtl"] .text-left {
  text-align: right !important;
}
[dir="rtl"] .ml-20 {
  margin-inline-start: 0 !important;
  margin-inline-end: 20px !important;
}
[dir="rtl"] .pl-20 {
  padding-inline-start: 0 !important;
  padding-inline-end: 20px !important;
}
"""


def normal(text: str) -> str:
    return BLANKS.sub(" ", text).strip(" ")


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def kept(text: str) -> bool:
    text = normal(text)
    return bool(text) and (units(text) >= 2 or bool(LETTER.search(text))) and not NUMERIC.fullmatch(text)


def excluded(node: Node) -> bool:
    a = node.attributes
    marked = "no-translate" in a.get("class", "").split() or a.get("data-translate", "").lower() == "false" or a.get("translate", "").lower() == "no"
    return node.name in SKIPPED or marked


def elements(node: Node):
    """Elements below a node in document order."""
    return (n for n, entering in walked(node) if entering and isinstance(n, Node) and n is not node)


def title_of(root: Node) -> Node | None:
    return next((n for n in elements(root.children[0]) if n.name == "title"), None)


def description_of(root: Node) -> Node | None:
    return next((n for n in elements(root) if n.name == "meta" and n.attributes.get("name") == "description"), None)


def leaf_blocks(root: Node) -> list[Node]:
    """Blocks without a translatable block inside, in document order of their ends."""
    found: list[Node] = []
    holds, stack = [False], [(root.children[1], True)]  # for each open element, whether a block lies inside
    while stack:
        node, entering = stack.pop()
        if not entering:
            inside, block = holds.pop(), node.name in BLOCK
            if block and not inside:
                found.append(node)
            holds[-1] |= block or inside
        elif not excluded(node):
            holds.append(False)
            stack.append((node, False))
            stack += [(c, True) for c in reversed(node.children) if isinstance(c, Node)]
    return found


def block_text(block: Node) -> tuple[str, list[dict]]:
    """Text of a block with a pair of tokens around each inline element, and the markup of the tokens.

    There is one blank after an opening and before a closing token, and between the children of the block.
    """
    tags: list[dict] = []
    pieces: list[str] = []
    blank = False

    def put(text: str) -> None:
        nonlocal blank
        body = text.strip(" ")
        if body:
            if pieces and (blank or text[0] == " "):
                pieces.append(" ")
            pieces.append(body)
        blank = text.endswith(" ") or (blank and not body)

    for child in block.children:
        blank, stack = True, [(child, -1)]
        while stack:
            part, number = stack.pop()
            if number >= 0:
                put(f" TAG_CLOSE_{number}")
            elif isinstance(part, str):
                put(BLANKS.sub(" ", part))
            elif isinstance(part, Node) and not excluded(part):
                if part.name in INLINE:
                    k = len(tags) // 2
                    tags.append({"token": f"TAG_OPEN_{k}", "tag": start_tag(part, ordered=True)})
                    tags.append({"token": f"TAG_CLOSE_{k}", "tag": f"</{part.name}>"})
                    put(f"TAG_OPEN_{k} ")
                    stack.append((part, k))
                stack += [(c, -1) for c in reversed(part.children)]
    return "".join(pieces), tags


def segments_of(page: str, config: EngineConfig = COMPATIBLE) -> list[dict]:
    root = parse(page, config.open_references)
    rows = []
    title, description = title_of(root), description_of(root)
    for kind, text in (("title", title and title.text()), ("meta-description", description and description.attributes.get("content", ""))):
        if text and kept(text):
            rows.append({"kind": kind, "text": BLANKS.sub(lambda m: m[0], text).strip(), "tag_map": [], "node_ord": -1})
    for k, block in enumerate(leaf_blocks(root)):
        text, tags = block_text(block)
        if kept(text) and (units(text) <= config.max_block_chars or config.oversize_block == "split"):
            rows.append({"kind": "block", "text": text, "tag_map": tags, "node_ord": k})
    return [{"seq": k, **row} for k, row in enumerate(rows)]


def segments(pages: DataFrame, key: str = "page_id", html: str = "html", config: EngineConfig = COMPATIBLE) -> DataFrame:
    """(key, seq, kind, text, tag_map, node_ord) for every segment of every page; a null page has none.

    Blocks of more than ``max_block_chars`` UTF-16 units are left as they are unless
    ``oversize_block`` is "split".
    """
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, {SEGMENT}"
    tag = pa.list_(pa.struct([("token", pa.string()), ("tag", pa.string())]))
    kinds = {"seq": pa.int32(), "kind": pa.string(), "text": pa.string(), "tag_map": tag, "node_ord": pa.int32()}

    def work(batches):
        for batch in batches:
            for first in range(0, len(batch), AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                found = [segments_of(h, config) if h else [] for h in part[html].to_pylist()]
                which = [k for k, rows in enumerate(found) for _ in rows]
                flat = [r for rows in found for r in rows]
                columns = [pa.array([r[c] for r in flat], t) for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([part[key].take(pa.array(which, pa.int64())), *columns], [key, *kinds])

    return pages.select(key, html).mapInArrow(work, schema)


def head_of(page: str) -> tuple[str, str]:
    """Trimmed title and description of a page as a viewer shows them: the first of each wherever they stand, '' if missing."""
    root = parse(page)
    title = next((n for n in elements(root) if n.name == "title"), None)
    description = description_of(root)
    return (title.text().strip() if title else "", description.attributes.get("content", "").strip() if description else "")


def with_head(pages: DataFrame, html: str = "translated_html") -> DataFrame:
    """All columns of ``pages`` plus (title, description) of the page in column ``html``; '' for a null page."""
    schema = T.StructType(list(pages.schema)).add("title", "string").add("description", "string")

    def work(batches):
        for batch in batches:
            for first in range(0, len(batch), AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                heads = [head_of(h) if h else ("", "") for h in part[html].to_pylist()]
                added = [pa.array([h[k] for h in heads], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], schema.names)

    return pages.mapInArrow(work, schema)


def put_back(page: str, translated: list[dict], target_lang: str, config: EngineConfig = COMPATIBLE) -> str:
    """The page with translated segments; a null translation leaves the source text."""
    root = parse(page, config.open_references)
    blocks = leaf_blocks(root)
    for row in sorted(translated, key=lambda r: r["seq"]):
        text = row["translated"] if row["translated"] is not None else row["text"]
        if row["kind"] == "title":
            title_of(root).children = [text]
        elif row["kind"] == "meta-description":
            description_of(root).attributes["content"] = text
        else:
            tags = sorted(row["tag_map"], key=lambda t: -len(t["token"]))
            if config.token_loss == "source" and any(t["token"] not in text for t in tags):
                text = row["text"]
            for t in tags:
                text = text.replace(t["token"], t["tag"])
            block = blocks[row["node_ord"]]
            block.children = parse_fragment(text, block.name)
    if target_lang in config.rtl_languages:
        turn_right_to_left(root, target_lang[:2])
    return "<!DOCTYPE html>" + serialized(root)


def turn_right_to_left(root: Node, language: str = "ar") -> None:
    root.attributes.update(dir="rtl", lang=language)
    styles = [n for n in elements(root.children[0]) if n.name == "style"]
    if styles:
        styles[-1].add_text(RTL_RULES)
    else:
        root.children[0].children.append(Node("style", {"id": "rtl-override"}, [RTL_RULES]))


def rebuilt(pages: DataFrame, translated: DataFrame, target_lang: str, key: str = "page_id", html: str = "html", carry: list[str] = (), config: EngineConfig = COMPATIBLE) -> DataFrame:
    """(key, *carry, source_html, translated_html, rtl, warning) of every page.

    ``translated`` has the segment columns and ``translated``.  A page without segments is
    returned as it is, with a warning.
    """
    rows = translated.groupBy(key).agg(F.collect_list(F.struct("seq", "kind", "text", "tag_map", "node_ord", "translated")).alias("_rows"))
    joined = pages.select(key, *carry, html).join(rows, key, "left")
    schema = T.StructType([pages.schema[c] for c in (key, *carry)]).add("source_html", "string").add("translated_html", "string").add("rtl", "boolean").add("warning", "string")

    def work(batches):
        for batch in batches:
            for first in range(0, len(batch), AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                pages_, found = part[html].to_pylist(), part["_rows"].to_pylist()
                out = [put_back(p, r, target_lang, config) if r else p for p, r in zip(pages_, found, strict=True)]
                warning = [None if r else "No translatable content found" for r in found]
                rtl = pa.array([target_lang in config.rtl_languages] * len(out), pa.bool_())
                yield pa.RecordBatch.from_arrays([*[part[c] for c in (key, *carry)], part[html], pa.array(out, pa.string()), rtl, pa.array(warning, pa.string())], schema.names)

    return joined.mapInArrow(work, schema)
