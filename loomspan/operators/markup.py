"""XML and HTML as they are found: tags that don't balance, stray signs and entities included.

An end tag closes the nearest earlier open tag of its name; one without any stays as a node of its own. A blank, digit or sign
after < makes it text, and so does a ! inside a tag, so comments and document types are text. An entity is & to ; with
at most 32 characters and no blank, quote or bracket in it.
"""

from __future__ import annotations

import html
import re

from ..udf import row_udf
from .markdown import NODES, Node, flatten

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STYLES = frozenset("b i u s em strong sub sup msub msup code mark small".split())
_TOKEN = re.compile(r"<(?P<end>/)?(?P<name>[A-Za-z][\w:.-]*)(?P<rest>(?:[^<>\"'!]|\"[^\"]*\"|'[^']*')*?)(?P<void>/)?>|&(?P<entity>[^\s<&=\"'/;]{1,31});")
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def parse_markup(source: str | None) -> Node:
    source = source or ""
    root = Node("Document", 0, len(source))
    top, at = root, 0

    def text(begin, end):
        if begin < end:
            if top.children and top.children[-1].kind == "Text" and top.children[-1].end == begin:
                last = top.children[-1]
                last.end, last.text = end, source[last.start : end]
            else:
                top.add(Node("Text", begin, end, source[begin:end]))

    for m in _TOKEN.finditer(source):
        text(at, m.start())
        at = m.end()
        if m["entity"] is not None:
            top.add(Node("Entity", m.start(), m.end(), m[0]))
            continue
        name = m["name"].lower()
        if m["end"]:
            up = top
            while up.parent is not None and up.attrs.get("tag") != name:
                up = up.parent
            if up.parent is None:
                top.add(Node("Unbalanced", m.start(), m.end(), m[0], {"tag": name}))
                continue
            # Tags opened inside it without an end are single: what followed them moves up beside them.
            while top is not up:
                inner, top = top, top.parent
                inner.kind = "Single"
                for child in inner.children:
                    top.add(child)
                inner.children = []
            up.end, top = m.end(), up.parent
            continue
        attrs = {"tag": name} | {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m["rest"])}
        node = top.add(Node("Void" if m["void"] or name in VOID else "Tag", m.start(), m.end(), "", attrs))
        if node.kind == "Tag":
            top = node
    text(at, len(source))
    while top is not root:
        inner, top = top, top.parent
        inner.kind = "Single"
        for child in inner.children:
            top.add(child)
        inner.children = []
    return root


def logical_text(root: Node) -> tuple[str, list[int]]:
    """The text that is read, entities resolved, and for each of its characters where it stands in the source."""
    out, places = [], []

    def visit(node):
        if node.kind == "Text":
            out.append(node.text)
            places.extend(range(node.start, node.end))
        elif node.kind == "Entity":
            plain = html.unescape(node.text)
            out.append(plain)
            places.extend([node.start] * len(plain))
        elif node.kind == "Unbalanced":
            out.append(node.text)
            places.extend(range(node.start, node.end))
        elif node.attrs.get("tag") not in ("script", "style"):
            for c in node.children:
                visit(c)

    visit(root)
    return "".join(out), places


def style_spans(root: Node) -> list[tuple[int, int, str]]:
    """(start, stop, styles) over the logical text, styles dotted from the outermost; plain text is left out."""
    out: list[tuple[int, int, str]] = []
    at = 0

    def visit(node, styles):
        nonlocal at
        if node.kind in ("Text", "Entity", "Unbalanced"):
            n = len(html.unescape(node.text)) if node.kind == "Entity" else len(node.text)
            if styles and n:
                name = ".".join(styles)
                if out and out[-1][1] == at and out[-1][2] == name:
                    out[-1] = (out[-1][0], at + n, name)
                else:
                    out.append((at, at + n, name))
            at += n
            return
        tag = node.attrs.get("tag", "")
        if tag in ("script", "style"):
            return
        for i, c in enumerate(node.children):
            more = [tag] if tag in STYLES and not (tag in ("msub", "msup") and i == 0) else []
            visit(c, styles + more)

    visit(root, [])
    return out


@row_udf(NODES)
def markup_nodes(text):
    return flatten(parse_markup(text))


@row_udf("text string, offsets array<int>, styles array<struct<start:int,stop:int,style:string>>")
def markup_text(text):
    root = parse_markup(text)
    plain, places = logical_text(root)
    return {"text": plain, "offsets": places, "styles": [{"start": a, "stop": b, "style": s} for a, b, s in style_spans(root)]}


@row_udf("string")
def unescape(text):
    return html.unescape(text) if text is not None else None
