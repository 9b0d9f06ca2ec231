"""Markdown to a flat array of nodes, and what is read off it: HTML, plain text, depth, breadth, paragraphs, leaves.

Two passes: lines to blocks by indentation, then inline spans within a block's text. A node's span is in characters of the
source. A heading holds what follows it up to the next heading of its level or above.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

from ..udf import row_udf

NODES = "array<struct<id:int,parent:int,ordinal:int,depth:int,kind:string,start_idx:int,end_idx:int,text:string,attrs:map<string,string>>>"
LEAVES = ("Text", "CODE", "PreCode", "Latex", "HR", "BR", "IMG", "Checkbox", "HTML")


@dataclass
class Node:
    kind: str
    start: int
    end: int
    text: str = ""
    attrs: dict = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


_HEADING = re.compile(r" {0,3}(#+) +(.*?)\s*$")
_ITEM = re.compile(r"( *)([-*]|\d+\.) +")
_FENCE = re.compile(r"( *)```(.*)$")
_RULE = re.compile(r"\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_ROW = re.compile(r" *\|.*\| *$")
_DIVIDER = re.compile(r" *\|(?: *:?-+:? *\|)+ *$")
_INLINE = re.compile(
    r"(?P<code>`+)(?P<code_text>.+?)(?P=code)(?!`)|(?P<latex>\\\((?P<l1>.+?)\\\)|\\\[(?P<l2>[\s\S]+?)\\\]|\$\$(?P<l3>[\s\S]+?)\$\$|\$(?P<l4>[^$\n]+?)\$)"
    r"|(?P<img>!\[(?P<alt>[^\]\n]*)\]\((?P<src>[^)\s]*)(?: +\"[^\"]*\")?\))|(?P<link>\[(?P<label>[^\[\]\n]*)\]\((?P<href>[^)\s]*)(?: +\"(?P<title>[^\"]*)\")?\))"
    r"|(?P<check>\[[ *]\](?= ))|(?P<bracket>\[(?P<inside>[^\[\]\n]+)\])|(?P<b>\*\*(?=\S)(?P<b_text>.+?)(?<=\S)\*\*)|(?P<s>~~(?P<s_text>.+?)~~)"
    r"|(?P<i>\*(?=[^\s*])(?P<i_text>[^*\n]+?)(?<=\S)\*|(?<!\w)_(?=\S)(?P<u_text>[^_\n]+?)(?<=\S)_(?!\w))|(?P<br><br */?>|  \n)|(?P<html></?[A-Za-z][^<>\n]*>|&\w{1,31};|&#\d{1,7};)"
)


#: What an inline span begins with; where no line is broken by blanks, a set of signs is found faster.
_SIGN, _SIGN_OR_BREAK = re.compile(r"[`\\$!\[*~_<&]"), re.compile(r"[`\\$!\[*~_<&]|  \n")


def _spans(source: str, start: int, end: int):
    """The matches of _INLINE, tried only where one may begin."""
    sign = _SIGN if source.find("  \n", start, end) < 0 else _SIGN_OR_BREAK
    while (s := sign.search(source, start, end)) is not None:
        m = _INLINE.match(source, s.start(), end)
        start = m.end() if m else s.start() + 1
        if m:
            yield m


def _inline(parent: Node, source: str, start: int, end: int) -> None:
    at = start
    for m in _spans(source, start, end):
        if m.start() > at:
            parent.add(Node("Text", at, m.start(), source[at : m.start()]))
        name = next(k for k in ("code", "latex", "img", "link", "check", "bracket", "b", "s", "i", "br", "html") if m[k] is not None)
        if name == "code":
            parent.add(Node("CODE", m.start(), m.end(), m["code_text"]))
        elif name == "latex":
            block = m["l2"] is not None or m["l3"] is not None
            parent.add(Node("Latex", m.start(), m.end(), next(m[k] for k in ("l1", "l2", "l3", "l4") if m[k] is not None), {"block": str(block).lower()}))
        elif name == "img":
            parent.add(Node("IMG", m.start(), m.end(), m["alt"], {"src": m["src"]}))
        elif name == "check":
            first = not parent.children and parent.kind in ("LI", "SPAN", "P")
            parent.add(Node("Checkbox" if first else "Text", m.start(), m.end(), m[0], {"checked": str(m[0] == "[*]").lower()} if first else {}))
        elif name in ("br", "html"):
            parent.add(Node("BR" if name == "br" else "HTML", m.start(), m.end(), m[0]))
        else:
            inner = {"link": "label", "bracket": "inside", "b": "b_text", "s": "s_text", "i": "i_text" if m["i_text"] is not None else "u_text"}[name]
            node = parent.add(Node({"link": "A", "bracket": "Bracket", "b": "B", "s": "S", "i": "I"}[name], m.start(), m.end()))
            if name == "link":
                node.attrs = {"href": m["href"]} | ({"title": m["title"]} if m["title"] else {})
            _inline(node, source, m.start(inner), m.end(inner))
        at = m.end()
    if at < end:
        parent.add(Node("Text", at, end, source[at:end]))


class _Blocks:
    def __init__(self, source: str):
        self.source = source
        self.lines, at = [], 0
        for line in source.split("\n"):
            self.lines.append((at, line))
            at += len(line) + 1
        self.warnings: list[str] = []

    def parse(self) -> Node:
        root = Node("Document", 0, len(self.source))
        self.fill(root, 0, len(self.lines), 0)
        _nest_headings(root)
        for node in root.walk():
            if node.kind == "B" and any(x.kind == "B" for x in node.walk() if x is not node):
                self.warnings.append(f"nested <b> at {node.start}")
            if node.kind == "Bracket" and any(x.kind == "Bracket" for x in node.walk() if x is not node):
                self.warnings.append(f"nested brackets at {node.start}")
        return root

    def fill(self, parent: Node, first: int, last: int, margin: int) -> None:
        """Blocks of the lines [first, last), whose first margin characters belong to what stands above."""
        i = first
        while i < last:
            begin, whole = self.lines[i]
            line = whole[margin:] if not whole[:margin].strip() else whole.lstrip()
            at = begin + len(whole) - len(line)
            if not line.strip():
                i += 1
            elif m := _HEADING.match(line):
                node = parent.add(Node("H", at, begin + len(whole), attrs={"level": str(min(len(m[1]), 6))}))
                _inline(node.add(Node("SPAN", at + m.start(2), at + m.end(2))), self.source, at + m.start(2), at + m.end(2))
                i += 1
            elif m := _FENCE.match(line):
                j = i + 1
                while j < last and not re.match(r" *``` *$", self.lines[j][1]):
                    j += 1
                stop = min(j, last - 1)
                if j == last:
                    self.warnings.append(f"code block at {at} isn't closed")
                body = "\n".join(x for _, x in self.lines[i + 1 : j])
                parent.add(Node("PreCode", at, self.lines[stop][0] + len(self.lines[stop][1]), body, {"lang": m[2].strip()}))
                i = j + 1
            elif _RULE.match(line):
                parent.add(Node("HR", at, begin + len(whole)))
                i += 1
            elif m := _ITEM.match(line):
                i = self.items(parent, i, last, margin)
            elif _ROW.match(line) and i + 1 < last and _DIVIDER.match(self.lines[i + 1][1]):
                i = self.table(parent, i, last)
            elif line.lstrip().startswith(">") and parent.kind == "LI":
                j = i
                while j < last and self.lines[j][1].lstrip().startswith(">"):
                    j += 1
                node = parent.add(Node("BLOCKQUOTE", at, self.lines[j - 1][0] + len(self.lines[j - 1][1])))
                for b, text in self.lines[i:j]:
                    inner = b + text.index(">") + 1
                    _inline(node.add(Node("P", inner, b + len(text))), self.source, inner, b + len(text))
                i = j
            elif line.startswith("    ") and (i == first or not self.lines[i - 1][1].strip()):
                j = i
                while j < last and (not self.lines[j][1].strip() or self.lines[j][1][margin:].startswith("    ")):
                    j += 1
                while not self.lines[j - 1][1].strip():
                    j -= 1
                parent.add(Node("PreCode", at, self.lines[j - 1][0] + len(self.lines[j - 1][1]), "\n".join(x[margin + 4 :] for _, x in self.lines[i:j]), {"lang": ""}))
                i = j
            else:
                j = i + 1
                while j < last and self.lines[j][1].strip() and not self.opens(self.lines[j][1][margin:]):
                    j += 1
                end = self.lines[j - 1][0] + len(self.lines[j - 1][1])
                node = parent.add(Node("P" if parent.kind != "LI" else "SPAN", at, end))
                _inline(node, self.source, at, end)
                i = j

    @staticmethod
    def opens(line: str) -> bool:
        return bool(_HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or _ITEM.match(line) and len(line) - len(line.lstrip()) < 4 or _ROW.match(line) and line.lstrip().startswith("|"))

    def items(self, parent: Node, i: int, last: int, margin: int) -> int:
        """A list: items of one indentation (a drift of one blank is taken for it) and one kind of marker."""
        begin, whole = self.lines[i]
        indent = len(whole) - len(whole.lstrip())
        ordered = whole.lstrip()[0].isdigit()
        lead = _ITEM.match(whole.lstrip())
        node = parent.add(Node("OL" if ordered else "UL", begin + indent, begin + len(whole), attrs={"start": lead[2][:-1]} if ordered else {}))
        while i < last:
            begin, whole = self.lines[i]
            if not whole.strip():
                if i + 1 < last and self.lines[i + 1][1].strip() and (len(self.lines[i + 1][1]) - len(self.lines[i + 1][1].lstrip()) > indent or self._same(self.lines[i + 1][1], indent, ordered)):
                    i += 1
                    continue
                break
            if not self._same(whole, indent, ordered):
                break
            here = len(whole) - len(whole.lstrip())
            if here != indent:
                self.warnings.append(f"indentation of {here} for {indent} at {begin}")
            marker = _ITEM.match(whole.lstrip())
            inner = here + marker.end()
            j = i + 1
            while j < last:
                text = self.lines[j][1]
                if text.strip() and len(text) - len(text.lstrip()) <= indent and (self.opens(text.lstrip()) or not self.lines[j - 1][1].strip()):
                    break
                if text.strip() and self._same(text, indent, ordered):
                    break
                if text.strip() and len(text) - len(text.lstrip()) <= indent and _ITEM.match(text.lstrip()):
                    break
                j += 1
            while not self.lines[j - 1][1].strip():
                j -= 1
            item = node.add(Node("LI", begin + here, self.lines[j - 1][0] + len(self.lines[j - 1][1])))
            self.lines[i] = (begin + inner, whole[inner:])
            self.lines[i + 1 : j] = [(b + min(inner, len(t) - len(t.lstrip())), t[min(inner, len(t) - len(t.lstrip())) :]) for b, t in self.lines[i + 1 : j]]
            self.fill(item, i, j, 0)
            node.end = item.end
            i = j
        return i

    @staticmethod
    def _same(line: str, indent: int, ordered: bool) -> bool:
        bare = line.lstrip()
        m = _ITEM.match(bare)
        return bool(m) and abs(len(line) - len(bare) - indent) <= 1 and m[2][0].isdigit() == ordered and not _RULE.match(line)

    def table(self, parent: Node, i: int, last: int) -> int:
        align = ["center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else "" for c in (x.strip() for x in self.lines[i + 1][1].strip().strip("|").split("|"))]
        node = parent.add(Node("TABLE", self.lines[i][0], self.lines[i][0]))
        j = i
        while j < last and _ROW.match(self.lines[j][1]):
            begin, line = self.lines[j]
            node.end = begin + len(line)
            if j != i + 1:
                row = node.add(Node("TR", begin, begin + len(line)))
                at = line.index("|") + 1
                for k, cell in enumerate(line.strip().strip("|").split("|")):
                    bare = cell.strip()
                    start = begin + at + len(cell) - len(cell.lstrip())
                    td = row.add(Node("TH" if j == i else "TD", start, start + len(bare), attrs={"align": align[k]} if k < len(align) and align[k] else {}))
                    _inline(td, self.source, start, start + len(bare))
                    at += len(cell) + 1
            j += 1
        return j


def _nest_headings(root: Node) -> None:
    out, stack = [], []
    for child in root.children:
        if child.kind == "H":
            while stack and int(stack[-1].attrs["level"]) >= int(child.attrs["level"]):
                stack.pop()
            if stack:
                stack[-1].add(child)
            else:
                out.append(child)
            stack.append(child)
        elif stack:
            stack[-1].add(child)
        else:
            out.append(child)
    root.children = out
    for child in out:
        child.parent = root

    def stretch(node):
        for x in node.children:
            stretch(x)
            if node.kind == "H":
                node.end = max(node.end, x.end)

    stretch(root)


def parse_tree(source: str | None) -> tuple[Node, list[str]]:
    blocks = _Blocks(source or "")
    return blocks.parse(), blocks.warnings


def flatten(root: Node) -> list[dict]:
    out: list[dict] = []

    def visit(node, parent, ordinal, depth):
        me = len(out)
        out.append({"id": me, "parent": parent, "ordinal": ordinal, "depth": depth, "kind": node.kind, "start_idx": node.start, "end_idx": node.end, "text": node.text, "attrs": node.attrs})
        for k, child in enumerate(node.children):
            visit(child, me, k, depth + 1)

    visit(root, None, 0, 0)
    return out


def parse(source: str | None) -> tuple[list[dict], list[str]]:
    root, warnings = parse_tree(source)
    return flatten(root), warnings


def innermost(nodes: list[tuple], spans: list[tuple[int, int]]) -> list:
    """For each (start, end) the last of the nodes (start, end, ...), which are in order of their starts, that holds it, or None.

    One pass by starts over a stack: a node ends those before it that don't reach beyond it, so the ends on the stack fall
    and the last node that reaches a span's end is found by halving.
    """
    out, stack, ends, i = [None] * len(spans), [], [], 0
    for k in sorted(range(len(spans)), key=lambda k: spans[k][0]):
        start, end = spans[k]
        while i < len(nodes) and nodes[i][0] <= start:
            while stack and stack[-1][1] <= nodes[i][1]:
                stack.pop()
                ends.pop()
            stack.append(nodes[i])
            ends.append(-nodes[i][1])
            i += 1
        if j := bisect_right(ends, -end):
            out[k] = stack[j - 1]
    return out


def innermost_kinds(root: Node, spans: list[tuple[int, int]]) -> list[str | None]:
    """Kinds of the smallest containers around spans; of a leaf, its container's."""
    nodes = sorted(((n.start, n.end, n.kind) for n in root.walk() if n.kind != "Text"), key=lambda n: n[0])
    return [n[2] if n else None for n in innermost(nodes, spans)]


def containers(nodes: list[tuple], spans: list[tuple[int, int]]) -> list[dict]:
    """start, stop and kind of each distinct span that some node (start, end, depth, kind) holds: of the one that begins last, then of the shortest, then of the deepest."""
    spans = sorted(set(spans))
    found = innermost(sorted(nodes, key=lambda n: (n[0], -n[1], n[2])), spans)
    return [{"start": a, "stop": b, "kind": n[3]} for (a, b), n in zip(spans, found, strict=True) if n]


_TAGS = {"P": "p", "SPAN": "span", "I": "i", "B": "b", "S": "s", "UL": "ul", "OL": "ol", "LI": "li", "TABLE": "table", "TR": "tr", "TH": "th", "TD": "td", "BLOCKQUOTE": "blockquote", "A": "a", "CODE": "code"}


def to_html(node: Node) -> str:
    inner = "".join(map(to_html, node.children))
    a = node.attrs
    match node.kind:
        case "Document":
            return inner
        case "Text":
            return html.escape(node.text, quote=False)
        case "HTML":
            return node.text
        case "H":
            head, rest = to_html(node.children[0]).removeprefix("<span>").removesuffix("</span>"), "".join(map(to_html, node.children[1:]))
            return f"<h{a['level']}>{head}</h{a['level']}>{rest}"
        case "Bracket":
            return f"[{inner}]"
        case "PreCode":
            return f"<pre><code{f' class="language-{html.escape(a["lang"])}"' if a.get('lang') else ''}>{html.escape(node.text, quote=False)}</code></pre>"
        case "CODE":
            return f"<code>{html.escape(node.text, quote=False)}</code>"
        case "Latex":
            return f"\\[{node.text}\\]" if a.get("block") == "true" else f"\\({node.text}\\)"
        case "HR" | "BR":
            return f"<{node.kind.lower()}>"
        case "IMG":
            return f'<img src="{html.escape(a["src"])}" alt="{html.escape(node.text)}">'
        case "Checkbox":
            return f'<input type="checkbox" disabled{" checked" if a.get("checked") == "true" else ""}>'
        case "SPAN" if node.parent is not None and node.parent.kind == "LI":
            return inner
    tag = _TAGS[node.kind]
    more = "".join(f' {k}="{html.escape(v)}"' for k, v in a.items() if k in ("href", "title", "align") or k == "start" and v != "1")
    return f"<{tag}{more}>{inner}</{tag}>"


def to_text(node: Node) -> str:
    if node.kind in LEAVES:
        return "" if node.kind in ("HR", "Checkbox") else "\n" if node.kind == "BR" else html.unescape(node.text) if node.kind == "HTML" else node.text
    block = node.kind in ("P", "H", "LI", "TR", "UL", "OL", "TABLE", "BLOCKQUOTE", "Document")
    parts = [to_text(c) for c in node.children]
    return "\n".join(p for p in parts if p) if block and any(c.kind in ("P", "H", "LI", "TR", "UL", "OL", "TABLE", "SPAN") for c in node.children) else "".join(parts)


# Depth and breadth.


def _set_depths(node: Node, depth: int, out: dict[int, int]) -> None:
    out[id(node)] = depth
    children = node.children
    levels = defaultdict(int)
    for c in children:
        if c.kind == "H":
            levels[int(c.attrs["level"])] += 1
    if levels:
        top = min(levels)
        base, current = depth + (levels[top] > 1), 0
        for c in children:
            if c.kind == "H":
                current = int(c.attrs["level"])
            d = current - top + (base if current else depth)
            _set_depths(c, d if d >= 0 else depth, out)
        return
    inner = depth
    if node.kind in ("UL", "OL"):
        inner += sum(c.kind == "LI" for c in children) > 1
        deeper = ("LI",)
    elif node.kind != "LI":
        inner += sum(c.kind in ("UL", "OL", "TABLE") for c in children) > 1
        deeper = ("UL", "OL")
    else:
        deeper = ()
    for c in children:
        _set_depths(c, inner if c.kind in deeper else depth, out)


def depth_of(root: Node) -> int:
    out: dict[int, int] = {}
    _set_depths(root, 1, out)
    return max(out[id(n)] for n in root.walk() if not n.children)


def breadth_of(node: Node) -> int:
    if node.kind in ("OL", "UL"):
        return sum(c.kind == "LI" for c in node.children)
    if node.kind not in ("H", "Document"):
        return 1
    long = lambda c: sum(x.kind == "LI" for x in c.children) > 1
    numbered, bulleted = ([c for c in node.children if c.kind == k and long(c)] for k in ("OL", "UL"))
    headings, lists = [c for c in node.children if c.kind == "H"], len(numbered) + len(bulleted)
    if headings:
        if len(headings) == 1 and not lists:
            return breadth_of(headings[0])
        closing = re.match("总结|结论|Conclusion", to_text(headings[-1].children[0])) is not None
        return len(headings) - closing + lists
    if not numbered:
        return breadth_of(bulleted[0]) if lists == 1 else lists
    if len(numbered) > 1:
        return lists
    if bulleted:
        deep: dict[int, int] = {}
        _set_depths(numbered[0], 1, deep)
        nested = any(max(deep[id(x)] for x in item.walk()) > 1 for item in numbered[0].children)
        return (breadth_of(numbered[0]) if nested else 1) + len(bulleted)
    return breadth_of(numbered[0])


def widest(root: Node) -> tuple[int, int, int]:
    """(breadth, start, end) of the first node of the largest breadth."""
    best = max(((breadth_of(n), -i, n) for i, n in enumerate(root.walk())), key=lambda x: x[:2])
    return best[0], best[2].start, best[2].end


def paragraph_blocks(root: Node) -> list[list[str]]:
    """Paragraphs' lines in blocks that lists and headings separate; a window never spans two blocks."""
    out: list[list[str]] = []

    def lines(node):
        return [re.sub(r"\s+", " ", x.strip()) for x in re.split("\n+", to_text(node).strip()) if x.strip()]

    def visit(node):
        texts: list[str] = []
        for c in node.children:
            if c.kind in ("P", "SPAN", "Text"):
                texts += lines(c)
            elif c.kind in ("UL", "OL", "H", "LI"):
                if c.kind == "LI" and not any(x.kind in ("UL", "OL") for x in c.children):
                    texts += [x for g in c.children for x in lines(g)]
                    continue
                out.append(texts)
                texts = []
                visit(c)
        out.append(texts)

    visit(root)
    return [x for x in out if x]


def text_leaves(root: Node, ignored: tuple[str, ...]) -> list[tuple[int, str, str]]:
    """(start, container's kind, text) of text outside ignored kinds."""
    out = []

    def visit(node):
        if node.kind in ignored:
            return
        if node.kind == "Text":
            out.append((node.start, node.parent.kind if node.parent else "", node.text))
        for c in node.children:
            visit(c)

    visit(root)
    return out


@row_udf(f"nodes {NODES}, warnings array<string>")
def markdown_nodes(text):
    nodes, warnings = parse(text)
    return {"nodes": nodes, "warnings": warnings}


@row_udf("array<struct<start:int,stop:int,kind:string>>")
def text_containers(text):
    """The spans of a Markdown text's Text nodes, each with the kind of the innermost node around it."""
    nodes = parse(text)[0]
    return containers([(n["start_idx"], n["end_idx"], n["depth"], n["kind"]) for n in nodes if n["kind"] != "Text"], [(n["start_idx"], n["end_idx"]) for n in nodes if n["kind"] == "Text"])


FACTS = "html:string,plain:string,depth:int,breadth:int,breadth_start:int,breadth_end:int,blocks:array<array<string>>,warnings:array<string>"


def facts_of(root: Node, warnings: list[str]) -> dict:
    breadth, start, end = widest(root)
    return {"html": to_html(root), "plain": to_text(root), "depth": depth_of(root), "breadth": breadth, "breadth_start": start, "breadth_end": end, "blocks": paragraph_blocks(root), "warnings": warnings}


@row_udf(f"struct<{FACTS}>")
def markdown_facts(text):
    """All that is read off a Markdown text, from one parse."""
    return facts_of(*parse_tree(text))
