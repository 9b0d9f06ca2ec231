"""Formulas by operator precedence: LaTeX and Lean sources to node arrays, and Lean terms to LaTeX.

One precedence parser serves both: a table gives each operator its priority and side, and a lexer its tokens.
Text between nodes is kept by their spans, so a tree gives its source back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..udf import row_udf
from .markdown import NODES, Node, flatten

LATEX = {90: r"\circ", 80: "^ _", 70: r"× * ÷ / \% \cdot \times \mod \bmod \pmod \cap \setminus \div \oplus \otimes \odot \ast \star", 65: r"＋ + - − \cup", 50: r"= &= =& &=& ≡ ≈ != ≠ &≠ ≠& &≠& < &< <& &<& > &> >& &>& ≤ &≤ ≤& &≤& ≥ &≥ ≥& &≥& ∈ ∋ \in \ni \subset \subseteq \supset \supseteq \notin \ne \neq \approx \lt \gt \leq \le \geq \ge \mid \nmid \parallel \nparallel \perp \mapsto \subsetneq \supsetneq \triangle \simeq \approxeq \cong \to \hookrightarrow \twoheadrightarrow \equiv \sim \vdash \vDash \doteq \triangleq \ll \gg \prec \succ \preceq \succeq \asymp \propto \bowtie \oslash \dagger \ddagger", 35: r"\land \wedge", 30: r"\lor \vee", 25: r"\implies \rightarrow &", 23: r"\Rightarrow", 20: r"\iff \leftrightarrow \Leftrightarrow", 19: r"\leftarrow \Leftarrow", 5: r"\\", 3: ", ;"}
LATEX_PRIORITY = {t: p for p, tokens in LATEX.items() for t in tokens.split()}
LATEX_RIGHT = frozenset(r"^ _ \implies \rightarrow \Rightarrow \to \mapsto".split())
BIG = {t: p for p, tokens in {67: r"\sum \prod \coprod \int \oint \biguplus \iint \iiint \iiiint \idotsint \bigoplus \bigotimes \bigodot \nabla \partial", 60: r"\bigcap \bigcup \bigsqcup", 50: r"\bigvee \bigwedge"}.items() for t in tokens.split()}
LIMITS = frozenset(r"\lim \max \min \sup \inf \det \gcd \Pr \limsup \liminf \arg".split())
QUANTIFIERS = frozenset(r"\forall \exists \nexists".split())
TWO = frozenset(r"\frac \dfrac \tfrac \cfrac \binom \dbinom \tbinom \stackrel \color \textcolor \overset \underset \operatorname* \rule".split())
ONE = frozenset(r"\operatorname \mathbf \mathbb \mathcal \mathrm \mathit \mathsf \mathfrak \boldsymbol \bm \text \textbf \textit \texttt \mbox \hat \bar \tilde \vec \dot \ddot \overline \underline \widehat \widetilde \overbrace \underbrace \boxed \tag \label \phantom \not \mathop \xrightarrow \xleftarrow \substack".split())
FUNCTIONS = frozenset(r"\sin \cos \tan \cot \sec \csc \arcsin \arccos \arctan \sinh \cosh \tanh \log \ln \lg \exp \deg \dim \ker".split())

LEAN = {91: "∘", 80: "^", 73: "• ⊙", 72: "×", 71: "* / % ∩ ⬝ \\", 70: "// @", 69: "⊓", 68: "& :: ⊔ |||", 67: "|>.", 66: "+ - ++ ∪", 62: "is", 51: "> ≥ < ≤ = == ≠ ∈ ∉ ⊆ ⊇ ∣", 37: "&& ||", 35: "∧", 32: "≡ ≢ ⊗", 31: "⊕", 30: "∨", 25: "→", 21: "↔", 20: ": =>", 19: ":=", 18: "↦ |>", 3: ", ;"}
LEAN_PRIORITY = {t: p for p, tokens in LEAN.items() for t in tokens.split()}
LEAN_RIGHT = frozenset("^ → ∧ ∨ :: := => ↦ ×".split())
LEAN_PREFIX = {"-": 75, "+": 70, "¬": 50, "!": 50, "√": 72, "∛": 72, "∜": 72, "↑": 72, "⇑": 72, "←": 60, "∑": 52, "∏": 52, "∀": 24, "∃": 24, "fun": 19, "by": 10, "have": 7, "let": 7, "show": 7}
LEAN_POSTFIX = {"⁻¹": 95, "²": 95, "³": 95, "⁴": 95}
PAIRS = {"(": ")", "[": "]", "{": "}", "⟨": "⟩", "⌈": "⌉", "⌊": "⌋", "‖": "‖", "«": "»", r"\{": r"\}", r"\langle": r"\rangle", r"\lceil": r"\rceil", r"\lfloor": r"\rfloor", r"\lbrace": r"\rbrace"}
_SIZES = r"\\(?:left|right|bigl|bigr|Bigl|Bigr|biggl|biggr|Biggl|Biggr|big|Big|bigg|Bigg)"
_LATEX_TOKEN = re.compile(rf"\s+|%[^\n]*|(?P<size>{_SIZES}\s*(?:\\[A-Za-z]+|\\.|.))|(?P<env>\\(?:begin|end)\s*\{{[^}}]*\}})|(?P<word>\\[A-Za-z]+\*?|\\.)|(?P<num>\d+(?:\.\d+)?)|(?P<op>&[=<>≠≤≥]&?|[=<>≠≤≥]&|!=)|(?P<sym>.)", re.DOTALL)
_LEAN_TOKEN = re.compile(r"(?P<space>\s+)|(?P<comment>--[^\n]*|/-[\s\S]*?-/)|(?P<num>\d+(?:\.\d+)?)|(?P<word>[^\W\d][\w'!?₀-₉]*(?:\.[^\W\d][\w'₀-₉]*)*)|(?P<op>\|>\.?|:=|=>|==|&&|\|\|\|?|//|::|\+\+|⁻¹)|(?P<sym>.)", re.DOTALL)


@dataclass
class Token:
    text: str
    start: int
    end: int
    kind: str


def latex_tokens(source: str) -> list[Token]:
    return [Token(m[0], m.start(), m.end(), m.lastgroup) for m in _LATEX_TOKEN.finditer(source) if m.lastgroup]


def lean_tokens(source: str) -> list[Token]:
    return [Token(m[0], m.start(), m.end(), m.lastgroup) for m in _LEAN_TOKEN.finditer(source) if m.lastgroup not in ("space", "comment")]


class _Parser:
    def __init__(self, source: str, tokens: list[Token]):
        self.source, self.tokens, self.i = source, tokens, 0

    def peek(self) -> Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def take(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def node(self, kind: str, start: int, end: int, children=(), text: str = "", **attrs) -> Node:
        out = Node(kind, start, end, text, attrs)
        for c in children:
            out.add(c)
        return out

    def document(self) -> Node:
        root = Node("Document", 0, len(self.source))
        while (t := self.peek()) is not None:
            before = self.i
            if (n := self.expression(0)) is not None:
                root.add(n)
            if self.i == before:
                self.take()
                root.add(self.node("Token", t.start, t.end, text=t.text))
        return root

    def infix(self, left: Node, op: Token, right: Node | None) -> Node:
        children = [left] if right is None else [left, right]
        return self.node("Infix", left.start, (right or left).end if right else op.end, children, op.text, op=op.text)


class LatexParser(_Parser):
    depth = 0

    def expression(self, least: int) -> Node | None:
        left = self.juxtaposed()
        while (op := self.peek()) is not None and (p := LATEX_PRIORITY.get(op.text)) is not None and p >= least:
            if left is None:
                break
            self.take()
            right = self.expression(p if op.text in LATEX_RIGHT else p + 1)
            left = self.infix(left, op, right)
        return left

    def juxtaposed(self) -> Node | None:
        parts = []
        while (t := self.peek()) is not None and t.text not in LATEX_PRIORITY or t is not None and not parts and t.text in "+-−－":
            n = self.scripted()
            if n is None:
                break
            parts.append(n)
        if len(parts) <= 1:
            return parts[0] if parts else None
        return self.node("Juxtaposition", parts[0].start, parts[-1].end, parts)

    def scripted(self) -> Node | None:
        n = self.atom()
        while n is not None and (t := self.peek()) is not None and t.text in ("^", "_"):
            self.take()
            right = self.atom()
            n = self.infix(n, t, right)
        return n

    def limits(self, children: list[Node]) -> None:
        while (t := self.peek()) is not None and t.text in ("^", "_", r"\limits"):
            self.take()
            if t.text != r"\limits" and (n := self.atom()) is not None:
                n.attrs["script"] = t.text
                children.append(n)

    def atom(self) -> Node | None:
        t = self.peek()
        if t is None or t.text in ("}", "]", ")") and self.depth or t.kind == "env" and t.text.startswith(r"\end") or t.kind == "size" and re.match(r"\\(right|bigr|Bigr|biggr|Biggr)", t.text):
            return None
        self.take()
        w = t.text
        if w in "+-−－" and t.kind == "sym":
            n = self.scripted()
            return self.node("Unary", t.start, n.end if n else t.end, [n] if n else [], w, op=w)
        if t.kind == "num":
            return self.node("Float" if "." in w else "Number", t.start, t.end, text=w)
        if t.kind == "env" or t.kind == "size" or w in PAIRS:
            return self.group(t)
        children: list[Node] = []
        if w == r"\sqrt" and self.peek() is not None and self.peek().text == "[":
            children.append(self.group(self.take()))
        arity = 2 if w in TWO else 1 if w in ONE or w == r"\sqrt" else 0
        for _ in range(arity):
            if (n := self.atom()) is not None:
                children.append(n)
        if w in BIG or w in LIMITS:
            self.limits(children)
            body = self.expression(BIG.get(w, 67)) if w in BIG else self.scripted()
            children += [body] if body else []
            return self.node("BigOperator" if w in BIG else "Limit", t.start, children[-1].end if children else t.end, children, w)
        if w in QUANTIFIERS:
            n = self.expression(LATEX_PRIORITY[r"\land"] + 1)
            return self.node("Quantifier", t.start, n.end if n else t.end, [n] if n else [], w)
        if w in FUNCTIONS:
            self.limits(children)
            n = self.scripted()
            children += [n] if n else []
        kind = "Command" if w.startswith("\\") else "Token"
        return self.node(kind, t.start, children[-1].end if children else t.end, children, w)

    def group(self, t: Token) -> Node:
        self.depth += 1
        close = PAIRS.get(t.text)
        ends = (lambda x: x.kind == "env" and x.text.startswith(r"\end")) if t.kind == "env" else (lambda x: x.kind == "size" and bool(re.match(r"\\(right|bigr|Bigr|biggr|Biggr|big|Big)", x.text))) if t.kind == "size" else (lambda x: x.text == close)
        children, end = [], t.end
        while (x := self.peek()) is not None and not ends(x):
            before = self.i
            if (n := self.expression(0)) is not None:
                children.append(n)
            if self.i == before:
                y = self.take()
                children.append(self.node("Token", y.start, y.end, text=y.text))
            end = self.tokens[self.i - 1].end
        if self.peek() is not None:
            end = self.take().end
        self.depth -= 1
        kind = "Environment" if t.kind == "env" else "Sizing" if t.kind == "size" else "Group"
        name = {"name": re.search(r"\{(.*)\}", t.text)[1]} if t.kind == "env" else {"open": t.text}
        return self.node(kind, t.start, end, children, "", **name)


class LeanParser(_Parser):
    stops = (")", "]", "}", "⟩", "⌉", "⌋", "»")

    def expression(self, least: int) -> Node | None:
        left = self.application()
        while (op := self.peek()) is not None and left is not None:
            if op.text in LEAN_POSTFIX:
                self.take()
                left = self.node("Postfix", left.start, op.end, [left], op.text, op=op.text)
                continue
            p = LEAN_PRIORITY.get(op.text)
            if p is None or p < least:
                break
            self.take()
            left = self.infix(left, op, self.expression(p if op.text in LEAN_RIGHT else p + 1))
        return left

    def application(self) -> Node | None:
        parts = []
        while (t := self.peek()) is not None and t.text not in self.stops and t.text not in LEAN_POSTFIX and (t.text not in LEAN_PRIORITY or not parts and t.text in LEAN_PREFIX):
            if parts and ("\n" in self.source[parts[-1].end : t.start] or t.text in LEAN_PREFIX):
                break
            if (n := self.atom()) is None:
                break
            parts.append(n)
        if len(parts) <= 1:
            return parts[0] if parts else None
        return self.node("Application", parts[0].start, parts[-1].end, parts)

    def atom(self) -> Node | None:
        t = self.take()
        if t.text in LEAN_PREFIX:
            n = self.expression(LEAN_PREFIX[t.text])
            kind = "Quantifier" if t.text in "∀∃" else "BigOperator" if t.text in "∑∏" else "Prefix"
            return self.node(kind, t.start, n.end if n else t.end, [n] if n else [], t.text, op=t.text)
        if t.text in PAIRS:
            close, children, end = PAIRS[t.text], [], t.end
            while (x := self.peek()) is not None and x.text != close:
                before = self.i
                if (n := self.expression(0)) is not None:
                    children.append(n)
                if self.i == before:
                    y = self.take()
                    children.append(self.node("Token", y.start, y.end, text=y.text))
                end = self.tokens[self.i - 1].end
            if self.peek() is not None:
                end = self.take().end
            return self.node("Group", t.start, end, children, "", open=t.text)
        if t.text in ("theorem", "lemma", "def", "import", "open", "namespace", "example", "instance", "variable"):
            n = self.expression(0)
            return self.node("Declaration", t.start, n.end if n else t.end, [n] if n else [], t.text)
        return self.node("Number" if t.kind == "num" else "Token", t.start, t.end, text=t.text)


def parse_latex(source: str | None) -> Node:
    return LatexParser(source or "", latex_tokens(source or "")).document()


def parse_lean(source: str | None) -> Node:
    return LeanParser(source or "", lean_tokens(source or "")).document()


def source_of(node: Node, source: str) -> str:
    return source[node.start : node.end]


_LEAN_LATEX = {"≥": r"\ge", "≤": r"\le", "≠": r"\ne", "≡": r"\equiv", "≢": r"\not\equiv", "∈": r"\in", "∉": r"\notin", "↔": r"\leftrightarrow", "→": r"\rightarrow", "×": r"\times", "•": r"\bullet", "⊙": r"\odot", "⊗": r"\otimes", "⊕": r"\oplus", "∧": r"\land", "∨": r"\lor", "∩": r"\cap", "∪": r"\cup", "⊆": r"\subseteq", "⊇": r"\supseteq", "∘": r"\circ", "*": r"\cdot", "⊔": r"\sqcup", "⊓": r"\sqcap", "↦": r"\mapsto", "&&": r"\&\&", "¬": r"\lnot", "∀": r"\forall", "∃": r"\exists", "∑": r"\sum", "∏": r"\prod", "√": r"\sqrt", "∛": r"\sqrt[3]", "∜": r"\sqrt[4]", "⁻¹": "^{-1}", "²": "^2", "³": "^3", "⁴": "^4", "%": r"\%", "↑": r"\uparrow", "==": r"=\!\!="}
_LEAN_GROUPS = {"(": (r"\left(", r"\right)"), "[": (r"\left[", r"\right]"), "{": (r"\left\{", r"\right\}"), "⟨": (r"\langle", r"\rangle"), "⌈": (r"\left\lceil", r"\right\rceil"), "⌊": (r"\left\lfloor", r"\right\rfloor"), "‖": (r"\left\lVert", r"\right\rVert"), "«": ("«", "»")}


def lean_to_latex(node: Node) -> str:
    parts = [lean_to_latex(c) for c in node.children]
    op = node.attrs.get("op", "")
    match node.kind:
        case "Infix" if op == "/" and len(parts) == 2:
            return rf"\frac {{{parts[0]}}} {{{parts[1]}}}"
        case "Infix" if op == "^" and len(parts) == 2:
            return rf"{{{parts[0]}}}^{{{parts[1]}}}"
        case "Infix":
            return f" {_LEAN_LATEX.get(op, op)} ".join(f"{{{p}}}" for p in parts)
        case "Postfix":
            return f"{{{parts[0]}}}{_LEAN_LATEX[op]}"
        case "Quantifier" | "BigOperator":
            return f"{_LEAN_LATEX[op]}\\ {' '.join(parts)}"
        case "Prefix":
            return f"{_LEAN_LATEX.get(op, op)}{{{''.join(parts)}}}"
        case "Group":
            a, b = _LEAN_GROUPS.get(node.attrs["open"], (node.attrs["open"], ""))
            return f"{a} {{{' '.join(parts)}}} {b}"
        case "Application" | "Declaration":
            return r"\ ".join(([rf"\text{{{node.text}}}"] if node.kind == "Declaration" else []) + parts)
        case "Document":
            return "\n".join(parts)
    return re.sub(r"([_#$%&])", r"\\\1", node.text)


@row_udf(NODES)
def latex_nodes(text):
    return flatten(parse_latex(text))


@row_udf(NODES)
def lean_nodes(text):
    return flatten(parse_lean(text))


@row_udf("string")
def lean_latex(text):
    return lean_to_latex(parse_lean(text))
