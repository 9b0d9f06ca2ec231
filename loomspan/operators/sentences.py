"""Sentence boundaries. The pieces of a text, joined, are the text.

A stretch runs to the marks that end it. Within a stretch full stops end sentences where what stands before looks like the
end of a phrase and what follows like the start of one. Closing quotes and brackets belong to the sentence before them.
Needs look-behind of any length, which the JVM's patterns lack.
"""

from __future__ import annotations

import regex

from ..udf import row_udf

ENDERS = ";!?；！？…。"
CLOSERS = "\")]}）】｝’”"
_LEAD = regex.compile(rf"[{ENDERS}\s]+")
_STRETCH = regex.compile(rf"[^{ENDERS}\r\n]+[{ENDERS}\s]*")
_LOW, _UP = "[a-z]", "[A-Z]"
_NAME = f"{_UP}{_LOW}+"
_WORD = f"{_UP}?{_LOW}+"
#: Before a full stop: a word and a number, a word, a name after words or an initial, a word and capitals, initials, a closing bracket.
_BEFORE = "|".join((rf"\b(?:{_LOW}+|{_UP}{_LOW}*)\s+[0-9]+", rf"\b{_LOW}+", rf"(?:(?:\b{_WORD})*| +{_UP}+[.]) +{_NAME}", rf"\b{_WORD}\s+{_UP}+", rf"\w+ +(?:{_UP}[.])+{_UP}", rf"[{ENDERS}\"'’”0-9a-zA-Z][)\]}}）】｝]"))
_NOT_BEFORE = r" vs| v|s.t|etc"
_AFTER = rf"(?:{_UP}{_LOW}*®?|{_UP}{{2,}}s?|{_UP}[0-9]+)(?:[ _-]\w+\b|,| ?[“‘\"'`(])|[“‘\"'`\d]| *\|(?:\s|$)"
_STOP = regex.compile(rf"(?<={_BEFORE})(?<!{_NOT_BEFORE})[.．]\s+(?={_AFTER})")
_TAIL_INDENT = regex.compile(r"(?<=\n)[ \t]+$")
_FACTORIAL = regex.compile(r"\b[a-z\d]! *$")
_OPERATOR = regex.compile(r" *[*-*/()]")
_CLOSED = regex.compile(r"[’”][,)\]}，）】｝》、的]")
_CLOSED_STOP = regex.compile(rf"[’”](?:[{ENDERS}.:：]|\r|\n)+")


def _join(out: list[str], line: str) -> str:
    """line as the next sentence: it takes the indentation that the last one ends with; a factorial's rest goes to the last one, and nothing is left."""
    if out:
        if m := _TAIL_INDENT.search(out[-1]):
            out[-1], line = out[-1][: m.start()], m[0] + line
        elif _FACTORIAL.search(out[-1]) and _OPERATOR.match(line):
            out[-1] += line
            return ""
    return line


def _phrases(line: str) -> list[str]:
    cuts = [0, *(m.end() for m in _STOP.finditer(line)), len(line)]
    return [line[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b or len(cuts) == 2]


def sentences(text: str | None) -> list[str]:
    text = text or ""
    lead = m[0] if (m := _LEAD.match(text)) else ""
    body, out, open_ = text[len(lead) :], [], False
    for m in _STRETCH.finditer(body):
        line = m[0]
        if line[0] not in "’”":
            if m.end() < len(body) and body[m.end()] in CLOSERS:
                if open_:
                    out[-1] += line
                else:
                    rest = _join(out, line)
                    out += [rest] if rest else []
                    open_ = True
                continue
            parts = _phrases(line)
            if open_:
                out[-1] += parts.pop(0)
                open_ = False
            if out and parts:
                parts[0] = _join(out, parts[0])
                parts = parts[1:] if not parts[0] else parts
            out += parts
            continue
        open_ = False
        if _CLOSED.match(line) and line[1:3] != "的确":
            out[-1:] = [(out[-1] if out else "") + line]
            continue
        end = 1 if _CLOSED.match(line) else (s.end() if (s := _CLOSED_STOP.match(line)) else 1)
        end += len(line[end:]) - len(line[end:].lstrip())
        out[-1:] = [(out[-1] if out else "") + line[:end]]
        out += [line[end:]] if line[end:] else []
    if lead:
        out[:1] = [lead + (out[0] if out else "")]
    return out


@row_udf("array<string>")
def sentence_split(text):
    return sentences(text)
