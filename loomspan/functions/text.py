"""Text functions that stay in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..udf import arrow_udf, worker_cache

HAN = r"\p{IsHan}"
CITATION = r"\[[0-9]+\]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detect_language(text) -> Column:
    """jp, cn, fr, de, ar, kr, math, ru or en by the first script or letter that decides; null if none does, or for Latin mixed with single Han."""
    t = _c(text)
    equation = r"^\s*(.*) = (.*)\s*$"
    side = lambda i: F.regexp_extract(t, equation, i).rlike("[^*/+-]")
    return (
        F.when(t.rlike(r"\p{IsHiragana}"), "jp")
        .when(F.when(F.length(t) <= 2, t.rlike(HAN)).otherwise(t.rlike(HAN + "{2,}")), "cn")
        .when(t.rlike("[éèàùçœæ]"), "fr")
        .when(t.rlike("[äöüß]"), "de")
        .when(t.rlike(r"\p{IsArabic}"), "ar")
        .when(t.rlike(r"\p{IsHangul}"), "kr")
        .when(t.contains(" = ") & t.rlike(equation) & side(1) & side(2), "math")
        .when(t.rlike(r"^\s*.* [≤≥] .*\s*$"), "math")
        .when(t.rlike("[А-Яа-яҐґІіЇїЄє]"), "ru")
        .when(t.rlike("[a-zA-Z]") & ~t.rlike(HAN), "en")
    )


def _votes() -> np.ndarray:
    """For each code point its votes for cn and for en: Han letters 8 and 0, wide digits and punctuation 2 and 0, other letters, digits and punctuation 0 and 1."""
    cache = worker_cache()
    if "votes" not in cache:
        table = np.zeros((sys.maxunicode + 1, 2))
        han = regex.compile(r"\p{Han}")
        for n in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(n))[0]
            if kind == "L":
                table[n] = (8, 0) if n > 0x2E00 and han.match(chr(n)) else (0, 1)
            elif kind in "NP":
                table[n] = (2, 0) if n > 256 else (0, 1)
        cache["votes"] = table
    return cache["votes"]


@arrow_udf("string")
def detect_language_weighted(texts: pd.Series) -> pd.Series:
    """cn or en: characters vote with the square of their distance from the middle; two Han characters at the start decide."""
    table, start = _votes(), regex.compile(r"\p{Han}{2,}")

    def one(text):
        if text is None:
            return None
        if start.match(text):
            return "cn"
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        middle = len(points) / 2
        votes = (((np.arange(len(points)) - middle + 0.01) / middle) ** 2) @ table[points] if middle else (0, 0)
        return "cn" if votes[0] > votes[1] else "en"

    return texts.map(one)


def citation_penalty(answer, n_context=None, most: int = 5) -> Column:
    """struct(score, error): a point for each citation over `most` in a run, each index above n_context, each citation with commas and each improper heading of references."""
    t = _c(answer)
    runs = F.regexp_extract_all(t, F.lit(rf"(?:{CITATION}[,，、]? *)+"), F.lit(0))
    indices = lambda run: F.regexp_extract_all(run, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    over = lambda run: F.greatest(F.lit(0), F.size(indices(run)) - most)
    context = None if n_context is None else (F.lit(n_context) if isinstance(n_context, int) else _c(n_context))
    outside = lambda run: F.filter(indices(run), lambda i: i.cast("decimal(38,0)") > context)
    messages = lambda run: F.when(over(run) > 0, F.array(F.concat(run, F.lit(f" exceeds {most} consecutive citations")))).otherwise(F.array().cast("array<string>"))
    commas = F.regexp_extract_all(t, F.lit(r"\[[0-9]+(?:, *[0-9]+)+\]"), F.lit(0))
    prefix = r"(?:(?:\*\*)?(?:\d+\. *)?| *\* +| +- *| *\* +)"
    headings = F.regexp_extract_all(t, F.lit(rf"\n{prefix}(?:\*\*)?参考文献(?:\*\*)?：|（未找到参考文献）|\n#+ 参考文献"), F.lit(0))
    points = F.aggregate(F.transform(runs, over), F.lit(0), lambda a, x: a + x) + F.size(commas) + F.size(headings)
    errors = F.flatten(F.transform(runs, messages))
    if context is not None:
        points = points + F.aggregate(F.transform(runs, lambda r: F.size(outside(r))), F.lit(0), lambda a, x: a + x)
        errors = F.flatten(F.transform(runs, lambda r: F.concat(messages(r), F.transform(outside(r), lambda i: F.concat(F.lit("out of range at "), r, F.lit(", index "), i, F.lit(" > "), context.cast("string"))))))
    errors = F.concat(errors, F.transform(commas, lambda m: F.concat(F.lit("comma separated citation: "), m)), F.transform(headings, lambda m: F.concat(F.lit("improper citation: "), m)))
    return F.struct((-points).alias("score"), errors.alias("error"))


def terminal_penalty(answer, lang) -> Column:
    """0 if the answer ends with a full stop of its language (line ends may follow), else -1."""
    t, la = _c(answer), _c(lang)
    return F.when(F.when(la == "cn", t.rlike(r"[。！？]\n*\z")).otherwise(t.rlike(r"[.!?]\n*\z")), 0).otherwise(-1)


def block_latex(text) -> Column:
    """$$x$$ to \\[x\\]."""
    return F.regexp_replace(_c(text), r"(?s)[$]{2}(.+?)[$]{2}", r"\\[$1\\]")


def normalize_n(word) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(word), "\n", r"\\n")))


def normalize_d(word) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_c(word), "\n", r"\\n"), "[0-9]", r"\\d")))


def markdown_rewrites(text) -> Column:
    """The five rewrites before answers are rendered."""
    t = F.replace(_c(text), F.lit("\n- "), F.lit("\n   - "))
    t = F.regexp_replace(t, rf"(?<=:|：|[*]{{2}})\n+(?={HAN}|[A-Za-z])", " ")
    t = F.regexp_replace(t, r"[*]{2}([0-9]+[.] )([^*]+)[*]{2}", r"$1**$2**")
    t = F.regexp_replace(t, r"(?<=\n)[(]([0-9]+)[)] ", "   $1. ")
    return F.regexp_replace(t, r"(?<=\n {1,2})([0-9]+)[.] ", "   $1. ")


def en_tokens(text) -> Column:
    """Words, digits and runs of one punctuation mark; white space stays on the token before it."""
    return F.regexp_extract_all(_c(text), F.lit(r"(?:[0-9]+|[A-Za-z_À-ɏ]+|([^\w\sÀ-ɏ])\1*)\s*"), F.lit(0))


def balanced_pattern(left: str, right: str, depth: int = 16) -> str:
    """A pattern of groups of brackets nested up to depth."""
    a, b = re.escape(left), re.escape(right)
    plain = f"[^{a}{b}]"
    inner = f"{plain}*"
    for _ in range(depth - 1):
        inner = f"{plain}*(?:{a}{inner}{b}{plain}*)*"
    return f"{a}{inner}{b}"


PAIRS = ("()", "[]", "{}", "<>", "（）", "【】", "《》", "「」", "『』", "〈〉", "〔〕", "［］", "｛｝", "“”", "‘’", "«»", "⟨⟩", "⌈⌉", "⌊⌋", "〖〗")


def balanced_groups(text, pair: str, depth: int = 16) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(balanced_pattern(pair[0], pair[1], depth)), F.lit(0))


def not_any(*words: str) -> str:
    """A pattern of text in which none of the words stands."""
    return f"(?:(?!{'|'.join(map(re.escape, words))})[\\s\\S])*"


def remove_capture(pattern: str) -> str:
    """The pattern with its capturing groups made plain ones."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\((?!\?)", r"\1(?:", pattern)


def outside_brackets(left: str, right: str) -> str:
    """A lookahead for places outside any pair of brackets."""
    a, b = re.escape(left), re.escape(right)
    return f"(?=(?:[^{a}{b}]*{a}[^{a}{b}]*{b})*[^{a}{b}]*$)"


def inside_brackets(left: str, right: str) -> str:
    a, b = re.escape(left), re.escape(right)
    return f"(?=[^{a}{b}]*{b})"


def find_substring(text, needle, stop=None) -> Column:
    """First index (from 0) of needle in the first `stop` characters, or -1."""
    t = _c(text) if stop is None else F.substring(_c(text), F.lit(1), F.lit(stop))
    return F.instr(t, needle if isinstance(needle, str) else _c(needle)) - 1


def toggle_case(text) -> Column:
    """The first letter in the other case."""
    t = _c(text)
    first = F.substring(t, 1, 1)
    return F.concat(F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first)), F.substring(t, F.lit(2), F.length(t)))


def split_filename(path) -> Column:
    """struct(stem, extension); the extension without its dot, empty if there is none."""
    p = _c(path)
    return F.struct(F.regexp_replace(p, r"\.[^./]*$", "").alias("stem"), F.regexp_extract(p, r"\.([^./]*)$", 1).alias("extension"))


GREEK = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), "αβγδεζηθικλμνξοπρστυφχψω", strict=True))


def greek_letter(name) -> Column:
    names = F.create_map(*(F.lit(x) for kv in (GREEK | {k.capitalize(): v.upper() for k, v in GREEK.items()}).items() for x in kv))
    return names[_c(name)]


WIDE = "ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦"


def display_width(text) -> Column:
    """Characters, wide ones twice."""
    t = _c(text)
    return F.length(t) + F.length(F.regexp_replace(t, f"[^{WIDE}]", ""))


ORDINALS = "零一二三四五六七八九十"


def ordinal(sign) -> Column:
    """The number that a circled, full-width or Chinese digit stands for, else null."""
    pairs = {c: i for i, c in enumerate(ORDINALS)} | {chr(0x2460 + i): i + 1 for i in range(20)} | {chr(0xFF10 + i): i for i in range(10)} | {str(i): i for i in range(10)}
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[_c(sign)]


def translate_table(text, table: dict[str, str]) -> Column:
    """One-to-one character conversion, such as between traditional and simplified Chinese, by a table that the caller gives."""
    return F.translate(_c(text), "".join(table), "".join(table.values()))


def unix_lines(text) -> Column:
    return F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))


def tag_escape(name) -> Column:
    """An identifier as the text of a LaTeX tag."""
    return F.regexp_replace(_c(name), r"([_#$%&{}])", r"\\$1")


def sse_data(line) -> Column:
    """The payload of a server-sent event line, null for other lines."""
    found = F.regexp_extract(_c(line), r"^data: ?([\s\S]*)$", 1)
    return F.when(_c(line).startswith("data:"), found)


def segmentation_to_original(text) -> Column:
    """Words separated by blanks, joined where neither neighbour is a Latin letter or digit."""
    return F.regexp_replace(_c(text), r"(?<![A-Za-z0-9]) +| +(?![A-Za-z0-9])", "")


def is_english(word) -> Column:
    return _c(word).rlike(r"^[A-Za-z]+$")


def utf16_units(text) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")
