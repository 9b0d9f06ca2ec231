"""Language consistency of answers: sentences of plain text whose language isn't the wanted one.

Parsing and splitting run in Python once a text; languages and scores are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import block_latex, detect_language
from ..udf import row_udf
from .markdown import parse_tree, text_leaves
from .sentences import sentences

IGNORED = ("A", "B", "Bracket", "Latex", "CODE", "PreCode", "TABLE")
EUROPEAN = ("en", "de", "fr")
SENTENCES = "array<struct<text:string,index:int,tagName:string,scan_length:int>>"


def plain_sentences_of(root) -> list[dict]:
    out = []
    for start, kind, leaf in text_leaves(root, IGNORED):
        for s in sentences(leaf):
            out.append({"text": s, "index": start, "tagName": kind, "scan_length": len(s.encode())})
            start += len(s)
    return out


@row_udf(SENTENCES)
def plain_sentences(text):
    return plain_sentences_of(parse_tree(text)[0])


def target_language(text: Column) -> Column:
    found = detect_language(text)
    return F.when(found.isNull() | (found == "math"), "en").otherwise(found)


def consistency(sentences: Column, wanted: Column, least: int = 32) -> Column:
    """struct(score, error): the sentences that are gibberish or of another language (en, de and fr count as one), and their bytes over `least`, negative.

    Computed within the row, so rows of equal or null id are judged apart.
    """

    european = wanted.isin(*EUROPEAN)

    def differs(found):
        return F.coalesce((found != wanted) & (found != "math") & ~(european & found.isin(*EUROPEAN)), F.lit(False))

    def bad(s):
        return s["text"].contains("\ufffd") | ((s["scan_length"] >= least) & s["text"].rlike(r"[\p{L}\p{N}_]") & let(detect_language(s["text"]), differs))

    def result(hits):
        total = F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["scan_length"])
        return F.struct((-total / least).alias("score"), hits.alias("error"))

    return let(F.filter(sentences, bad), result)


def language_consistency(df: DataFrame, id_col: str, text: Column, answer: Column, lang: Column | None = None, least: int = 32) -> DataFrame:
    """id, lang, score, error of every row: see consistency. A null answer has no sentences."""
    wanted = F.lower(lang) if lang is not None else target_language(text)
    rows = df.select(F.col(id_col), wanted.alias("lang"), plain_sentences(block_latex(F.coalesce(answer, F.lit("")))).alias("sentences"))
    return rows.select(id_col, "lang", consistency(F.col("sentences"), F.col("lang"), least).alias("c")).select(id_col, "lang", "c.score", "c.error")
