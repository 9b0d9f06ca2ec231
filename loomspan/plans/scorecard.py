"""One row of scores for every document: language, penalties, repetition, consistency, structure, style, and the reward they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import combine_reward, let
from ..functions.text import block_latex, citation_penalty, detect_language, display_width, terminal_penalty
from ..operators.consistency import SENTENCES, consistency, plain_sentences_of
from ..operators.markdown import depth_of, paragraph_blocks, parse_tree, widest
from ..operators.repetition import SPANS, repeated_fragments, repetition_penalty, spans_in
from ..udf import row_udf


@row_udf(f"depth int, breadth int, blocks array<array<string>>, n_warnings int, spans {SPANS}, sentences {SENTENCES}")
def readings(text, plain):
    """What is read off a text in Python, from one parse; plain: the text with its formulas rewritten, whose sentences are judged."""
    root, warnings = parse_tree(text)
    sentences = plain_sentences_of(root if plain == text else parse_tree(plain)[0])
    return {"depth": depth_of(root), "breadth": widest(root)[0], "blocks": paragraph_blocks(root), "n_warnings": len(warnings), "spans": spans_in(repeated_fragments(text), root), "sentences": sentences}


def least_window(blocks: Column, size: int = 5) -> Column:
    """The least average width of `size` consecutive paragraphs of a block; null if no block has as many."""

    def one(block):
        window = lambda widths, i: F.aggregate(F.slice(widths, i + 1, F.lit(size)), F.lit(0), lambda a, x: a + x)
        least = let(F.transform(block, display_width), lambda widths: F.array_min(F.transform(F.sequence(F.lit(0), F.size(block) - size), lambda i: window(widths, i))))
        return F.when(F.size(block) >= size, least / size)

    return F.array_min(F.transform(blocks, one))


def scorecard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs, without a shuffle: a text's facts, repeated spans and sentences are found once, the rest are columns of the same row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(id_col, F.col(lang_col).alias("lang"), t.alias("_t"), detect_language(t).alias("detected"))
    found = found.withColumn("r", readings("_t", block_latex(F.col("_t"))))
    wanted = F.when(F.col("detected").isNull() | (F.col("detected") == "math"), "en").otherwise(F.col("detected"))
    scored = found.select(
        id_col,
        "lang",
        "detected",
        citation_penalty("_t")["score"].alias("citation"),
        (terminal_penalty("_t", "lang") - F.col("r.n_warnings")).alias("syntax"),
        repetition_penalty(F.col("r.spans"))["score"].alias("repetition"),
        F.col("r.depth").alias("depth"),
        F.col("r.breadth").alias("breadth"),
        least_window(F.col("r.blocks")).alias("style"),
        consistency(F.col("r.sentences"), wanted)["score"].alias("consistency"),
    )
    parts = F.array(*(F.col(c).cast("double") for c in ("citation", "syntax", "repetition", "consistency")))
    return scored.withColumn("reward", combine_reward(F.lit(1.0), parts))
