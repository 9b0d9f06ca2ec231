"""The text functions by name, for use from SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.augment import combinations_udtf, permutations_udtf


def register(spark: SparkSession) -> list[str]:
    """Registers Arrow functions and table functions; returns their names."""
    from ..operators import formula, markdown, markup, repetition, sentences

    def arrow(fn):
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(fn)

        return run

    functions = {
        "sentence_split": (arrow(sentences.sentences), "array<string>"),
        "markdown_nodes": (arrow(lambda t: markdown.parse(t)[0]), markdown.NODES),
        "markdown_html": (arrow(lambda t: markdown.to_html(markdown.parse_tree(t)[0])), "string"),
        "answer_depth": (arrow(lambda t: markdown.depth_of(markdown.parse_tree(t)[0])), "int"),
        "answer_breadth": (arrow(lambda t: markdown.widest(markdown.parse_tree(t)[0])[0]), "int"),
        "markup_nodes": (arrow(lambda t: markup.flatten(markup.parse_markup(t))), markdown.NODES),
        "latex_nodes": (arrow(lambda t: markdown.flatten(formula.parse_latex(t))), markdown.NODES),
        "lean_nodes": (arrow(lambda t: markdown.flatten(formula.parse_lean(t))), markdown.NODES),
        "repetition_spans": (arrow(repetition.repetition_spans_of), repetition.SPANS),
    }
    for name, (run, schema) in functions.items():
        spark.udf.register(name, F.pandas_udf(run, schema))
    spark.udtf.register("permutations", permutations_udtf())
    spark.udtf.register("combinations", combinations_udtf())
    return [*functions, "permutations", "combinations"]
