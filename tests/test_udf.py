"""Row functions hand on their results in small slices."""

import random
import tracemalloc
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from loomspan import udf
from loomspan.operators import consistency, dictionary, formula, markdown, markup, repetition, sentences


def test_results_are_handed_on_before_the_batch_ends():
    calls = []
    one = lambda t: calls.append(t) or [t] * 3
    out = udf._in_slices(one, False, pa.list_(pa.string()), iter([pa.array([str(i) for i in range(10_000)])]))
    first = next(out)
    assert len(first) == len(calls) == udf.SLICE_ROWS
    assert pa.concat_arrays([first, *out]).to_pylist() == [[str(i)] * 3 for i in range(10_000)]
    calls.clear()
    next(udf._in_slices(one, False, pa.list_(pa.string()), iter([pa.array(["x" * udf.SLICE_CHARS] * 10)])))
    assert len(calls) == 1


@pytest.mark.parametrize("run", [markup.markup_text, markup.markup_nodes, sentences.sentence_split, consistency.plain_sentences, formula.lean_nodes, formula.lean_latex, formula.latex_nodes, markdown.markdown_nodes, markdown.markdown_facts, repetition.equal_windows, repetition.repetition_spans])
def test_row_functions_run_in_slices(spark, run):
    df = spark.range(300).select("id", F.format_string("<b>a &amp; b</b> [%d] x. Y z, a + b", "id").alias("t")).coalesce(1)
    out = df.select("id", run("t").alias("v"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan
    assert [r.id for r in out.collect()] == list(range(300)) and out.where("v IS NULL").count() == 0


def peak(run, texts, kind=None, setup=False, **more):
    """Bytes that a row function holds at most in Python and NumPy over one Arrow batch of texts."""
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    try:
        assert sum(map(len, udf._in_slices(run.__wrapped__, setup, kind, iter([batch]), **more))) == len(texts)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sentences_of_a_batch_are_not_held_together():
    text = "This is a sentence of plain text. Das ist ein anderer Satz, und er ist lang. " * 8
    few, many = (peak(consistency.plain_sentences, [f"{i}. {text}" for i in range(n)]) for n in (500, 4000))
    assert many < 1.5 * few


def test_pieces_of_a_batch_are_not_held_together(spark):
    words = {"he": 1.0, "she": 1.5, "hers": 2.0, "us": 1.0}
    cut, tag = dictionary.segmenter(spark, words), dictionary.tagger(spark, {w: (dictionary.LABELS[len(w) % 6], v) for w, v in words.items()})
    for run in (cut, tag):
        few, many = (peak(run, [f"{i} ushers and she, he is hers or us " * 8 for i in range(n)], setup=True) for n in (500, 4000))
        assert many < 1.5 * few
    texts = ["ushers, she", None, "", *(f"he {i} us" for i in range(1000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    hits = dictionary.dictionary_hits(df, spark.createDataFrame([(w,) for w in words], "word string"), "id", "t")
    machine = dictionary.Automaton(words)
    assert {r.id: r.w for r in df.select("id", cut("t").alias("w")).collect()} == {i: [w for w in dictionary.cut(t or "", machine) if w.strip()] for i, t in enumerate(texts)}
    assert sorted(map(tuple, hits.collect())) == sorted((i, b, e, t[b:e]) for i, t in enumerate(texts) if t for b, e, _ in machine.hits(t))
    for out in (df.select(cut("t")), df.select(tag("t")), hits):
        assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in out._jdf.queryExecution().optimizedPlan().toString()


def test_windows_cost_no_python_objects(spark):
    """A long text's windows take tens of bytes each, and are those of a plain search."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcd efgh") for _ in range(200_000)) * 2
    windows = pa.list_(pa.struct({"gram": pa.binary(), "n": pa.int64(), "first": pa.int32(), "last": pa.int32(), "positions": pa.list_(pa.int32())}))
    assert peak(repetition.equal_windows, [text], windows, build=repetition.window_lists) < 80 * len(text)
    texts = [None, "", "a" * 7, "a" * 8, "a" * 9, "a" * 30, "äöü" * 9, "\0" * 20, "😀ab" * 5, *("".join(rng.choice("ab\0é") for _ in range(rng.randint(0, 300))) for _ in range(300))]

    def plain(t):
        data, found = (t or "").encode(), defaultdict(list)
        for i in range(len(data) - 7):
            found[data[i : i + 8]].append(i)
        return [(g, len(p), p[0], p[-1], p) for g, p in sorted(found.items()) if len(p) > 1]

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r.id: [(bytes(w.gram), w.n, w.first, w.last, w.positions) for w in r.w] for r in df.select("id", repetition.equal_windows("t").alias("w")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
