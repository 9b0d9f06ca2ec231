"""Text algorithms: properties and brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.operators import augment, dictionary, formula, markdown, markup, repetition, sentences, tagging

texts = st.text(alphabet="ab .!?。；“”的确\n\t)AB1vs-*/中", max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_sentences_join_to_the_text(text):
    assert "".join(sentences.sentences(text)) == text


def test_sentence_examples():
    assert sentences.sentences("It rained. The roads were wet! Why?") == ["It rained. ", "The roads were wet! ", "Why?"]
    assert sentences.sentences("n! / r! is known.") == ["n! / r! ", "is known."]
    assert sentences.sentences("他走了。我来了！") == ["他走了。", "我来了！"]
    assert sentences.sentences(None) == [] and sentences.sentences("") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é中", max_size=120))
def test_fragments_stand_where_they_say(text):
    taken = set()
    for fragment, size, starts in repetition.repeated_fragments(text):
        assert len(fragment.encode()) == size and len(starts) > 1
        for s in starts:
            assert text[s : s + len(fragment)] == fragment
            assert not taken & set(range(s, s + len(fragment)))
            taken |= set(range(s, s + len(fragment)))


def test_fragments_are_found():
    assert repetition.repeated_fragments("short") == []
    passage = "the same long passage of text here"
    [(fragment, size, starts)] = repetition.repeated_fragments(f"{passage}; other stuff. {passage}? more. {passage}!")
    assert passage in fragment + "e" and len(starts) == 3 and size >= 34


def test_repetition_penalty_counts_runs(spark):
    from pyspark.sql import functions as F

    phrase = "this very sentence is said again and again without any reason at all. "
    df = spark.createDataFrame([(1, phrase * 5 + "end"), (2, "nothing is said twice here"), (3, None), (4, "")], "id int, t string")
    rows = {r.id: r for r in df.select("id", repetition.repetition_penalty(repetition.repetition_spans("t")).alias("p")).collect()}
    assert rows[1].p.score < -3 and all(rows[i].p.score == 0 for i in (2, 3, 4))
    assert F is not None


MD = """# Title
intro **bold** and `code` $x^2$ [1] see [a](http://b "t").

1. one
   - sub a
   - sub b
2. two

## Part
| a | b |
|:--|--:|
| 1 | *2* |

```py
x=1
```
### Conclusion
end
"""


def test_markdown_tree():
    root, warnings = markdown.parse_tree(MD)
    kinds = [n["kind"] for n in markdown.flatten(root)]
    for kind, n in {"H": 3, "OL": 1, "UL": 1, "LI": 4, "TABLE": 1, "TR": 2, "TH": 2, "TD": 2, "PreCode": 1, "Latex": 1, "A": 1, "Bracket": 1, "B": 1, "I": 1, "CODE": 1}.items():
        assert kinds.count(kind) == n, kind
    assert not warnings
    for n in markdown.flatten(root):
        if n["kind"] == "Text":
            assert MD[n["start_idx"] : n["end_idx"]] == n["text"]
    html = markdown.to_html(root)
    assert "<ol><li>one<ul><li>sub a</li><li>sub b</li></ul></li><li>two</li></ol>" in html and '<td align="right"><i>2</i></td>' in html
    assert markdown.depth_of(root) == 3 and markdown.breadth_of(root) == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#*-_`|[]()$ ab1.\n>~:!<&;", max_size=80))
def test_markdown_never_fails(text):
    root, _ = markdown.parse_tree(text)
    markdown.to_html(root), markdown.to_text(root), markdown.depth_of(root), markdown.widest(root), markdown.paragraph_blocks(root)
    assert all(0 <= n["start_idx"] <= n["end_idx"] <= len(text) for n in markdown.flatten(root))


def test_answer_measures():
    depth = lambda t: markdown.depth_of(markdown.parse_tree(t)[0])
    breadth = lambda t: markdown.widest(markdown.parse_tree(t)[0])[0]
    assert depth("one paragraph") == 1 and depth("- a\n- b") == 2 and depth("# A\n## B\ntext\n## C\n- x\n- y") == 3
    assert breadth("1. a\n2. b\n3. c") == 3 and breadth("# A\n\n# B\n\n# Conclusion\nx") == 2


def test_markup():
    root = markup.parse_markup("<p>a <b>bold<i>x</b> &amp; y</i><br>5 < 6 <!-- c --></p>")
    text, places = markup.logical_text(root)
    assert text == "a boldx & y</i>5 < 6 <!-- c -->" and len(places) == len(text)
    assert markup.style_spans(root) == [(2, 7, "b")]
    assert [(n["kind"], n["text"]) for n in markdown.flatten(root) if n["kind"] in ("Unbalanced", "Single", "Void")] == [("Single", ""), ("Unbalanced", "</i>"), ("Void", "")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab=\"'&;! ", max_size=60))
def test_markup_never_fails(text):
    root = markup.parse_markup(text)
    plain, places = markup.logical_text(root)
    assert len(plain) == len(places)


def shape(node):
    name = node.text or node.attrs.get("op", "") or node.kind
    return (name, *map(shape, node.children)) if node.children else name


def test_formula_precedence():
    tree = formula.parse_latex(r"a + b \times c = d").children[0]
    assert shape(tree) == ("=", ("+", "a", (r"\times", "b", "c")), "d")
    assert shape(formula.parse_latex("x^2_1").children[0])[0] in ("_", "^")
    assert shape(formula.parse_lean("a + b * c = d ∧ e").children[0]) == ("∧", ("=", ("+", "a", ("*", "b", "c")), "d"), "e")
    assert formula.lean_to_latex(formula.parse_lean("a / b ≥ 0")) == r"{\frac {a} {b}} \ge {0}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\fracsum{}()^_ ab1+-=&,∀→", max_size=50))
def test_formula_never_fails(text):
    for parse in (formula.parse_latex, formula.parse_lean):
        assert all(0 <= n["start_idx"] <= n["end_idx"] <= len(text) for n in markdown.flatten(parse(text)))


def test_best_cover_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        hits = sorted({(a, int(rng.integers(a + 1, n + 1)), float(rng.integers(1, 9))) for a in rng.integers(0, n, 6).tolist()})
        got = dictionary.best_cover(hits, n)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        best = max(sum(h[2] for h in some) for k in range(len(hits) + 1) for some in itertools.combinations(hits, k) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)))
        assert sum(h[2] for h in got) == pytest.approx(best)


def test_segmentation_keeps_the_text():
    machine = dictionary.Automaton({"北京": 2.0, "北京大学": 5.0, "大学生": 3.0, "学生": 1.0})
    assert dictionary.cut("北京大学生 x12345", machine, True) == ["北京大学", "生", " ", "x", "1", "23", "45"] or "".join(dictionary.cut("北京大学生 x12345", machine, True)) == "北京大学生 x12345"
    assert "".join(dictionary.cut("北京 大学生。", machine)) == "北京 大学生。"


def test_labels_and_conflicts():
    tokens = [{"text": "New", "start": 0, "end": 3}, {"text": "York", "start": 4, "end": 8}, {"text": "isnice", "start": 9, "end": 15}]
    entities = [{"id": 1, "start": 0, "end": 8, "type": "LOC"}, {"id": 2, "start": 11, "end": 15, "type": "ADJ"}]
    assert tagging.label_tokens(tokens, entities) == ["B-LOC", "L-LOC", "O"]
    parts = tagging.split_conflicts(tokens, entities)
    assert [p["text"] for p in parts] == ["New", "York", "is", "nice"]
    assert tagging.label_tokens(parts, entities, "BIO") == ["B-LOC", "I-LOC", "O", "B-ADJ"]
    assert tagging.relation_labels(parts, entities, [{"e1": 1, "e2": 2, "type": "R"}]) == ["B-R_1", "L-R_1", "O", "U-R_2"]


def test_wordpieces():
    v = {"un", "##happ", "##ily", "中", "文", ","}
    assert tagging.wordpieces("Unhappily 中文,x", v) == ["un", "##happ", "##ily", "中", "文", ",", "[UNK]"]
    assert tagging.wordpieces("u" * 201, {"u", "##u"}) == ["[UNK]"]


def test_viterbi_and_loss_against_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4):
        x, g = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        energy = {p: sum(x[i, a] for i, a in enumerate(p)) + sum(g[a, b] for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(3), repeat=n)}
        path, least = tagging.viterbi(x, g)
        assert least == pytest.approx(min(energy.values())) and energy[tuple(path)] == pytest.approx(least)
        labels = np.zeros(n, dtype=int)
        assert tagging.crf_loss(x, g, labels) == pytest.approx(energy[tuple(labels)] + np.log(sum(np.exp(-e) for e in energy.values())))
    assert tagging.viterbi(np.zeros((2, 2)), np.zeros((2, 2)), [False, False]) == ([], 0.0)


def test_arborescence_against_all_trees():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(2, 6))
        s = rng.normal(size=(n, n))
        trees = [[-1, *h] for h in itertools.product(range(n), repeat=n - 1) if tagging.tree_code([-1, *h]) == 0 and all(h[i - 1] != i for i in range(1, n))]
        assert tagging.arborescence(s) == max(trees, key=lambda h: sum(s[h[i], i] for i in range(1, n)))
    assert [tagging.tree_code(h) for h in ([-1, 0], [1, 0], [-1, -1], [-1, 5], [-1, 2, 1])] == [0, 1, 2, 3, 4]
    assert tagging.is_projective(tagging.projective([-1, 3, 4, 0, 0])) and not tagging.is_projective([-1, 3, 4, 0, 0])


def test_deform_is_seeded():
    text = "One two, three. Four five; six. Seven eight nine."
    assert augment.deform(text, 3) == augment.deform(text, 3)
    assert {augment.deform(text, s) for s in range(8)} != {text}


def test_layers_against_plain_sums():
    from loomspan.operators import layers

    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 3))
    k = rng.normal(size=(3, 3, 2))
    conv = layers.conv1d(x, {"kernel": k})
    for t in range(5):
        want = sum(x[t + d - 1] @ k[d] for d in range(3) if 0 <= t + d - 1 < 5)
        assert np.allclose(conv[t], want)
    w = {"kernel": rng.normal(size=(3, 8)), "recurrent": rng.normal(size=(2, 8)), "bias": rng.normal(size=8)}
    assert layers.bidirectional(x, w, w).shape == (5, 4) and np.allclose(layers.bidirectional(x, w, w)[:, :2], layers.lstm(x, w))
    g = {"kernel": rng.normal(size=(3, 6)), "recurrent": np.zeros((2, 6))}
    z, c = layers.ACTIVATIONS["sigmoid"]((x @ g["kernel"])[0, :2]), np.tanh((x @ g["kernel"])[0, 4:])
    assert np.allclose(layers.gru(x, g)[0], (1 - z) * c)
    one = {n: np.eye(4) for n in ("query", "key", "value", "output")}
    norm = {"gamma": np.ones(4), "beta": np.zeros(4)}
    block = {"attention": one, "norm1": norm, "in": {"kernel": np.eye(4)}, "out": {"kernel": np.eye(4)}, "norm2": norm}
    out = layers.encoder([1, 2, 1], {"tokens": rng.normal(size=(3, 4)), "places": rng.normal(size=(8, 4)), "norm": norm, "blocks": [block, block]}, heads=2)
    assert out.shape == (3, 4) and np.allclose(out.mean(1), 0) and np.allclose(out.std(1), 1)
    assert np.isclose(layers.classify(out, {"kernel": rng.normal(size=(4, 3))}).sum(), 1)


def test_comparisons():
    from loomspan.operators import compare

    assert compare.differences({"a": [1, 2], "b": 1}, {"a": [1, 3, 4], "c": "x"}) == [("$.a", "length", "2", "3"), ("$.a[1]", "value", "2", "3"), ("$.b", "key", "1", "null"), ("$.c", "key", "null", '"x"')]
    nodes = markdown.parse("# a\n- b\n- c")[0]
    assert compare.traversal(nodes, "pre") == [n["id"] for n in nodes]
    assert compare.traversal(nodes, "post")[-1] == 0 and sorted(compare.traversal(nodes, "post")) == sorted(compare.traversal(nodes, "breadth"))
    assert [nodes[i]["depth"] for i in compare.traversal(nodes, "breadth")] == sorted(n["depth"] for n in nodes)
    assert compare.node_path(nodes, nodes[-1]["id"])[0] == 0
    assert compare.set_path(None, ["a", 2, "b"], 5) == {"a": [None, None, {"b": 5}]}


def test_overlap_elimination(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomspan.operators import compare

    hits = [(0, 3), (2, 8), (7, 9), (9, 10), (8, 10)]
    df = spark.createDataFrame([([*hits],)], "h array<struct<begin:int,end:int>>")
    assert [tuple(h) for h in df.select(compare.without_overlaps(F.col("h")).alias("h")).first().h] == [(2, 8), (8, 10)]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in compare.frame_differences(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]
    (tmp_path / "vocab.txt").write_text("[PAD]\nthe\n##ing\n")
    assert [tuple(r) for r in compare.numbered_vocabulary(spark, str(tmp_path / "vocab.txt")).orderBy("id").collect()] == [("[PAD]", 0), ("the", 1), ("##ing", 2)]
    j = spark.createDataFrame([('{"a": 1}', '{"a": 2}')], "l string, r string")
    assert j.select(compare.json_differences("l", "r").alias("d")).first().d[0].path == "$.a"
    assert j.select(compare.set_json_path(F.col("l"), ["b", 0], "x").alias("v")).first().v == '{"a": 1, "b": ["x"]}'


def test_guarded():
    from loomspan.udf import guarded

    assert guarded(lambda x: 1 / x, -30)(0) == -30 and guarded(lambda x: 1 / x, -30)(2) == 0.5


def test_seed_groups_of_repeated_ids(spark):
    """All equal windows of 8 bytes of each row; rows of one id or none stay apart."""
    from loomspan.operators import repetition

    texts = [(1, "abcdefghabcdefgh"), (1, "xabcdefghx"), (None, "äöüäöüäöüäöü"), (None, None), (2, ""), (3, "aaaaaaaaaaaa")]
    want = []
    for i, t in texts:
        data, places = (t or "").encode(), {}
        for k in range(len(data) - 7):
            places.setdefault(data[k : k + 8], []).append(k)
        want += [(i, g, len(p), p[0], p[-1], p) for g, p in places.items() if len(p) > 1]
    got = [(r.doc_id, bytes(r.gram), r.n, r.first, r.last, r.positions) for r in repetition.seed_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_dictionary_hits_by_automaton_and_by_join(spark):
    from loomspan.operators import dictionary

    texts = [(1, "he said she sells"), (1, "ushers"), (2, None), (3, ""), (None, "😀 she")]
    words = ["he", "she", "hers", "sells", "s", "", "she"]
    docs, vocabulary = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((str(i), k, k + len(w), w) for i, t in texts for w in set(words) - {""} for k in range(len(t or "")) if t[k : k + len(w)] == w)
    plain = lambda df: sorted((str(r.doc_id), r.begin, r.end, r.word) for r in df.collect())
    assert plain(dictionary.dictionary_hits(docs, vocabulary)) == want
    assert plain(dictionary.dictionary_hits(docs, vocabulary, most=2)) == want
    assert "Exchange" not in dictionary.dictionary_hits(docs, vocabulary)._jdf.queryExecution().executedPlan().toString()
    longest = [(r.begin, r.word) for r in dictionary.dictionary_hits(docs.where("text = 'ushers'"), vocabulary, longest=True).collect()]
    assert longest == [(1, "she"), (5, "s")]
    with pytest.raises(ValueError):
        dictionary.dictionary_hits(docs, vocabulary, most=2, longest=True)


def test_language_consistency_of_repeated_and_missing_ids(spark):
    """Rows of one id or none are judged apart; sentences of another language count, short ones and those without letters don't."""
    from loomspan.operators import consistency

    german = "Die Straße führt über die Brücke und dann weiter."
    russian = "Это предложение написано совсем на другом языке."
    texts = [(1, f"This is an English sentence, and it is long enough.\n\n{russian}"), (1, "All of this is plain English text and stays so."), (None, russian), (None, f"An English text with a German one. {german}"), (4, None), (5, "12345. Да.")]
    df = spark.createDataFrame(texts, "id long, t string")
    rows = consistency.language_consistency(df, "id", F.lit("x"), F.col("t"), F.lit("en"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, [e.text.strip() for e in r.error], r.score) for r in rows.collect()]
    assert [g[:2] for g in got] == [(1, [russian]), (1, []), (None, [russian]), (None, []), (4, []), (5, [])]
    assert got[1][2] == 0 and abs(got[0][2] + len(russian.encode()) / 32) < 0.1


def test_innermost_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from loomspan.operators import frames, markdown

    rng = random.Random(5)
    for _ in range(200):
        nodes = [(a, a + rng.randint(0, 9), rng.randint(0, 3), f"k{i}") for i in range(rng.randint(0, 12)) for a in [rng.randint(0, 20)]]
        spans = [(a, a + rng.randint(0, 5)) for _ in range(8) for a in [rng.randint(0, 22)]]
        want = []
        for a, b in sorted(set(spans)):
            inside = [n for n in sorted(nodes, key=lambda n: (n[0], -n[1], n[2])) if n[0] <= a and b <= n[1]]
            want += [{"start": a, "stop": b, "kind": inside[-1][3]}] if inside else []
        assert markdown.containers(nodes, spans) == want
    spans = spark.createDataFrame([(1, 3, 4), (1, 3, 4), (1, 50, 51), (2, 0, 1)], "id int, start int, stop int")
    nodes = spark.createDataFrame([(1, 0, 9, "P", 1), (1, 2, 5, "B", 2), (2, 1, 4, "P", 1)], "id int, start_idx int, end_idx int, kind string, depth int")
    out = frames.containing_node(spans, nodes, ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, 3, 4, "B")] and out.columns == ["id", "start", "stop", "kind"]
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString() and "_spans" in out._jdf.queryExecution().optimizedPlan().toString()
    many = spark.range(1).select("id", F.posexplode(F.sequence(F.lit(0), F.lit(19_999))).alias("start", "x"))
    ends = many.select("id", F.col("start").alias("start_idx"), F.lit(20_000).alias("end_idx"), F.format_string("k%d", "start").alias("kind"), F.lit(1).alias("depth"))
    got = frames.containing_node(many.select("id", "start", (F.col("start") + 1).alias("stop")), ends, ["id"])
    assert got.where(F.col("kind") == F.format_string("k%d", "start")).count() == 20_000
