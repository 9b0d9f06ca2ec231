"""Functions and operators on frames, files and streams."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspan.functions import arrays, format, intervals, registry, text
from loomspan.operators import augment, frames
from loomspan.sources import catalog, files
from loomspan.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("これはテスト", "jp"), ("中文字", "cn"), ("中", "cn"), ("déjà", "fr"), ("Straße", "de"), ("سلام", "ar"), ("안녕", "kr"), ("x = y + 1", "math"), ("a ≤ b", "math"), ("привет", "ru"), ("hello", "en"), ("a中b", None), ("123", None), ("", None)])
def test_languages(spark, value, want):
    assert one(spark, text.detect_language(F.lit(value))) == want


def test_weighted_language(spark):
    assert one(spark, text.detect_language_weighted(F.lit("a中中中中中中"))) == "cn" and one(spark, text.detect_language_weighted(F.lit("plain words"))) == "en"


def test_citations(spark):
    p = one(spark, text.citation_penalty(F.lit("a [1][2][3][4][5][6][7] b [1, 2].\n## 参考文献"), 6))
    assert p.score == -(2 + 1 + 1 + 1) and len(p.error) == 4
    assert one(spark, text.citation_penalty(F.lit("clean [1].")))["score"] == 0


def test_text_functions(spark):
    for pair in text.PAIRS[:1]:
        assert one(spark, text.balanced_groups(F.lit("((1 + 2) * (3 * 4)) + (7 + 8) * [8 + 8]"), pair)) == ["((1 + 2) * (3 * 4))", "(7 + 8)"]
    assert one(spark, text.balanced_groups(F.lit("【【1】 * 【3】】 + 【7】"), "【】")) == ["【【1】 * 【3】】", "【7】"]
    assert one(spark, text.display_width(F.lit("ab中。"))) == 6
    assert one(spark, text.greek_letter(F.lit("beta"))) == "β" and one(spark, text.ordinal(F.lit("③"))) == 3 and one(spark, text.ordinal(F.lit("七"))) == 7
    assert one(spark, text.sse_data(F.lit('data: {"a": 1}'))) == '{"a": 1}' and one(spark, text.sse_data(F.lit(": ping"))) is None
    assert one(spark, text.unix_lines(F.lit("a\r\nb"))) == "a\nb"
    assert one(spark, text.en_tokens(F.lit("Hello, x12  y!!?"))) == ["Hello", ", ", "x", "12  ", "y", "!!", "?"]
    assert one(spark, text.markdown_rewrites(F.lit("**1. Name** x\n- a\n(2) b"))) == "1. **Name** x\n   - a\n   2. b"
    assert one(spark, text.translate_table(F.lit("漢字"), {"漢": "汉"})) == "汉字"
    assert text.remove_capture(r"(a)(?:b)\(c") == r"(?:a)(?:b)\(c"


def test_formats(spark):
    assert [one(spark, format.format_time(F.lit(s))) for s in (5, 65, 3665, 90061)] == ["    5s", "  1:05", "1:01:05", "1 01:01:01"]
    assert [one(spark, format.format_percent(F.lit(p))) for p in (0.01667, 0.1123, 1.0)] == ["1.667%", "11.23%", "100.0%"]
    for v in (0.0, 1.0, 12.345, 999.9, 1234.5, 1e10, 1e-5, -2.5, -1e4, 0.5, 100.0):
        assert len(one(spark, format.format_number(F.lit(v)))) == 6, v


def test_array_functions(spark):
    a = F.array(*map(F.lit, (3, 1, 2, 3)))
    assert one(spark, arrays.rindex(a, 3)) == 3 and one(spark, arrays.find_index(a, lambda x: x == 2)) == 2 and one(spark, arrays.find_index(a, lambda x: x == 9)) == -1
    assert one(spark, arrays.delete_indices(a, F.array(F.lit(0), F.lit(2)))) == [1, 3]
    assert one(spark, arrays.split_at(a, lambda x: x == 1, "int")) == [[3], [2, 3]]
    assert one(spark, arrays.splice(a, 1, 2, F.array(F.lit(9)))) == [3, 9, 3]
    assert one(spark, arrays.pad(a, 6, 0)) == [3, 1, 2, 3, 0, 0] and one(spark, arrays.pad(a, 5, 0, True)) == [0, 3, 1, 2, 3]
    assert one(spark, arrays.symmetric_sum(a, 2)) == 3 + 6 + 9 + 2 + 3 + 6 and one(spark, arrays.gcd(F.lit(84), F.lit(-36))) == 12
    assert one(spark, arrays.lexical_runs(F.array(*map(F.lit, (1, 2, 9, 10, 30))), 3)) == [[1, 2], [9, 10], [30]]
    assert one(spark, arrays.combine_reward(F.lit(1.0), F.array(F.lit(-1.0), F.lit(2.0)))) == -1.0 and one(spark, arrays.combine_reward(F.lit(1.0), F.array(F.lit(1.0)))) == 2.0


def test_interval_laws(spark):
    import random

    rng = random.Random(0)
    rows = [([(s, s + rng.randint(0, 4)) for s in rng.sample(range(20), 3)], [(s, s + rng.randint(0, 4)) for s in rng.sample(range(20), 2)]) for _ in range(60)]
    df = spark.createDataFrame(rows, f"a {intervals.KIND}, b {intervals.KIND}")
    members = lambda c: F.sort_array(intervals.members(c))
    got = df.select("a", "b", members(intervals.union("a", "b")).alias("u"), members(intervals.intersect("a", "b")).alias("i"), members(intervals.difference("a", "b")).alias("d"), members(intervals.symmetric_difference("a", "b")).alias("s"), members(intervals.fragments("a", "b")).alias("f"), intervals.contains("a", F.lit(7).cast("long")).alias("c"), members(intervals.shift("a", 5)).alias("h")).collect()
    for r in got:
        a, b = ({x for s in side for x in range(s.start, s.stop)} for side in (r.a, r.b))
        assert (r.u, r.i, r.d, r.s, r.f, r.c, r.h) == (sorted(a | b), sorted(a & b), sorted(a - b), sorted(a ^ b), sorted(a | b), 7 in a, sorted(x + 5 for x in a))


def test_rectangle_union(spark):
    r = lambda *v: intervals.rectangle(*map(F.lit, v))
    n = lambda a, b: len(one(spark, intervals.rectangle_union(a, b)))
    assert n(r(0, 2, 0, 2), r(2, 4, 0, 2)) == 1 and n(r(0, 2, 0, 2), r(2, 4, 0, 3)) == 2 and n(r(0, 9, 0, 9), r(1, 2, 1, 2)) == 1


def test_fuzzy_matches_all_pairs(spark):
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(70)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    distance = df.withColumnRenamed("word", "match").crossJoin(df).where(F.levenshtein("word", "match") <= 2).select("word", "match", F.levenshtein("word", "match").alias("distance"))
    assert sorted(map(tuple, frames.fuzzy_matches(df, df, 2).collect())) == sorted(map(tuple, distance.collect()))


def test_paging_and_sampling(spark):
    df = spark.range(23)
    assert [p.count() for p in frames.pages(df, 10, "id")] == [10, 10, 3] and [p.count() for p in frames.pages(df, 10, "id", 15)] == [10, 5]
    assert augment.sample_rows(df, 50, 1).count() == 50 and augment.sample_rows(df, 5, 1).count() == 5
    sizes = [r["count"] for r in augment.batches(df, 10, F.col("id")).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [8, 8, 7]
    assert frames.shuffled_pages(df, 10, F.col("id")).groupBy("page").count().count() == 3


def test_ranks_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    for each in (10_000, 300):
        got = [(r.v, r["rank"]) for r in frames.ranked(df, F.col("v"), rows_each=each).orderBy("v").collect()]
        assert [r for _, r in got] == list(range(5000))


def test_archives(spark, tmp_path):
    rows = [{"a": i, "b": "é"} for i in range(3)]
    lines = "\n".join(json.dumps(r) for r in rows)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one.json", json.dumps(rows))
        z.writestr("two.jsonl", lines)
        z.writestr("notes.txt", "no records")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/two.jsonl")
        info.size = len(lines.encode())
        t.addfile(info, io.BytesIO(lines.encode()))
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(lines)
    (tmp_path / "x.json").write_text(json.dumps(rows))
    (tmp_path / "x.tsv").write_text("a\tb\n0\té\n1\té\n2\té\n")
    for name, times in (("x.zip", 2), ("x.tar.gz", 1), ("x.jsonl.gz", 1), ("x.json", 1)):
        got = files.records(spark, str(tmp_path / name), "a long, b string").collect()
        assert sorted((r.a, r.b) for r in got) == sorted([(i, "é") for i in range(3)] * times), name
    assert files.records(spark, str(tmp_path / "x.tsv")).count() == 3
    assert {r.path.rpartition("/")[2] for r in files.listing(spark, str(tmp_path), ".json").collect()} == {"x.json"}


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("﻿first  \nsecond\nfirst\n")
    assert [r.value for r in files.text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["first", "second", "first"]
    lines = files.numbered_lines(spark.createDataFrame([(1, "a\nb\na")], "doc_id int, text string"))
    assert [(r.line_no, r.line) for r in files.edit_lines(lines, "doc_id", insert_at=1, new="x").orderBy("line_no").collect()] == [(0, "a"), (1, "x"), (2, "b"), (3, "a")]
    assert [r.line for r in files.edit_lines(lines, "doc_id", remove="^b$").orderBy("line_no").collect()] == ["a", "a"]


def test_tables_from_records(spark):
    df, key = catalog.table_from_records(spark, [{"x": 1, "name": "bb", "training": True, "o": {"k": 1}}, {"x": 1, "name": "a", "training": None, "o": None}])
    assert key == "name" and df.columns == ["name", "x", "o", "training"]
    df, key = catalog.table_from_records(spark, [{"x": 1.5}, {"x": 2}])
    assert key == "id" and [tuple(r) for r in df.collect()] == [(1, 1.5), (2, 2.0)]
    assert {r.column: r.kind for r in catalog.definition(df).collect()} == {"id": "tinyint", "x": "float"}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in files.upsert(old, new, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in files.upsert(old, new, "id", replace=False).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    kinds = spark.createDataFrame([("1",), ("1.5",), ("true",), ('{"a":1}',), ("x",), (None,)], "v string").select(files.infer_kind("v").alias("k")).collect()
    assert [r.k for r in kinds] == ["int", "float", "bool", "json", "str", "null"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('event: x\ndata: {"n": 1}\n\ndata: {"n": 2}\ndata: [DONE]\n')
    seen = []
    payloads = streams.event_payloads(streams.line_stream(spark, str(tmp_path / "in"))).select(F.try_variant_get("payload", "$.n", "int").alias("n"), text.detect_language("data").alias("lang"))
    streams.micro_batches(payloads, lambda rows, number: seen.extend(r.n for r in rows.collect()), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(seen) == [1, 2]


def test_registered_functions(spark):
    registry.register(spark)
    assert spark.sql("SELECT answer_depth('# A\n## B\n## C\nx') d, size(sentence_split('A b. C d, e.')) n").first().d == 2
    assert spark.sql("SELECT * FROM combinations(4, 2)").count() == 6 and spark.sql("SELECT * FROM permutations(3)").count() == 6


def plain_split(x, pivot):
    n = len(x)
    if isinstance(pivot, int):
        return x[:pivot], x[pivot:]
    if isinstance(pivot, slice):
        taken = list(range(n))[pivot]
        others = [v for i, v in enumerate(x) if i not in set(taken)]
        return (x[pivot], others) if (pivot.step or 1) > 0 else (others, x[pivot])
    places = {i % n for i in pivot if -n <= i < n} if n else set()
    return [v for i, v in enumerate(x) if i in places], [v for i, v in enumerate(x) if i not in places]


def test_splits_by_any_pivot(spark):
    from loomspan.functions import arrays

    lists = [[], [5], [1, 2, 3], [7, 7, 1, 0, 9, 4, 4]]
    pivots = [0, 2, -1, 9, -9, slice(1, 3), slice(None, -1), slice(-3, None), slice(1, None, 2), slice(None, None, -1), slice(5, 1, -2), slice(-2, None, -1), slice(None, 2, -1), [0, 2], [-1], [1, 1, 50], []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<int>")
    got = df.select("k", *(arrays.split_by_pivot("x", p).alias(f"p{i}") for i, p in enumerate(pivots))).orderBy("k").collect()
    for x, row in zip(lists, got, strict=True):
        for i, p in enumerate(pivots):
            want = plain_split(x, p)
            assert (row[f"p{i}"].hit, row[f"p{i}"].rest) == want, (x, p)
    row = df.select(arrays.split_by_pivot("x", lambda v: v > 4).alias("p")).collect()[3].p
    assert (row.hit, row.rest) == ([7, 7, 9], [1, 0, 4, 4])


def test_random_paddings_and_combinations(spark):
    from loomspan.functions import arrays

    df = spark.range(200).select(F.col("id"), F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda i: i + 1).alias("x"))
    rows = df.select("x", arrays.pad_randomly("x", 6, -1, "id").alias("p"), arrays.random_combination(F.lit(9), F.lit(4), "id").alias("c"), arrays.random_combination(F.lit(3), F.lit(5), "id").alias("all")).collect()
    for r in rows:
        assert len(r.p) == 6 and [v for v in r.p if v != -1] == r.x and r.p[-1] == r.x[-1]
        assert len(set(r.c)) == 4 and r.c == sorted(r.c, reverse=True) and set(r.c) <= set(range(9)) and r["all"] == [2, 1, 0]
    assert len({tuple(r.p) for r in rows}) == 26 and len({tuple(r.c) for r in rows}) > 50
    empty = spark.range(1).select(arrays.pad_randomly(F.array().cast("array<int>"), 3, 7, "id").alias("p"), arrays.random_combination(F.lit(0), F.lit(2), "id").alias("c")).first()
    assert empty.p == [7, 7, 7] and empty.c == []


def test_padding_of_whole_columns(spark):
    flat = spark.createDataFrame([([1],), ([1, 2, 3],), ([],)], "x array<int>")
    assert [r.x for r in frames.padded(flat, "x", 0).collect()] == [[1, 0, 0], [1, 2, 3], [0, 0, 0]]
    assert [r.x for r in frames.padded(flat, "x", 9, left=True).collect()] == [[9, 9, 1], [1, 2, 3], [9, 9, 9]]
    deep = spark.createDataFrame([([[1], [2, 3]],), ([[4]],)], "x array<array<int>>")
    assert [r.x for r in frames.padded(deep, "x", 0).collect()] == [[[1, 0], [2, 3]], [[4, 0], [0, 0]]]


def test_merged_intervals_need_no_table_of_islands(spark):
    import random

    from loomspan.operators import frames

    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), a, a + rng.randint(0, 6)) for _ in range(300) for a in [rng.randint(0, 400)]]
    want = []
    for key in (None, 1, 2):
        for a, b in sorted((a, b) for k, a, b in rows if k == key and a < b):
            if want and want[-1][0] == key and a <= want[-1][2]:
                want[-1][2] = max(want[-1][2], b)
            else:
                want.append([key, a, b])
    out = frames.merge_intervals(spark.createDataFrame(rows, "k int, start long, stop long"), ["k"], "start", "stop")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
    assert sorted(map(str, (list(r) for r in out.collect()))) == sorted(map(str, want)) and out.columns == ["k", "start", "stop"]
