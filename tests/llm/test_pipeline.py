import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest

from loomspan.llm import decontaminate, simhash, toxicity
from loomspan.llm.common import read


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for before, after in stages[:-1]:
        assert before.columns == after.columns


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_against_its_own_input(spark, sf, stages):
    before, after = stages[0]
    flagged = {r.doc_id for r in toxicity.toxicity(before, read(spark, sf, "labels")).where("toxic").collect()}
    assert ids(before) - ids(after) == flagged
    before, after = stages[1]
    groups = {}
    for r in simhash.component_rows(before).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert ids(after) == set(groups)
    before, after = stages[2]
    bench = read(spark, sf, "benchmark")
    hit = {r.doc_id for r in decontaminate.contamination_report(before, bench).where("contaminated").collect()}
    assert ids(after) == ids(before) - hit and hit
    before, after = stages[3]
    assert ids(before) == ids(after)
    for r in after.collect():
        assert r.n_chars == len(r.text)
        assert not re.search("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", r.text)


def test_run_is_the_stages_one_after_the_other(spark, sf, stages):
    plain = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert plain(corpus_pipeline.run(spark, sf)) == plain(stages[-1][1])


def test_run_against_plain_python(spark, tmp_path):
    """Copies, a null text, a null id, a benchmark passage, a secret, a text of several pieces; nobody is labelled, so nothing is toxic."""
    import public_tokenizers
    from tokenizers import Tokenizer

    passage = "seven grey ships sailed slowly past the old stone harbour wall at dawn"
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7"
    docs = [
        (2, "red apples grow on very old trees in the garden"),
        (1, "red apples grow on very old trees in the garden"),
        (None, None),
        (3, ""),
        (None, "a clock without hands tells no time to anyone here"),
        (4, f"it was told that {passage} and more"),
        (5, f"the value {secret} is in this text of some words"),
        (6, " ".join(f"w{i}x" for i in range(1500))),
    ]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, passage), (2, None), (None, "no such words at all")], "item_id long, text string")
    for name, df in (("documents", table), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    kept = [docs[1], docs[3], docs[4], (5, docs[6][1].replace(secret, "[SECRET]")), docs[7]]
    want = Counter()
    for i, t in kept:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if piece == 0 else start + 1024]
            want[(i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for name, df in (("documents", table), ("benchmark", bench)):
        df.where("false").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
