import numpy as np
import pytest

from loomspan.llm import ann

SMALL = ann.AnnConfig(neighbours=5, list_size=16, chunk=8, sample=400)


def brute(rows, every, k):
    """(query, rank, vec_id, score) by plain search over the valid rows."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 6]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-float((v * w).sum()), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=6)]) for i in range(400)]
    hot = rows[40][1]
    rows += [(1000 + i, hot) for i in range(150)]  # one vector many times over
    rows += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 6), (2005, [1.0] * 3), (None, [1.0] * 6), (2020, [float("inf")] * 6)]
    return rows


def test_recall_ties_and_copies(spark, vectors):
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, list string").repartition(5)
    got = {}
    for r in ann.nearest(df, 20, SMALL).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(vectors, 20, 5)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = [got[q][k] for k in sorted(got[q])]
        assert sorted(got[q]) == list(range(1, len(near) + 1)) and q not in [v for v, _ in mine]
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in mine} & {v for v, _ in near})
        total += len(near)
    assert hits / total >= 0.9
    assert [v for v, _ in want[1000]] == [got[1000][k][0] for k in range(1, 6)]  # copies: the smallest ids, its own left out


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).collect() == []
    assert ann.nearest(spark.createDataFrame([(0, [0.0, 0.0])], schema)).collect() == []
    assert ann.nearest(spark.createDataFrame([(20, [1.0, 0.0])], schema)).collect() == []
    got = ann.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.5, -0.5])], schema)).collect()
    want = [(20, 1, 3, 0.5), (20, 2, 4, 0.5)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == want
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.5, -0.5])] * 2, schema)  # each row is a candidate
    want = [(20, 1, 3, 0.5), (20, 2, 3, 0.5), (20, 3, 4, 0.5), (20, 4, 4, 0.5)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(ann.nearest(twice).collect(), key=lambda r: r["rank"])] == want


def test_repeated_rows_and_clashing_columns(spark):
    """An id with several vectors, rows repeated more often than a query returns, a query's own repeats; other columns of any name."""
    schema = "vec_id long, embedding array<double>, asked string, rid string, v string, entry string, key string, ids string"
    rows = [(20, [1.0, 0.0])] * 9 + [(3, [0.5, 0.5])] * 7 + [(3, [0.9, 0.1])] + [(4, [0.9, 0.1])] * 2 + [(40, [0.2, 1.0]), (40, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*r, *"abcdef") for r in rows], schema).repartition(3), 20, ann.AnnConfig(neighbours=6, list_size=2, chunk=2)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    near = lambda q, v: [(k + 1, i, s) for k, (s, i) in enumerate(sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:6])]
    want = {20: near(20, [1.0, 0.0]), 40: near(40, [0.2, 1.0]) + near(40, [1.0, 0.0])}
    assert {q: sorted((k, i, -s) for k, i, s in x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_lists_are_balanced():
    """Points in few dense clusters: no list gets much more than the average of them."""
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(size=32) * 4 + rng.normal(size=(n, 32)) for n in (9000, 3000, 1000, 500, 200, 100, 50)])
    config = ann.AnnConfig()
    k = len(points) // 256
    counts = np.bincount(ann._own(points, ann.k_means(points, k, config)), minlength=k)
    assert counts.max() <= config.slack * len(points) / k + 1 and len(counts) == k


@pytest.mark.parametrize("clusters", [0, 300])
def test_recall_with_many_lists(spark, clusters):
    """40,000 vectors in 200 lists, spread evenly or in clusters, against brute force."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40_000, 32))
    if clusters:
        x = 0.4 * x + rng.normal(size=(clusters, 32))[rng.integers(0, clusters, len(x))]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    got = ann.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(8), 200, ann.AnnConfig(list_size=200)).toPandas()
    y, hits = x.astype(float), []
    for q, g in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        hits.append(len(set(np.argpartition(-s, 20)[:20]) & set(g.vec_id)) / 20)
    print("recall", clusters, np.mean(hits))
    assert len(hits) == 200 and np.mean(hits) >= 0.9


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.toPandas()
    x, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
    got = ann.nearest(df).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        near = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits.append(len(set(ids[near]) & set(g.vec_id)) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("beam", [4, 16])
def test_recall_where_lists_far_outnumber_probes(spark, beam):
    """Vectors without clusters spread their neighbours over many lists; the few probes and the narrow beam must grow with them."""
    x = np.random.default_rng(3).normal(size=(6000, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(5)
    got = ann.nearest(df, 20, ann.AnnConfig(neighbours=10, list_size=8, probes=beam, beam=beam, prune=1.05, degree=8, sample=6000, rounds=2)).toPandas()
    y = x.astype(float)
    hits = []
    for q, g in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        hits.append(len(set(np.argpartition(-s, 10)[:10]) & set(g.vec_id)) / 10)
    assert len(hits) == 300 and np.mean(hits) >= 0.9
