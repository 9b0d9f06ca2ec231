"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all lengths equal, so the nearest by distance has the largest inner product.
Centroids come from k-means on a bounded sample; then lists that are too long are halved in place of the shortest ones, until
none is much longer than the others. Centroids are searched through an in-memory neighbour graph. A vector goes to
its nearest list and, if it lies near a boundary, to further ones whose distance is within a ratio of the nearest. A
query reads the lists whose centroids are within a ratio of its nearest one. How many lists, up to which ratio and with
how wide a beam is measured in every run: the neighbours of a few queries are found by brute force, and so many lists are
read that these queries miss no more of them than the wanted recall allows; at worst that is all lists. Lists (and the queries of a list) above a
bound are cut into chunks, so every group that is searched is bounded, and all chunks are searched: nothing is left out.

Equal vectors are one entry that carries its smallest vec_ids, one more than a query returns, and how many rows have each
(counted up to what a query returns); no other of them could be in an answer. Equal queries are searched once.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or differ in size from the most
frequent size take no part. A null vec_id takes no part. Every row is a candidate, so a repeated row is listed as often as
it is there, but rows of the query's own vec_id are never in its answer. A repeated query is answered once. A vec_id with
several vectors is a query with each of them. A query with fewer candidates than wanted gets all that its lists hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, shared_table


@dataclass(frozen=True)
class AnnConfig:
    neighbours: int = 20
    list_size: int = 256  # vectors of a list on average
    most_lists: int = 16_384  # centroids kept in memory at most
    sample: int = 32_768  # vectors that k-means is fitted on at most
    slack: float = 1.5  # vectors of the sample that a list may get, in average ones
    rounds: int = 8
    degree: int = 16  # of the centroids' graph
    beam: int = 64  # at least
    replicas: int = 4
    boundary: float = 1.10  # distance ratio up to which a vector is replicated
    probes: int = 48  # lists that a query may read, at least
    prune: float = 1.35  # distance ratio up to which a query reads lists, at least
    recall: float = 0.95  # of the trial queries; what they were not asked may come out a little lower
    trial: int = 256  # queries answered by brute force at most
    chunk: int = 4096
    seed: int = 5


class Centroids:
    """Centroids with a graph of their nearest neighbours and a beam search over many vectors at once."""

    def __init__(self, points: np.ndarray, config: AnnConfig):
        self.points = points
        self.norms = (points**2).sum(1)
        k = len(points)
        degree = min(config.degree, k - 1)
        self.beam, self.degree = min(config.beam, k), degree
        self.graph = np.zeros((k, max(1, degree)), dtype=np.int64)
        for s in range(0, k, 512):
            d = self.norms[None] - 2 * points[s : s + 512] @ points.T
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            if degree:
                self.graph[s : s + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        rng = np.random.default_rng(config.seed)
        # The graph of nearest neighbours may fall apart; entries spread over it, one for every few centroids, reach its parts.
        self.entries = np.sort(rng.choice(k, size=min(k, max(self.beam, k // 32)), replace=False))

    def nearest(self, x: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) by rising distance, beam of them. A beam that would meet all centroids compares them all at once."""
        beam = beam or self.beam
        search = self._all if beam * self.degree >= len(self.points) - 1 else self._nearest
        out = [search(x[s : s + 256], beam) for s in range(0, len(x), 256)]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _all(self, x, beam):
        d = self.norms[None] - 2 * x @ self.points.T
        ids = np.argpartition(d, beam - 1, axis=1)[:, :beam]
        dist = np.take_along_axis(d, ids, axis=1)
        order = np.lexsort((ids, dist), axis=1)
        return np.take_along_axis(ids, order, axis=1), np.maximum(np.take_along_axis(dist, order, axis=1) + (x**2).sum(1)[:, None], 0)

    def _nearest(self, x, beam):
        n, size = len(x), (x**2).sum(1)
        # As many entries as the beam is wide, so that it is full from the start.
        more = np.setdiff1d(np.arange(len(self.points)), self.entries)[: max(0, beam - len(self.entries))]
        entries = np.concatenate([self.entries, more])
        d = self.norms[entries][None] - 2 * x @ self.points[entries].T
        seen = np.zeros((n, len(self.points)), dtype=bool)
        seen[:, entries] = True
        keep = np.argsort(d, axis=1, kind="stable")[:, :beam]
        ids, dist = entries[keep], np.take_along_axis(d, keep, axis=1)
        open_ = np.ones_like(ids, dtype=bool)
        rows = np.arange(n)
        while True:
            front = np.where(open_, dist, np.inf)
            step = np.argsort(front, axis=1, kind="stable")[:, :8]
            live = np.take_along_axis(open_, step, axis=1)
            if not live.any():
                break
            np.put_along_axis(open_, step, False, axis=1)
            near = self.graph[np.take_along_axis(ids, step, axis=1)].reshape(n, -1)
            fresh = ~np.take_along_axis(seen, near, axis=1) & np.repeat(live, self.graph.shape[1], axis=1)
            seen[rows[:, None], near] |= fresh
            r, c = np.nonzero(fresh)
            new = np.full(near.shape, np.inf)
            new[r, c] = self.norms[near[r, c]] - 2 * np.einsum("ij,ij->i", x[r], self.points[near[r, c]])
            order = np.argsort(near, axis=1, kind="stable")  # a centroid met twice in a step counts once
            ordered = np.take_along_axis(near, order, axis=1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
            new[twice] = np.inf
            both, far = np.concatenate([ids, near], axis=1), np.concatenate([dist, new], axis=1)
            opened = np.concatenate([open_, np.isfinite(new)], axis=1)
            keep = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, dist, open_ = (np.take_along_axis(v, keep, axis=1) for v in (both, far, opened))
        return ids, np.maximum(dist + size[:, None], 0)


def _own(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(1)
    return np.concatenate([(norms[None] - 2 * points[s : s + 1024] @ centres.T).argmin(1) for s in range(0, len(points), 1024)])


def k_means(points: np.ndarray, k: int, config: AnnConfig) -> np.ndarray:
    """Centres of plain rounds, then balanced."""
    rng = np.random.default_rng(config.seed)
    centres = points[np.sort(rng.choice(len(points), size=k, replace=False))].copy()
    for _ in range(config.rounds):
        own = _own(points, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=points[:, j], minlength=k) for j in range(points.shape[1])], axis=1)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        heavy = np.argsort(-counts, kind="stable")  # an empty list takes a point of a heavy one, for balance
        for empty, full in zip(np.flatnonzero(~filled), heavy, strict=False):
            centres[empty] = points[rng.choice(np.flatnonzero(own == full))]
    return balanced(points, centres, config)


def balanced(points: np.ndarray, centres: np.ndarray, config: AnnConfig) -> np.ndarray:
    """Centres such that plain nearest assignment gives no list more than slack times the average: a list that has more gets a
    second centre in place of one of the least needed, whose few points go to their next centres."""
    k, most = len(centres), max(2, int(np.ceil(config.slack * len(points) / max(1, len(centres)))))
    centres = centres.copy()
    for _ in range(4 * config.rounds):
        own = _own(points, centres)
        counts = np.bincount(own, minlength=k)
        full = np.flatnonzero(counts > most)
        if not len(full):
            break
        full = full[np.argsort(-counts[full], kind="stable")]
        spare = np.argsort(counts, kind="stable")[: len(full)]
        for a, b in zip(full.tolist(), spare.tolist(), strict=False):
            if counts[b] > most // 2 or a == b:
                break
            held = points[own == a]
            # Two halves by the direction in which the list is longest.
            inner = held - held.mean(0)
            axis = inner[np.argmax((inner**2).sum(1))]
            for _ in range(3):
                axis = inner.T @ (inner @ axis)
                axis /= max(np.linalg.norm(axis), 1e-300)
            side = inner @ axis > np.median(inner @ axis)
            if side.any() and not side.all():
                centres[a], centres[b] = held[~side].mean(0), held[side].mean(0)
    return centres


def _matrix(series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 1))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))[:, None]], axis=1)


def _aimed(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries among the lifted vectors: a query's length doesn't change its order, so all get the longest."""
    return np.concatenate([x * (longest / np.sqrt((x**2).sum(1)))[:, None], np.zeros((len(x), 1))], axis=1)


def _read(dist: np.ndarray, probes: int, prune: float) -> np.ndarray:
    """Which of the lists by rising distance a query reads: eight, and up to probes of them within the ratio."""
    good = dist[:, :probes] <= prune * np.maximum(dist[:, :1], 1e-9)
    good[:, :8] = True
    return good


def reach(entries: DataFrame, held: DataFrame, centroids: Centroids, longest: float, config: AnnConfig) -> tuple[int, int, float]:
    """(beam, probes, prune) with which trial queries find the wanted part of their neighbours, which brute force tells."""
    k, least = len(centroids.points), min(config.probes, len(centroids.points))
    asked = entries.where("asked").orderBy("key", "rid").limit(config.trial).select("key", "v").toPandas()
    if not len(asked):
        return centroids.beam, least, config.prune
    trial = Shared(entries.sparkSession, (_matrix(asked.v), asked.key.to_numpy()))

    def top(batches):
        x, own = trial.value
        score, key = np.full((len(x), config.neighbours), -np.inf), np.zeros((len(x), config.neighbours), dtype=np.int64)
        for frame in batches:
            if len(frame):
                keys = frame.key.to_numpy()
                product = x @ _matrix(frame.v).T
                product[own[:, None] == keys[None]] = -np.inf
                score, key = np.concatenate([score, product], axis=1), np.concatenate([key, np.broadcast_to(keys, product.shape)], axis=1)
                at = np.argpartition(-score, config.neighbours - 1, axis=1)[:, : config.neighbours]
                score, key = np.take_along_axis(score, at, axis=1), np.take_along_axis(key, at, axis=1)
        r, c = np.nonzero(np.isfinite(score))
        yield pd.DataFrame({"query": r, "key": key[r, c], "score": score[r, c]})

    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    near = entries.select("key", "v").mapInPandas(top, "query long, key long, score double").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= config.neighbours)
    met = held.select("list", "key").join(F.broadcast(near.select("query", "key")), "key").distinct().toPandas()
    if not len(met):
        return centroids.beam, least, config.prune
    beam, x, loose = max(centroids.beam, least), _aimed(_matrix(asked.v), longest), (1 + config.recall) / 2
    while True:
        ids, dist = centroids.nearest(x, beam)
        dist = np.sqrt(dist)
        place = np.full((len(x), k), k)
        np.put_along_axis(place, ids, np.arange(beam)[None], axis=1)
        first = met.assign(place=place[met["query"], met["list"]]).groupby(["query", "key"], as_index=False)["place"].min()
        q, nth = first["query"].to_numpy(), first["place"].to_numpy()
        if beam == k or (nth < beam).mean() >= loose:
            break
        beam = min(k, 2 * beam)
    ratio = np.where(nth < 8, 0.0, np.where(nth < beam, dist[q, np.minimum(nth, beam - 1)] / np.maximum(dist[q, 0], 1e-9), np.inf))
    # The ratio and the number of lists each leave out some of what is missed; 1e-9 keeps the last pair within its own ratio.
    prune = max(config.prune, float(np.sort(ratio)[int(np.ceil(loose * len(ratio))) - 1]) * (1 + 1e-9))
    kept = np.sort(np.where(ratio <= prune, nth, k))
    return beam, min(beam, max(least, int(kept[int(np.ceil(config.recall * len(kept))) - 1]) + 1)), prune


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").head(1)
    return rows.where(F.size("v") == (sizes[0][0] if sizes else 0))


def nearest(vectors: DataFrame, every: int = 20, config: AnnConfig = AnnConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id divisible by every) its nearest other rows."""
    spark, want = vectors.sparkSession, config.neighbours + 1
    rows = valid(vectors, id_col, vector_col)
    # Zeroes of either sign are equal, so that equal vectors are equal as grouping keys.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(config.neighbours)).cast("int").alias("times")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= want)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    queried = asked.select("v").distinct().withColumn("asked", F.lit(True))
    entries = shared_table(few.groupBy("v").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "times"))), lambda x: F.array_repeat(x["vec_id"], x["times"]))).alias("ids")).withColumn("rid", F.get("ids", F.lit(0))).join(queried, "v", "left").select(F.monotonically_increasing_id().alias("entry"), F.xxhash64("v").alias("key"), "rid", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    n = entries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    longest = float(np.sqrt(entries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]))
    share = min(1.0, 0.95 * config.sample / n)
    sample = entries.where(F.pmod("key", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("key", "rid").limit(config.sample).select("v").toPandas()
    points = _lifted(_matrix(sample.v), longest) if len(sample) else _lifted(_matrix(entries.limit(1).toPandas().v), longest)
    k = max(1, min(config.most_lists, n // config.list_size, len(points)))
    centroids = Centroids(k_means(points, k, config), config)
    model = Shared(spark, (centroids, longest))

    def assign(batches):
        centroids, longest = model.value
        for frame in batches:
            if len(frame):
                ids, dist = centroids.nearest(_lifted(_matrix(frame.v), longest))
                dist = np.sqrt(dist)
                take = min(config.replicas, ids.shape[1])
                good = dist[:, :take] <= config.boundary * dist[:, :1] + 1e-12
                r, c = np.nonzero(good)
                yield pd.DataFrame({"list": ids[r, c], "key": frame.key.to_numpy()[r], "entry": frame.entry.to_numpy()[r], "rid": frame.rid.to_numpy()[r], "v": frame.v.to_numpy()[r]})

    place = "list long, key long, entry long, rid long, v array<double>"
    held = shared_table(entries.select("key", "entry", "rid", "v").mapInPandas(assign, place))
    beam, probes, prune = reach(entries, held, centroids, longest, config)

    def probe(batches):
        centroids, longest = model.value
        for frame in batches:
            for s in range(0, len(frame), 1024):
                part = frame.iloc[s : s + 1024]
                ids, dist = centroids.nearest(_aimed(_matrix(part.v), longest), beam)
                good = _read(np.sqrt(dist), probes, prune)
                yield part.assign(lists=[i[g] for i, g in zip(ids[:, :probes], good, strict=True)])

    # A query is stored once with its lists, however many.
    wanted = shared_table(entries.where("asked").select("key", "entry", "v").mapInPandas(probe, "key long, entry long, v array<double>, lists array<long>"))
    wanted = wanted.select(F.explode("lists").alias("list"), "key", "entry", "v")
    chunks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / config.chunk).cast("int").alias(name))  # noqa: E731  at most most_lists rows
    cut = chunks(held, "hold").join(chunks(wanted, "ask"), "list")
    by = lambda df, own, other: df.join(F.broadcast(cut), "list").withColumn("mine", F.pmod(F.xxhash64("key", "entry"), F.col(own)).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = by(held, "hold", "ask").select("list", F.col("mine").alias("h"), F.col("theirs").alias("a"), "entry", "rid", "v")
    right = by(wanted, "ask", "hold").select("list", F.col("theirs").alias("h"), F.col("mine").alias("a"), "entry", "v")

    def search(candidates, queries):
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query": [], "entry": [], "rid": [], "score": []})
        c, q, entry, rid = _matrix(candidates.v), _matrix(queries.v), candidates.entry.to_numpy(), candidates.rid.to_numpy()
        take, out = min(want, len(rid)), []
        for s in range(0, len(q), 512):
            product = q[s : s + 512] @ c.T
            top = np.argpartition(-product, take - 1, axis=1)[:, :take]
            last = np.take_along_axis(product, top, axis=1).min(1)
            r, at = np.nonzero(product >= (last - 1e-12 * np.abs(last))[:, None])  # ties of the last stay in
            out.append(pd.DataFrame({"query": queries.entry.to_numpy()[s + r], "entry": entry[at], "rid": rid[at], "score": (q[s + r] * c[at]).sum(1)}))
        return pd.concat(out)

    met = left.groupBy("list", "h", "a").cogroup(right.groupBy("list", "h", "a")).applyInPandas(search, "query long, entry long, rid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rid", "entry")
    near = met.groupBy("query", "entry", "rid").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= want)
    full = near.join(entries.select("entry", "ids"), "entry").groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "ids")).alias("found"))
    each = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["less"].alias("less"), i.alias("vec_id")))))
    answers = full.select("query", F.array_sort(each).alias("found"))
    owners = asked.select("vec_id", "v").join(entries.where("asked").select("v", "entry"), "v").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"))
    others = owners.join(answers, "query").select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, config.neighbours).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.less")).alias("score"))
