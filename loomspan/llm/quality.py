"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The pairwise term is computed in time linear in the features by half the difference of the squared sum and the sum of
squares of each factor. It is fitted by Adagrad on a bounded sample of labelled rows (FmConfig.sample, the rows with the
smallest hash of doc_id) and scores every whole text where it lies, without a shuffle.

Statistics are cut into quantile bins of the sample; each bin is a feature, so the machine can bend and combine them.

Defined results: a null or empty text is scored from its statistics, all zero. Label rows with a null doc_id or label are
left out; repeated ones count each. Without labels of both kinds every text gets the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, Shared, keyed, remainder, series_udf, worker_cache


@dataclass(frozen=True)
class FmConfig:
    hashed: int = 1 << 16
    bins: int = 16
    rank: int = 8
    sample: int = 10_000  # labelled rows that are fitted at most
    epochs: int = 6
    batch: int = 64
    rate: float = 0.05
    decay: float = 2e-4
    words_weight: float = 0.5  # length of the vector of word features, beside the statistics' ones
    seed: int = 11


STATS = 14
_KIND = bytes(ord("l") if 97 <= i <= 122 or i >= 128 else ord("u") if 65 <= i <= 90 else ord("d") if 48 <= i <= 57 else ord("s") if i in (32, 9, 10, 11, 12, 13) else ord("p") for i in range(256))


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, size, lines = len(words), len(text), text.split(b"\n")
    kinds = text.translate(_KIND)
    share = lambda x: x / max(1, size)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(text.count(x) for x in (b".", b"?", b"!"))
    marks = sum(text.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"{", b"}"))
    return [np.log1p(n), size / max(1, n), share(kinds.count(b"u")), share(kinds.count(b"d")), share(kinds.count(b"p")), share(marks), text.count(b"!") / max(1, n), text.count(b"|") / max(1, n), distinct / max(1, n), same / max(1, n - 1), ends / max(1, n), n / len(lines), len(set(lines)) / len(lines), np.log1p(len(lines))]


def _hash_memo(hashed: int) -> dict:
    cache = worker_cache()
    if ("fm", hashed) not in cache:

        class Memo(dict):
            def __missing__(self, word):
                if len(self) > 300_000:
                    self.clear()
                out = self[word] = crc32(word) % hashed
                return out

        cache["fm", hashed] = Memo()
    return cache["fm", hashed]


def raw_features(text: bytes, hashed: int) -> tuple[np.ndarray, list[float]]:
    words = text.lower().split()
    seen = set(words)
    return np.fromiter(set(map(_hash_memo(hashed).__getitem__, seen)), dtype=np.int32), statistics(text, words, len(seen))


@dataclass
class FactorisationMachine:
    config: FmConfig
    edges: np.ndarray  # statistics x (bins - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def features(self, raw):
        """Indices, values and starts of the rows' features: hashed words first, then a bin of each statistic."""
        c = self.config
        stats = np.array([s for _, s in raw])
        binned = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") + c.hashed + k * c.bins for k in range(STATS)], axis=1)
        index = np.concatenate([np.concatenate([w, b]) for (w, _), b in zip(raw, binned, strict=True)]).astype(np.int64)
        sizes = np.array([len(w) for w, _ in raw])
        value = np.concatenate([np.concatenate([np.full(n, c.words_weight / np.sqrt(max(n, 1))), np.ones(STATS)]) for n in sizes])
        total = sizes + STATS
        return index, value, np.cumsum(total) - total

    def margin(self, index, value, starts):
        v = self.factors[index] * value[:, None]
        s = np.add.reduceat(v, starts)
        squares = np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * (s * s - squares).sum(1), s

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        at, raw, total = 0, [], 0
        for i, text in enumerate(texts):
            raw.append(raw_features(text, self.config.hashed))
            total += len(raw[-1][0])
            if total > 200_000 or i == len(texts) - 1:
                out[at : i + 1] = self.margin(*self.features(raw))[0]
                at, raw, total = i + 1, [], 0
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(raw: list, labels: np.ndarray, config: FmConfig = FmConfig()) -> FactorisationMachine:
    size = config.hashed + STATS * config.bins
    stats = np.array([s for _, s in raw]).reshape(-1, STATS)
    edges = np.quantile(stats, np.arange(1, config.bins) / config.bins, axis=0).T if len(raw) else np.zeros((STATS, config.bins - 1))
    rng = np.random.default_rng(config.seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
    fm = FactorisationMachine(config, edges, float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, config.rank)))
    if len(set(labels.tolist())) < 2:
        return fm
    fm.factors = rng.normal(0, 0.05, (size, config.rank))
    sums, sums_v, sum_b = np.full(size, 1e-2), np.full((size, config.rank), 1e-2), 1e-2
    for _ in range(config.epochs):
        order = rng.permutation(len(raw))
        for s in range(0, len(order), config.batch):
            rows = order[s : s + config.batch]
            index, value, starts = fm.features([raw[i] for i in rows])
            z, factor_sums = fm.margin(index, value, starts)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(index))))
            gv = g[owner] * value
            used, where = np.unique(index, return_inverse=True)
            grad = np.bincount(where, weights=gv, minlength=len(used)) + config.decay * fm.linear[used]
            pull = gv[:, None] * (factor_sums[owner] - fm.factors[index] * value[:, None])
            grad_v = np.stack([np.bincount(where, weights=pull[:, k], minlength=len(used)) for k in range(config.rank)], axis=1) + config.decay * fm.factors[used]
            sums[used] += grad**2
            sums_v[used] += grad_v**2
            sum_b += g.sum() ** 2
            fm.linear[used] -= config.rate * grad / np.sqrt(sums[used])
            fm.factors[used] -= config.rate * grad_v / np.sqrt(sums_v[used])
            fm.bias -= config.rate * g.sum() / np.sqrt(sum_b)
    return fm


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, size: int, condition=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __text, label): labelled rows chosen by the hash of doc_id, at most size; only their ids are sent to the texts."""
    chosen = labels.select(F.col(id_col).cast("long").alias(ID), F.col(label_col).cast("int").alias("label")).where(F.col(ID).isNotNull() & F.col("label").isNotNull())
    if condition is not None:
        chosen = chosen.where(condition)
    share = min(1.0, 0.95 * size / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64(ID), F.lit(1 << 30)) <= int(share * (1 << 30)))
    chosen = chosen.orderBy(F.xxhash64(ID), "label").limit(size)
    return keyed(docs, id_col, text_col).join(F.broadcast(chosen), ID).select(ID, TEXT, "label")


def fit_on(docs: DataFrame, labels: DataFrame, config: FmConfig = FmConfig(), label_col: str = "quality", condition=None) -> FactorisationMachine:
    def extract(batches):
        for frame in batches:
            raw = [raw_features(t.encode(), config.hashed) for t in frame[TEXT]]
            yield pd.DataFrame({"id": frame[ID], "words": [w.tobytes() for w, _ in raw], "stats": [s for _, s in raw], "label": frame["label"]})

    rows = labelled_sample(docs, labels, label_col, config.sample, condition).mapInPandas(extract, "id long, words binary, stats array<double>, label int").limit(config.sample)
    found = sorted(((r[0], bytes(r[1]), list(r[2]), r[3]) for r in rows.toPandas().itertuples(index=False)), key=lambda r: (r[0], r[3], r[1]))
    return fit([(np.frombuffer(w, dtype=np.int32), s) for _, w, s, _ in found], np.array([y for *_, y in found], dtype=float), config)


def quality_scores(docs: DataFrame, labels: DataFrame, config: FmConfig = FmConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows whose crc32(doc_id) mod 3 is 1 are never learned from."""
    model = Shared(docs.sparkSession, fit_on(docs, labels, config, condition=remainder(ID, 3) != 1))

    def run(batches):
        machine = model.value
        for texts in batches:
            yield pd.Series(machine.scores([t.encode() for t in texts]))

    score = series_udf(run, "double")
    rows = keyed(docs, id_col, text_col)
    return rows.select(F.col(ID).alias("doc_id"), (remainder(ID, 3) == 1).alias("held_out"), score(TEXT).alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
