"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - threshold k): all thresholds share the weights w over sparse text features, and a row of
grade k has the likelihood P(grade > k - 1) - P(grade > k). The negative logarithm of it is convex in weights and ordered
thresholds, so Newton's method with a ridge penalty finds its one minimum; a step that would let thresholds meet is
shortened. A feature is a word, or a word's beginning of 4 to 7 letters, that occurs at least once, twice or four times.
All features of the fitted sample are counted; of those whose share among the rows above grade 0 exceeds that among the
others by OrdinalConfig.least_z standard errors and which OrdinalConfig.least_documents of them hold, the OrdinalConfig.features
most significant are used. All other weights are exactly zero, so a long clean text gathers no noise.

The query's grades are the marks that `labels` has, 0 and 1, so it has one threshold. Any others can be given, severities
from 0 to n for instance; a grade that no row has gets the threshold of the next one that some row has.

Defined results: a null or empty text holds no features: its severity is that of the thresholds alone. Label rows with
a null doc_id or grade are left out; copies of a text with the same grade count once. Without grades above 0 all texts
have a severity of about 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, keyed, series_udf, shared_table
from .quality import labelled_sample

WORDS = bytes(i if 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
LEVELS = (1, 2, 4)
BEGINNINGS = (4, 5, 6, 7)


@dataclass(frozen=True)
class OrdinalConfig:
    sample: int = 8_000  # labelled rows that are fitted at most
    features: int = 400  # at most
    least_documents: int = 4
    least_z: float = 4.0
    ridge: float = 0.3
    rounds: int = 25
    reject: float = 0.5  # P(grade > 0) from which a text is rejected


def parts_of(word: bytes) -> list[str]:
    """The word, marked by a $, and its beginnings."""
    letters = word.decode()
    return [letters + "$", *(letters[:n] for n in BEGINNINGS if len(letters) >= n)]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def features_of(counts: Counter) -> list[str]:
    return [f"{part} {level}" for part, n in counts.items() for level in LEVELS if n >= level]


def all_features(text: str) -> list[str]:
    counts: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for part in parts_of(word):
            counts[part] += n
    return features_of(counts)


class _Parts(dict):
    """Of a word, the parts that a chosen feature names."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        out = self[word] = tuple(p for p in parts_of(word) if p in self.named)
        return out


class Extractor:
    def __init__(self, features):
        self.features = set(features)
        self.parts = _Parts()
        self.parts.named = {f.rpartition(" ")[0] for f in self.features}

    def __call__(self, text: str) -> list[str]:
        counts: Counter = Counter()
        for parts in filter(None, map(self.parts.__getitem__, words_of(text))):
            counts.update(parts)
        return sorted(f for f in features_of(counts) if f in self.features)


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]

    def above(self, features: list[str]) -> np.ndarray:
        """P(grade > k) for each k."""
        z = sum(self.weights[f] for f in features)
        return 1 / (1 + np.exp(-np.clip(z - np.array(self.thresholds), -40, 40)))


def likelihood_loss(x: np.ndarray, grades: np.ndarray, w: np.ndarray, t: np.ndarray) -> float:
    """The negative log-likelihood. F(u) - F(l) is F(u) (1 - F(l)) (1 - exp(l - u)), which loses no digits."""
    gap = np.diff(t)
    if (gap <= 0).any():
        return np.inf
    z, top = x @ w, len(t)
    low, high = grades > 0, grades < top
    middle = np.bincount(grades[low & high], minlength=top)[1:top]
    return float(np.logaddexp(0, z[high] - t[grades[high]]).sum() + np.logaddexp(0, t[grades[low] - 1] - z[low]).sum() - (middle * np.log(-np.expm1(-gap))).sum())


def fit(features: list[list[str]], grades: np.ndarray, config: OrdinalConfig = OrdinalConfig()) -> OrdinalModel:
    """The weights and thresholds of the largest penalised cumulative-link likelihood, by Newton steps."""
    names = sorted({f for x in features for f in x})
    levels = np.unique(np.append(grades, 0))  # grade 0 is always there
    if len(levels) < 2:
        return OrdinalModel(dict.fromkeys(names, 0.0), [40.0])
    grade, top = np.searchsorted(levels, grades), len(levels) - 1
    index = {f: i for i, f in enumerate(names)}
    m, n = len(index), len(features)
    x = np.zeros((n, m))
    for i, found in enumerate(features):
        x[i, [index[f] for f in found]] = 1
    above = np.array([(grade > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    at = np.concatenate([np.zeros(m), np.log((1 - above) / above) + 1e-3 * np.arange(top)])
    penalty = np.concatenate([np.full(m, config.ridge), np.full(top, 1e-3)])
    loss = lambda v: likelihood_loss(x, grade, v[:m], v[m:]) + (penalty * v * v).sum() / 2
    upper, lower = grade < top, grade > 0
    middle = np.bincount(grade[upper & lower], minlength=top)[1:top]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    now = loss(at)
    for _ in range(config.rounds):
        z, t = x @ at[:m], at[m:]
        a, b = np.zeros(n), np.zeros(n)
        a[upper] = sigmoid(z[upper] - t[grade[upper]])
        b[lower] = sigmoid(t[grade[lower] - 1] - z[lower])
        ha, hb, ratio = a * (1 - a), b * (1 - b), 1 / np.expm1(np.diff(t))
        at_upper, at_lower = (np.zeros((n, top)) for _ in range(2))
        at_upper[upper, grade[upper]] = 1
        at_lower[lower, grade[lower] - 1] = 1
        pull = middle * ratio
        grad = np.concatenate([x.T @ (a - b), at_lower.T @ b - at_upper.T @ a + np.append(pull, 0) - np.append(0, pull)]) + penalty * at
        hess = np.diag(penalty)
        hess[:m, :m] += x.T @ (x * (ha + hb)[:, None])
        cross = -(x.T @ (at_upper * ha[:, None] + at_lower * hb[:, None]))
        hess[:m, m:] += cross
        hess[m:, :m] += cross.T
        bend = middle * ratio * (1 + ratio)
        hess[m:, m:] += np.diag(at_upper.T @ ha + at_lower.T @ hb + np.append(bend, 0) + np.append(0, bend)) - np.diag(bend, 1) - np.diag(bend, -1)
        step, size = np.linalg.solve(hess, grad), 1.0
        while (new := loss(at - size * step)) > now and size > 1e-6:
            size /= 2
        if not new < now:
            break
        at, gain, now = at - size * step, now - new, new
        if gain < 1e-9 * (1 + abs(now)):
            break
    thresholds = at[m:][np.searchsorted(levels, np.arange(levels[-1]), side="right") - 1]
    return OrdinalModel({f: float(at[i]) for f, i in index.items()}, thresholds.tolist())


def telling(counts: DataFrame, yes: int, no: int, config: OrdinalConfig = OrdinalConfig()) -> list[str]:
    """The most significant features (rows feature, yes, no): see above. Their shares are compared in the cluster, for all features."""
    both = (F.col("yes") + F.col("no") + 1) / F.lit(yes + no + 2)
    z = (F.col("yes") / F.lit(max(yes, 1)) - F.col("no") / F.lit(max(no, 1))) / F.sqrt(both * (1 - both) * F.lit(1 / max(yes, 1) + 1 / max(no, 1)))
    chosen = counts.withColumn("z", z).where((F.col("z") >= config.least_z) & (F.col("yes") >= config.least_documents))
    return [r[0] for r in chosen.orderBy(F.desc("z"), "feature").select("feature").limit(config.features).collect()]


def fit_on(docs: DataFrame, grades: DataFrame, config: OrdinalConfig = OrdinalConfig(), grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fitted on a bounded sample of graded rows: features are counted and chosen first, and only chosen ones leave the executors."""
    rows = shared_table(labelled_sample(docs, grades, grade_col, config.sample, None, id_col, text_col).dropDuplicates([TEXT, "label"]))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    yes, no = sum(n for y, n in sizes.items() if y > 0), sum(n for y, n in sizes.items() if y <= 0)

    def count(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for frame in batches:
            for text, label in zip(frame[TEXT], frame["label"], strict=True):
                seen[label > 0].update(all_features(text))
        for side, found in enumerate(seen):
            yield pd.DataFrame({"feature": list(found.keys()), "side": side, "n": list(found.values())})

    on = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    counted = rows.select(TEXT, "label").mapInPandas(count, "feature string, side int, n long").groupBy("feature").agg(on(1).alias("yes"), on(0).alias("no"))
    chosen = telling(counted, yes, no, config) if yes and no else []

    def extract(batches):
        find = Extractor(chosen)
        for frame in batches:
            yield pd.DataFrame({"found": [find(t) for t in frame[TEXT]], "label": frame["label"]})

    found = sorted((tuple(r[0]), r[1]) for r in rows.select(TEXT, "label").mapInPandas(extract, "found array<string>, label int").limit(config.sample).toPandas().itertuples(index=False))
    return fit([list(f) for f, _ in found], np.array([max(0, y) for _, y in found], dtype=np.int64), config)


def severity_udf(model: OrdinalModel):
    def run(batches):
        find = Extractor(model.weights)
        for texts in batches:
            p = np.array([model.above(find(t or "")) for t in texts]).reshape(len(texts), -1)
            yield pd.DataFrame({"severity": p.sum(1), "toxic": p[:, 0] if p.size else 0.0})

    return series_udf(run, "severity double, toxic double")


def toxicity(docs: DataFrame, labels: DataFrame, config: OrdinalConfig = OrdinalConfig(), id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic") -> DataFrame:
    """doc_id, expected_severity (sum over k of P(grade > k)), p_toxic, toxic (p_toxic from the config's bound on) of every row."""
    model = fit_on(docs, labels, config, grade_col, id_col, text_col)
    rows = keyed(docs, id_col, text_col).select(F.col(ID).alias("doc_id"), severity_udf(model)(TEXT).alias("s"))
    return rows.select("doc_id", F.col("s.severity").alias("expected_severity"), F.col("s.toxic").alias("p_toxic"), (F.col("s.toxic") >= config.reject).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, config: OrdinalConfig = OrdinalConfig(), id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic") -> DataFrame:
    """docs without the rows that the model rejects; columns are kept."""
    model = fit_on(docs, labels, config, grade_col, id_col, text_col)
    return docs.where(severity_udf(model)(F.col(text_col))["toxic"] < config.reject)
