"""Inference of small networks from given weights: one row's sequence in, its scores out. Weights are a table the caller brings; none are included."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from ..udf import arrow_udf

ACTIVATIONS = {
    "linear": lambda x: x,
    "relu": lambda x: np.maximum(x, 0),
    "gelu": lambda x: 0.5 * x * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2))),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "hard_sigmoid": lambda x: np.clip(0.2 * x + 0.5, 0, 1),
    "tanh": np.tanh,
    "softmax": lambda x: np.exp(x - x.max(-1, keepdims=True)) / np.exp(x - x.max(-1, keepdims=True)).sum(-1, keepdims=True),
}


def embedding(ids, w):
    return w["table"][np.asarray(ids, dtype=int)]


def dense(x, w, activation="linear"):
    return ACTIVATIONS[activation](x @ w["kernel"] + w.get("bias", 0))


def conv1d(x, w, activation="linear"):
    """Same padding; kernel: width x in x out."""
    width = len(w["kernel"])
    padded = np.pad(x, ((width // 2, width - 1 - width // 2), (0, 0)))
    return ACTIVATIONS[activation](sum(padded[k : k + len(x)] @ w["kernel"][k] for k in range(width)) + w.get("bias", 0))


def lstm(x, w):
    """Gates in the order input, forget, cell, output; all states."""
    n = w["recurrent"].shape[0]
    h, c, out = np.zeros(n), np.zeros(n), []
    for row in x @ w["kernel"] + w.get("bias", 0):
        i, f, g, o = np.split(row + h @ w["recurrent"], 4)
        c = ACTIVATIONS["sigmoid"](f) * c + ACTIVATIONS["sigmoid"](i) * np.tanh(g)
        h = ACTIVATIONS["sigmoid"](o) * np.tanh(c)
        out.append(h)
    return np.array(out).reshape(-1, n)


def gru(x, w):
    """Gates in the order update, reset, candidate; all states."""
    n = w["recurrent"].shape[0]
    h, out = np.zeros(n), []
    u = w["recurrent"]
    for row in x @ w["kernel"] + w.get("bias", 0):
        z, r = (ACTIVATIONS["sigmoid"](row[k * n : (k + 1) * n] + h @ u[:, k * n : (k + 1) * n]) for k in range(2))
        candidate = np.tanh(row[2 * n :] + (r * h) @ u[:, 2 * n :])
        h = z * h + (1 - z) * candidate
        out.append(h)
    return np.array(out).reshape(-1, n)


def bidirectional(x, forward, backward, cell=lstm):
    return np.concatenate([cell(x, forward), cell(x[::-1], backward)[::-1]], axis=1)


def bilinear(x, y, w):
    """Scores of all pairs: x W y + x u + y v + b."""
    out = x @ w["kernel"] @ y.T
    out = out + (x @ w["left"])[:, None] if "left" in w else out
    out = out + (y @ w["right"])[None] if "right" in w else out
    return out + w.get("bias", 0)


def layer_norm(x, w, eps=1e-12):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * w["gamma"] + w["beta"]


def attention(x, w, heads: int):
    q, k, v = (x @ w[n] + w.get(f"{n}_bias", 0) for n in ("query", "key", "value"))
    size = q.shape[1] // heads
    parts = []
    for h in range(heads):
        s = slice(h * size, (h + 1) * size)
        parts.append(ACTIVATIONS["softmax"](q[:, s] @ k[:, s].T / math.sqrt(size)) @ v[:, s])
    return np.concatenate(parts, axis=1) @ w["output"] + w.get("output_bias", 0)


def encoder(ids, w, heads: int, segments=None):
    """Token, place and segment embeddings, then blocks of attention and feed-forward, each with a residual and a norm. Blocks may share weights: give the same ones."""
    x = w["tokens"][np.asarray(ids, dtype=int)] + w["places"][: len(ids)]
    x = x + w["segments"][np.asarray(segments if segments is not None else [0] * len(ids), dtype=int)] if "segments" in w else x
    x = layer_norm(x, w["norm"])
    x = dense(x, w["project"]) if "project" in w else x
    for b in w["blocks"]:
        x = layer_norm(x + attention(x, b["attention"], heads), b["norm1"])
        x = layer_norm(x + dense(dense(x, b["in"], "gelu"), b["out"]), b["norm2"])
    return x


def classify(x, w):
    """Class shares from the largest value over the places."""
    return ACTIVATIONS["softmax"](dense(x.max(0), w))


def network_udf(spark, network, weights, schema: str = "array<double>"):
    """An Arrow function of an array of ids: network(ids, weights) -> vector. The weights' size is the model's, not the data's."""
    shared = spark.sparkContext.broadcast(weights)

    @arrow_udf(schema)
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.asarray(network(list(x), shared.value), dtype=float).tolist())

    return run
