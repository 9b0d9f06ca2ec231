"""Labels of tokens and entities, wordpiece tokens, Viterbi paths and dependency trees: algorithms over one row's arrays."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd

from ..udf import arrow_udf


def label_tokens(tokens: list[dict], entities: list[dict], scheme: str = "BILOU") -> list[str]:
    """A label for each token {start, end} from the entity {entity, start, end, type} that holds it."""
    out = ["O"] * len(tokens)
    for e in entities:
        held = [i for i, t in enumerate(tokens) if e["start"] <= t["start"] and t["end"] <= e["end"]]
        for k, i in enumerate(held):
            if scheme == "plain":
                out[i] = e["type"]
            elif scheme == "BIO":
                out[i] = ("B-" if k == 0 else "I-") + e["type"]
            else:
                mark = "U" if len(held) == 1 else "B" if k == 0 else "L" if k == len(held) - 1 else "I"
                out[i] = f"{mark}-{e['type']}"
    return out


def relation_labels(tokens: list[dict], entities: list[dict], relations: list[dict]) -> list[str]:
    """Entity labels whose type carries the relation and which of its arguments the entity is."""
    by_id = {e["id"]: e for e in entities}
    out = ["O"] * len(tokens)
    for r in relations:
        for n, side in (("1", "e1"), ("2", "e2")):
            e = by_id[r[side]]
            for i, label in enumerate(label_tokens(tokens, [e | {"type": f"{r['type']}_{n}"}])):
                if label != "O":
                    out[i] = label
    return out


def split_conflicts(tokens: list[dict], entities: list[dict]) -> list[dict]:
    """Tokens cut at the edges of entities inside them; parts keep the token's tag."""
    edges = sorted({e[k] for e in entities for k in ("start", "end")})
    out = []
    for t in tokens:
        cuts = [t["start"], *(x for x in edges if t["start"] < x < t["end"]), t["end"]]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append(t | {"text": t["text"][a - t["start"] : b - t["start"]], "start": a, "end": b})
    return out


def _alone(c: str) -> bool:
    n = ord(c)
    return 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0x20000 <= n <= 0x2FA1F or 0xF900 <= n <= 0xFAFF or unicodedata.category(c).startswith("P") or 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126


def wordpieces(text: str, vocabulary: set[str] | dict, lower: bool = True, longest: int = 200) -> list[str]:
    """Greedy longest pieces, ## before those inside a word; [UNK] for words without pieces or of over 200 characters."""
    spaced = "".join(f" {c} " if _alone(c) else " " if c.isspace() else "" if unicodedata.category(c) in ("Cc", "Cf") else c for c in text)
    out = []
    for word in (spaced.lower() if lower else spaced).split():
        pieces, at = [], 0
        while at < len(word) and len(word) <= longest:
            end = len(word)
            while end > at and (piece := ("##" if at else "") + word[at:end]) not in vocabulary:
                end -= 1
            if end == at:
                break
            pieces.append(piece)
            at = end
        out += pieces if at == len(word) else ["[UNK]"]
    return out


def wordpiece_udf(spark, vocabulary: list[str]):
    """An Arrow function; the vocabulary is a tokenizer's, fixed and small."""
    shared = spark.sparkContext.broadcast(set(vocabulary))

    @arrow_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wordpieces(t or "", shared.value))

    return run


def viterbi(energies, transitions, mask=None) -> tuple[list[int], float]:
    """The path of least energy over positions x labels, and its energy; mask: the positions that count."""
    x, g = np.asarray(energies, dtype=float), np.asarray(transitions, dtype=float)
    if mask is not None:
        x = x[np.asarray(mask, dtype=bool)]
    if not len(x):
        return [], 0.0
    cost, back = x[0], []
    for row in x[1:]:
        both = cost[:, None] + g
        back.append(both.argmin(0))
        cost = both.min(0) + row
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(cost.min())


def crf_loss(energies, transitions, labels) -> float:
    """Energy of the labels over the free energy of all paths."""
    x, g = np.asarray(energies, dtype=float), np.asarray(transitions, dtype=float)
    own = x[np.arange(len(x)), labels].sum() + g[labels[:-1], labels[1:]].sum()
    a = -x[0]
    for row in x[1:]:
        both = a[:, None] - g
        top = both.max(0)
        a = top + np.log(np.exp(both - top).sum(0)) - row
    top = a.max()
    return float(own + top + np.log(np.exp(a - top).sum()))


def arborescence(scores) -> list[int]:
    """Heads of the spanning arborescence of the largest score; scores[head][dependent], the root is 0 and its own head is -1."""
    s = np.array(scores, dtype=float)
    n = len(s)
    np.fill_diagonal(s, -np.inf)
    s[:, 0] = -np.inf
    if n <= 1:
        return [-1] * n
    heads = s.argmax(0)
    heads[0] = -1
    seen, cycle = {}, None
    for v in range(1, n):
        path, u = [], v
        while u > 0 and u not in seen:
            seen[u] = v
            path.append(u)
            u = int(heads[u])
        if u > 0 and seen[u] == v:
            cycle = path[path.index(u) :]
            break
    if cycle is None:
        return [int(h) for h in heads]
    inside = set(cycle)
    outside = [v for v in range(n) if v not in inside]
    new = {v: i for i, v in enumerate(outside)}
    c = len(outside)
    t = np.full((c + 1, c + 1), -np.inf)
    enter, leave = {}, {}
    total = sum(s[heads[v], v] for v in cycle)
    for u in outside:
        for v in outside:
            t[new[u], new[v]] = s[u, v]
        best = max(cycle, key=lambda v: s[u, v] - s[heads[v], v])
        t[new[u], c], enter[u] = s[u, best] - s[heads[best], best] + total, best
        src = max(cycle, key=lambda v: s[v, u])
        t[c, new[u]], leave[u] = s[src, u], src
    small = arborescence(t)
    out = [-1] * n
    for v in cycle:
        out[v] = int(heads[v])
    for v in outside:
        if v:
            h = small[new[v]]
            out[v] = leave[v] if h == c else outside[h]
    u = outside[small[c]]
    out[enter[u]] = u
    return out


def is_projective(heads: list[int]) -> bool:
    """Whether no two arcs cross."""
    arcs = [(min(h, d), max(h, d)) for d, h in enumerate(heads) if h >= 0]
    return not any(a < c < b < d for a, b in arcs for c, d in arcs)


def projective(heads: list[int]) -> list[int]:
    """Crossing arcs are lifted: a dependent moves to its head's head until no arcs cross."""
    out = list(heads)
    while not is_projective(out):
        arcs = [(d, h) for d, h in enumerate(out) if h >= 0]
        d = min((d for d, h in arcs for e, g in arcs if min(d, h) < min(e, g) < max(d, h) < max(e, g) for d in (d, e) if out[d] > 0), key=lambda d: (abs(out[d] - d), d))
        out[d] = out[out[d]]
    return out


def tree_code(heads: list[int]) -> int:
    """0 for a tree with one root; 1: no root, 2: several roots, 3: a head out of range, 4: a cycle. Root tokens have head -1."""
    roots = sum(h < 0 for h in heads)
    if any(h >= len(heads) for h in heads):
        return 3
    if roots != 1:
        return 1 if not roots else 2
    for v in range(len(heads)):
        u, steps = v, 0
        while u >= 0 and steps <= len(heads):
            u, steps = heads[u], steps + 1
        if steps > len(heads):
            return 4
    return 0


@arrow_udf("array<int>")
def arborescence_udf(matrices: pd.Series) -> pd.Series:
    return matrices.map(lambda m: arborescence([list(r) for r in m]))


@arrow_udf("path array<int>, energy double")
def viterbi_udf(energies: pd.Series, transitions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([viterbi([list(r) for r in e], [list(r) for r in t]) for e, t in zip(energies, transitions, strict=True)], columns=["path", "energy"])


@arrow_udf("array<string>")
def bilou(tokens: pd.Series, entities: pd.Series) -> pd.Series:
    return pd.Series([label_tokens(list(t), list(e)) for t, e in zip(tokens, entities, strict=True)])
