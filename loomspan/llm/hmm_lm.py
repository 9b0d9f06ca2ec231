"""Hidden Markov language model with an open vocabulary.

A hidden state emits a word class, and the class emits the word. The most frequent words are classes of their own; any
other word is in the class that a hash of its last three bytes names. Within a class a word's probability comes from
the corpus counts, so the state tables stay bounded (states x classes) while the vocabulary may grow with the corpus.

1. One pass counts words and pairs of neighbouring hash classes over all training texts.
2. The driver starts the states from the bounded table of pairs (an aggregate Markov model fitted by EM).
3. One pass writes every text's classes (two bytes a token) and its words outside the broadcast head of frequent words;
   the rounds and the scores read this table, so no text is split again.
4. Each Baum-Welch round runs forward and backward over whole texts, however long, and sums the expected counts in every
   task, then across partitions (classes x states numbers).
5. A scaled forward recursion gives the exact log-likelihood of every text. Words outside the head are sent once per text
   and distinct word and joined with the counts.

Defined results: a null or empty text has one token, its end. A null doc_id counts as the empty string when the held-out
rows are dealt. Repeated rows are scored (and counted) each. Without training rows all counts are 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, Shared, keyed, remainder, shared_table

BUCKETS = 1023  # classes by word ending; the one after them stands for the end in the table of pairs
SUFFIX = 3
TOKENS_AT_ONCE = 200_000
LONG = 50_000  # tokens above which a text runs alone, so many at a time


@dataclass(frozen=True)
class HmmConfig:
    states: int = 8
    own: int = 4096  # words that are classes of their own
    head: int = 131_072  # most words in the broadcast dictionary
    rounds: int = 2  # Baum-Welch passes over all training texts
    start_rounds: int = 60
    seed: int = 7
    prior: float = 20.0  # pseudo-tokens of the corpus distribution in every state


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def bucket_of(word: bytes) -> int:
    return crc32(word[-SUFFIX:]) % BUCKETS


class _Buckets(dict):
    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        out = self[word] = crc32(word[-SUFFIX:]) % BUCKETS
        return out


def _texts(batch, name=TEXT):
    for s in range(0, batch.num_rows, 500):
        yield from batch.column(name).slice(s, 500).cast(pa.binary()).to_pylist()


def _count(batches):
    """Rows (word, cell, n): counts of words, of pairs of classes (cell >= 0) and of texts (cell -1)."""
    side = BUCKETS + 1
    counts, buckets, pairs, texts = Counter(), _Buckets(), np.zeros(side * side, dtype=np.int64), 0

    def flush():
        out = pa.record_batch([pa.array(list(counts.keys()), pa.binary()), pa.nulls(len(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["word", "cell", "n"])
        counts.clear()
        return out

    for batch in batches:
        line = []
        for text in _texts(batch):
            words = words_of(text)
            counts.update(words)
            line.extend(map(buckets.__getitem__, words))
            line.append(BUCKETS)
            texts += 1
            if len(line) > TOKENS_AT_ONCE:
                _pairs(line, pairs, side)
                line = []
            if len(counts) > 100_000:
                yield flush()
        _pairs(line, pairs, side)
    yield flush()
    cells = np.flatnonzero(pairs)
    yield pa.record_batch([pa.nulls(len(cells) + 1, pa.binary()), pa.array(np.append(cells, -1)), pa.array(np.append(pairs[cells], texts))], ["word", "cell", "n"])


def _pairs(line, pairs, side):
    seq = np.array(line, dtype=np.int64)
    left, right = seq[:-1], seq[1:]
    inside = left != BUCKETS
    found, n = np.unique(left[inside] * side + right[inside], return_counts=True)
    pairs[found] += n


# The recursion works on many texts at once: rows are sorted by length, tokens laid out by position.


def _together(texts: list[np.ndarray]):
    """Groups of texts of about TOKENS_AT_ONCE tokens, alike in length so that a group needs few steps; those above LONG are alone."""
    group, total = [], 0
    for i in np.argsort([-len(x) for x in texts], kind="stable").tolist():
        if group and (len(texts[group[0]]) > LONG or total + len(texts[i]) > TOKENS_AT_ONCE):
            yield group
            group, total = [], 0
        group.append(i)
        total += len(texts[i])
    if group:
        yield group


def _layout(codes: list[np.ndarray]):
    """Of texts by falling length: how many there are at each position, where it begins, all tokens by position, each one's row."""
    size = np.array([len(x) for x in codes])
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    off = np.concatenate([[0], np.cumsum(active)])
    rank = np.repeat(np.arange(len(size)), size)
    at = off[np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size)] + rank
    flat, rank_at = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
    flat[at], rank_at[at] = np.concatenate(codes), rank
    return active, off, flat, rank_at


def _forward(E, active, off, A, start):
    """Scaled alphas and their scales; start: the prediction for the first tokens."""
    alpha, scale, ahead = np.empty_like(E), np.empty(len(E)), start
    for o, n in zip(off.tolist(), active.tolist(), strict=False):
        a = ahead[:n] * E[o : o + n]
        c = a.sum(1)
        a /= c[:, None]
        alpha[o : o + n], scale[o : o + n] = a, c
        ahead = a @ A
    return alpha, scale


def _line(n: int):
    """The layout of one text."""
    return np.ones(n, dtype=np.int64), np.arange(n + 1)


def log10_likelihood(texts: list[np.ndarray], pi, A, B) -> np.ndarray:
    """Exact log10 P of each class sequence."""
    out = np.zeros(len(texts))
    for group in _together(texts):
        x = texts[group[0]]
        if len(x) > LONG:
            ahead = pi
            for s in range(0, len(x), LONG):
                part = x[s : s + LONG]
                alpha, scale = _forward(B.T[part], *_line(len(part)), A, ahead[None])
                out[group[0]] += np.log10(scale).sum()
                ahead = alpha[-1] @ A
        else:
            active, off, flat, rank_at = _layout([texts[i] for i in group])
            _, scale = _forward(B.T[flat], active, off, A, np.broadcast_to(pi, (len(group), len(pi))))
            out[group] = np.bincount(rank_at, weights=np.log10(scale), minlength=len(group))
    return out


def expected(texts: list[np.ndarray], pi, A, B):
    """Expected starts, transitions and emissions of the class sequences, each run forward and backward as a whole."""
    sums = [np.zeros_like(pi), np.zeros_like(A), np.zeros_like(B)]
    for group in _together(texts):
        rows = [texts[i] for i in group]
        found = _expected_alone(rows[0], pi, A, B) if len(rows[0]) > LONG else _expected(rows, pi, A, B)
        for out, more in zip(sums, found, strict=True):
            out += more
    return sums


def _emissions(gamma, codes, classes):
    return np.stack([np.bincount(codes, weights=gamma[:, k], minlength=classes) for k in range(gamma.shape[1])])


def _expected(rows: list[np.ndarray], pi, A, B):
    active, off, flat, _ = _layout(rows)
    E = B.T[flat]
    alpha, scale = _forward(E, active, off, A, np.broadcast_to(pi, (len(rows), len(pi))))
    beta, back = np.ones_like(E), np.ascontiguousarray(A.T)
    E /= scale[:, None]
    begin, number = off.tolist(), active.tolist()
    for t in range(len(number) - 2, -1, -1):
        o, p, n = begin[t], begin[t + 1], number[t + 1]
        beta[o : o + n] = (E[p : p + n] * beta[p : p + n]) @ back
    E *= beta
    before = np.arange(off[1], len(flat)) - np.repeat(active[:-1], active[1:])
    moves = A * (alpha[before].T @ E[off[1] :])
    alpha *= beta
    return alpha[: active[0]].sum(0), moves, _emissions(alpha, flat, B.shape[1])


def _expected_alone(x: np.ndarray, pi, A, B):
    """The same of one very long text: only the states before every LONG-th token are kept, and each stretch is run again backwards."""
    ahead, stretches = pi, []
    for s in range(0, len(x), LONG):
        stretches.append((x[s : s + LONG], ahead))
        alpha, _ = _forward(B.T[stretches[-1][0]], *_line(len(stretches[-1][0])), A, ahead[None])
        ahead = alpha[-1] @ A
    moves, gone, after = np.zeros_like(A), np.zeros_like(B), None
    for part, ahead in reversed(stretches):
        E = B.T[part]
        alpha, scale = _forward(E, *_line(len(part)), A, ahead[None])
        E /= scale[:, None]
        beta = np.ones_like(E)
        if after is not None:
            beta[-1] = A @ after
            moves += A * np.outer(alpha[-1], after)
        for t in range(len(part) - 2, -1, -1):
            beta[t] = A @ (E[t + 1] * beta[t + 1])
        E *= beta
        moves += A * (alpha[:-1].T @ E[1:])
        after = E[0]
        alpha *= beta
        gone += _emissions(alpha, part, B.shape[1])
    return alpha[0], moves, gone


def start_states(pairs: np.ndarray, states: int, rounds: int, seed: int):
    """EM for P(next | class) = sum over states of P(state | class) P(next | state)."""
    n = len(pairs)
    rng = np.random.default_rng(seed)
    emit = rng.dirichlet(np.full(n, 1.0), states) + 1.0 / n
    emit /= emit.sum(1, keepdims=True)
    mix = rng.dirichlet(np.full(states, 5.0), n)
    for _ in range(rounds):
        ratio = pairs / np.maximum(mix @ emit, 1e-300)
        mix, emit = mix * (ratio @ emit.T) + 1e-3, emit * (mix.T @ ratio) + 1e-6
        mix /= mix.sum(1, keepdims=True)
        emit /= emit.sum(1, keepdims=True)
    moves = emit @ mix
    return moves / moves.sum(1, keepdims=True), emit


class _Codes(dict):
    """Word to its number in the head, or to head size + bucket."""

    def __missing__(self, word):
        return self.size + crc32(word[-SUFFIX:]) % BUCKETS


def _codes(model) -> _Codes:
    codes = _Codes(zip(model["head"], range(len(model["head"])), strict=True))
    codes.size = len(model["head"])
    return codes


def _class_table(model) -> np.ndarray:
    """Class of each code; the last code is the end."""
    return np.concatenate([model["class_of_head"], model["own"] + np.arange(BUCKETS), [model["own"] + BUCKETS]])


CODED = f"{ROW} long, {ID} long, held_out boolean, n_tokens long, n_known long, base_part double, within_part double, classes binary, rare array<binary>, tf array<long>"


def _encode(shared):
    """Each text's classes, what it has of the scores by itself, and its words outside the head with their counts."""

    def run(batches):
        model = shared.value
        codes, table = _codes(model), _class_table(model)
        size, end, base, within, known = len(model["head"]), len(table) - 1, model["base"], model["within"], model["known"]
        short = table.astype("<u2")

        def coded(batch, at, seqs, rare):
            n, lens = len(seqs), np.array([len(x) for x in seqs])
            owner, flat = np.repeat(np.arange(n), lens), np.concatenate(seqs)
            total = lambda x: np.bincount(owner, weights=x, minlength=n)
            took = pa.array(at)
            own = [batch.column(c).take(took) for c in (ROW, ID, "held_out")]
            sums = [pa.array(lens), pa.array(total(known[flat]).astype(np.int64)), pa.array(total(base[flat])), pa.array(total(within[flat]))]
            lists = [pa.array([short[x].tobytes() for x in seqs], pa.binary()), pa.array([list(c) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int64()))]
            return pa.record_batch([*own, *sums, *lists], [c.split()[0] for c in CODED.split(", ")])

        for batch in batches:
            at, seqs, rare, total = [], [], [], 0
            for i, text in enumerate(_texts(batch)):
                words = words_of(text)
                seq = np.array([*map(codes.__getitem__, words), end], dtype=np.int64)
                at.append(i)
                seqs.append(seq)
                rare.append(Counter([words[j] for j in np.flatnonzero((seq >= size) & (seq < end)).tolist()]))
                total += len(seq)
                if total > TOKENS_AT_ONCE:
                    yield coded(batch, at, seqs, rare)
                    at, seqs, rare, total = [], [], [], 0
            if at:
                yield coded(batch, at, seqs, rare)

    return run


def _sequences(batch, begin: int, number: int) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in batch.column("classes").slice(begin, number).to_pylist()]


def _slices(batch):
    """(begin, number) of runs of a batch's rows of about 16 groups of tokens."""
    sizes = np.array([len(x) // 2 for x in batch.column("classes").to_pylist()])
    begin = 0
    while begin < len(sizes):
        number = max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), 16 * TOKENS_AT_ONCE, side="right")))
        yield begin, number
        begin += number


def _expect(shared):
    """Rows (class, values): expected emissions of each class by state; class -1: starts, -2 - k: transitions from state k."""

    def run(batches):
        pi, A, B = shared.value
        sums = [np.zeros_like(pi), np.zeros_like(A), np.zeros_like(B)]
        for batch in batches:
            for part in _slices(batch):
                for out, more in zip(sums, expected(_sequences(batch, *part), pi, A, B), strict=True):
                    out += more
        starts, moves, gone = sums
        used = np.flatnonzero(gone.sum(0))
        keys = np.concatenate([[-1], -2 - np.arange(len(pi)), used])
        values = np.concatenate([starts[None], moves, gone[:, used].T])
        yield pa.record_batch([pa.array(keys), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(pi)))], ["class", *(f"s{k}" for k in range(len(pi)))])

    return run


OWN = [ROW, ID, "held_out", "n_tokens", "n_known", "base_part"]
SCORED = f"{ROW} long, {ID} long, held_out boolean, n_tokens long, n_known long, base_part double, model_part double"


def _score(shared):
    def run(batches):
        states = shared.value
        for batch in batches:
            for begin, number in _slices(batch):
                part = batch.slice(begin, number)
                score = log10_likelihood(_sequences(batch, begin, number), *states) + part.column("within_part").to_numpy(zero_copy_only=False)
                yield pa.record_batch([*(part.column(c) for c in OWN), pa.array(score)], [*OWN, "model_part"])

    return run


def start(train: DataFrame, config: HmmConfig = HmmConfig()) -> tuple[dict, DataFrame]:
    """The bounded model before Baum-Welch and the table (word, n) of all training words outside its head; train: rows of keyed()."""
    K = config.states
    counted = shared_table(train.select(TEXT).mapInArrow(_count, "word binary, cell long, n long").groupBy("word", "cell").agg(F.sum("n").alias("n")))
    words = counted.where("word is not null").select("word", "n")
    side = BUCKETS + 1
    cells = counted.where("word is null").select("cell", "n").toPandas()  # at most side * side + 1 rows
    texts = int(cells.loc[cells.cell == -1, "n"].sum())
    cells = cells[cells.cell >= 0]
    pairs = np.zeros(side * side)
    pairs[cells.cell.to_numpy(dtype=np.int64)] = cells.n.to_numpy(dtype=float)
    pairs = pairs.reshape(side, side)

    # The head: all words from a count on, the count such that they are few enough. Steps of a 16th of a power of two.
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r[0], r[1]) for r in words.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True)
    least, room = None, config.head
    for at, n in steps:
        if n > room:
            break
        least, room = at, room - n
    head = [] if least is None else sorted(((int(r[1]), bytes(r[0])) for r in words.where(step >= least).toPandas().itertuples(index=False)), key=lambda x: (-x[0], x[1]))
    rare = words if least is None else words.where(step < least)

    tail = F.crc32(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})")) % BUCKETS
    by_bucket = {int(r[0]): (int(r[1]), int(r[2])) for r in words.groupBy(tail).agg(F.sum("n"), F.count("*")).collect()}
    total, distinct = sum(x for x, _ in by_bucket.values()) + texts, sum(x for _, x in by_bucket.values()) + bool(texts)
    sums, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, (s, d) in by_bucket.items():
        sums[b], kinds[b] = s, d
    own = min(config.own, len(head))
    counts, buckets = np.array([n for n, _ in head], dtype=float), np.array([bucket_of(w) for _, w in head], dtype=np.int64)
    whole = sums.copy()
    np.subtract.at(sums, buckets[:own], counts[:own])
    np.subtract.at(kinds, buckets[:own], 1)

    size = len(head)
    class_of_head = np.where(np.arange(size) < own, np.arange(size), own + buckets)
    classes = own + BUCKETS + 1
    corpus = np.concatenate([counts[:own], sums, [texts]]) + 0.5
    A, emit = start_states(pairs, K, config.start_rounds, config.seed)
    share = np.concatenate([counts[:own] / np.maximum(whole[buckets[:own]], 1), sums / np.maximum(whole, 1), [1.0]])
    B = emit[:, np.concatenate([buckets[:own], np.arange(BUCKETS + 1)]).astype(np.int64)] * share + 1e-3 * corpus / corpus.sum()
    B /= B.sum(1, keepdims=True)
    floor, inside = np.log10(total + 0.5 * (distinct + 1)), np.log10(sums + 0.5 * (kinds + 1))
    log = np.log10(counts + 0.5)
    model = {
        "head": [w for _, w in head], "own": own, "class_of_head": class_of_head, "train_tokens": total, "corpus": corpus / corpus.sum(), "pi": np.full(K, 1.0 / K), "A": A, "B": B,
        "base": np.concatenate([log - floor, np.full(BUCKETS, np.log10(0.5) - floor), [np.log10(texts + 0.5) - floor]]),
        "within": np.concatenate([np.where(np.arange(size) < own, 0.0, log - inside[buckets]), np.log10(0.5) - inside, [0.0]]),
        "known": np.concatenate([np.ones(size), np.zeros(BUCKETS), [float(texts > 0)]]),
    }
    return model, rare


def encoded(rows: DataFrame, model: dict) -> DataFrame:
    """The stored table of codes of all rows of keyed() with a column held_out."""
    return shared_table(rows.select(ROW, ID, "held_out", TEXT).mapInArrow(_encode(Shared(rows.sparkSession, model)), CODED))


def baum_welch(coded: DataFrame, model: dict, config: HmmConfig = HmmConfig()) -> dict:
    """The model after the config's rounds over the rows that aren't held out."""
    K, classes = config.states, model["B"].shape[1]
    train = coded.where(~F.col("held_out")).select("classes")
    schema = ", ".join(["class long", *(f"s{k} double" for k in range(K))])
    for _ in range(config.rounds):
        shared = Shared(coded.sparkSession, (model["pi"], model["A"], model["B"]))
        sums = train.mapInArrow(_expect(shared), schema).groupBy("class").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(K))).toPandas()
        found = {int(r[0]): np.array(r[1:], dtype=float) for r in sums.itertuples(index=False)}
        if not sum(v.sum() for v in found.values()):
            break  # no training rows
        gone = np.zeros((K, classes))
        for c, v in found.items():
            if c >= 0:
                gone[:, c] = v
        B = gone + config.prior * model["corpus"]
        A = np.stack([found[-2 - k] for k in range(K)]) + 0.1
        pi = found[-1] + 0.1
        model = model | {"pi": pi / pi.sum(), "A": A / A.sum(1, keepdims=True), "B": B / B.sum(1, keepdims=True)}
    return model


def score(coded: DataFrame, model: dict, rare: DataFrame) -> DataFrame:
    """log10 probabilities of all rows, by the words' base model and by the model.

    A word outside the head counts as unseen (log10 of 0.5) where it is split; those that training has are joined and mended.
    """
    shared = Shared(coded.sparkSession, (model["pi"], model["A"], model["B"]))
    texts = coded.select(*OWN, "within_part", "classes").mapInArrow(_score(shared), SCORED)
    words = coded.select(ROW, F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("tf").alias("tf"))).alias("w")).select(ROW, "w.word", "w.tf")
    more = F.col("tf") * F.log10((F.col("n") + 0.5) / 0.5)
    met = words.join(rare, "word").select(ROW, F.lit(None).cast("long").alias(ID), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.col("tf").alias("n_known"), more.alias("base_part"), more.alias("model_part"))
    sums = [F.sum(c).alias(n) for c, n in (("n_tokens", "n_tokens"), ("n_known", "n_known"), ("base_part", "base_score"), ("model_part", "score"))]
    grouped = texts.unionByName(met).groupBy(ROW).agg(F.max(ID).alias("doc_id"), F.max("held_out").alias("held_out"), *sums)
    return grouped.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["train_tokens"])).cast("long").alias("train_tokens"), "base_score", "score")


def fit(rows: DataFrame, config: HmmConfig = HmmConfig()) -> tuple[dict, DataFrame, DataFrame]:
    """(model, rare, coded) of the rows of keyed() with a column held_out; the model is trained on those that aren't."""
    model, rare = start(rows.where(~F.col("held_out")), config)
    coded = encoded(rows, model)
    return baum_welch(coded, model, config), rare, coded


def language_model_scores(docs: DataFrame, config: HmmConfig = HmmConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that aren't held out and score all."""
    model, rare, coded = fit(keyed(docs, id_col, text_col).withColumn("held_out", remainder(ID, 5) == 1), config)
    return score(coded, model, rare)
