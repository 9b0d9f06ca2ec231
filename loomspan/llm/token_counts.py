"""Token counts without token ids.

A text is cut into pre-tokens that no merge of the vocabulary crosses: a run of blanks with what follows it up to the next
blank, and line ends alone. Pieces are counted once for each distinct pre-token of the corpus, by the tokenizer's own
library. Counts of the most frequent pre-tokens (a bounded dictionary) are broadcast; the others are joined to the
per-document frequencies, and a document's tokens are the sum.

Defined results: a null or empty text has no bytes and no tokens. Repeated rows and null doc_ids are rows like any other.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, Shared, keyed, shared_table, tokenizer_path, worker_cache

MODEL = "piece_bpe_32k.model"
HEAD = 131_072
CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
BLANK = "▁"


def pre_tokens(text: str) -> list[str]:
    """The text's first word gets a blank in front, as the library gives it; the vocabulary's own sign for blanks is one."""
    return CHUNK.findall(" " + text.replace(BLANK, " ")) if text else []


def splits_safely(pieces: list[str]) -> bool:
    """Whether no piece holds a blank after another character, or a line end beside any other."""
    return not any(BLANK in p.lstrip(BLANK) or "\n" in p and len(p) > 1 for p in pieces)


def _library(model: str):
    key = ("pieces", model)
    cache = worker_cache()
    if key not in cache:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model) if "/" not in model else model)
        if not splits_safely([s.id_to_piece(i) for i in range(s.get_piece_size())]):
            raise ValueError(f"{model}: pieces cross blanks or line ends, so its texts can't be cut there")
        cache[key] = s
    return cache[key]


def piece_counts(model: str, chunks: list[str]) -> np.ndarray:
    """Pieces of each pre-token. The library puts a blank before what it reads: it stands for the first blank of a
    pre-token that has one; before others a line end takes it, whose pieces are then subtracted."""
    s = _library(model)
    led = np.array([not c.startswith(" ") for c in chunks], dtype=bool)
    ids = s.encode([f"\n{c}" if no else c[1:] for c, no in zip(chunks, led.tolist(), strict=True)], num_threads=1)
    own = np.array([len(x) for x in ids], dtype=np.int64)
    bare = np.array([c == " " for c in chunks], dtype=bool)  # the library gives nothing for an empty text
    return own - led * len(s.encode("\n")) + bare


def _count(batches):
    counts = Counter()

    def flush():
        out = pa.record_batch([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["chunk", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(TEXT).to_pylist():
            counts.update(pre_tokens(text))
            if len(counts) > 300_000:
                yield flush()
    yield flush()


def _pieces(model):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("chunk"), batch.column("n"), pa.array(piece_counts(model, batch.column("chunk").to_pylist()))], ["chunk", "n", "pieces"])

    return run


class _Head(dict):
    def __missing__(self, chunk):
        return -1


def _per_text(shared):
    """One row for each text, whose chunk no text has, and one for each of its pre-tokens outside the head."""

    def run(batches):
        head = _Head(shared.value)
        for batch in batches:
            rows, chunks, tf, base, sizes, ids = [], [], [], [], [], []
            for row, i, text in zip(batch.column(ROW).to_pylist(), batch.column(ID).to_pylist(), batch.column(TEXT).to_pylist(), strict=True):
                found = pre_tokens(text)
                pieces = np.array([*map(head.__getitem__, found)], dtype=np.int64)
                rare = Counter([found[j] for j in np.flatnonzero(pieces < 0)])
                rows += [row] * (1 + len(rare))
                ids += [i] * (1 + len(rare))
                chunks += [f"a {row}", *rare.keys()]
                tf += [0, *rare.values()]
                base += [int(pieces[pieces > 0].sum())] + [0] * len(rare)
                sizes += [len(text.encode())] + [0] * len(rare)
                if len(rows) > 200_000:
                    yield pa.record_batch([pa.array(rows), pa.array(ids, pa.int64()), pa.array(chunks), pa.array(tf), pa.array(base), pa.array(sizes)], [ROW, ID, "chunk", "tf", "base", "bytes"])
                    rows, chunks, tf, base, sizes, ids = [], [], [], [], [], []
            if rows:
                yield pa.record_batch([pa.array(rows), pa.array(ids, pa.int64()), pa.array(chunks), pa.array(tf), pa.array(base), pa.array(sizes)], [ROW, ID, "chunk", "tf", "base", "bytes"])

    return run


def vocabulary(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(chunk, n, pieces) of all distinct pre-tokens of the rows of keyed()."""
    counted = rows.select(TEXT).mapInArrow(_count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(_pieces(model), "chunk string, n long, pieces long")


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    rows = keyed(docs, id_col, text_col)
    known = shared_table(vocabulary(rows, model))
    step = F.floor(F.log2("n") * 16)
    least, room = None, head
    for at, n in sorted(((r[0], r[1]) for r in known.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True):
        if n > room:
            break
        least, room = at, room - n
    frequent = {} if least is None else {r[0]: int(r[1]) for r in known.where(step >= least).select("chunk", "pieces").toPandas().itertuples(index=False)}
    rare = (known if least is None else known.where(step < least)).select("chunk", "pieces")
    parts = rows.select(ROW, ID, TEXT).mapInArrow(_per_text(Shared(docs.sparkSession, frequent)), f"{ROW} long, {ID} long, chunk string, tf long, base long, bytes long")
    sums = parts.join(rare, "chunk", "left").groupBy(ROW).agg(F.max(ID).alias("doc_id"), F.sum("bytes").alias("n_bytes"), F.sum(F.col("base") + F.col("tf") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
