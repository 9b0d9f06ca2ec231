"""Vector best-fit packing of documents into training sequences.

A piece needs tokens, one document place and attention cost (its length squared); a bin has a capacity of each. All three
follow from the length, so pieces of one length are alike, and the driver packs the histogram of lengths (as many
rows as a sequence has tokens): longest first, groups of equal bins instead of bins, each time the fitting group that
the weighted residual norm or dot product prefers. That gives a table of slots: for the r-th piece of a length, its bin
and place. Pieces find r from their rank in their task and the counts of tasks before it, so no task sees them all.

Defined results: a null or empty text is its end token alone, one piece. Null and repeated doc_ids are packed as rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, Shared, keyed, series_udf, shared_table, tokenizer_path, worker_cache

END = 2
MODEL = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No pre-token of the vocabulary's pattern starts inside a word after a blank that it doesn't hold, nor goes on from a letter or
#: digit to a stop, so these pieces are encoded alone. Each is encoded once as long as a worker remembers it.
CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}.,;:!?]*[A-Za-z0-9À-ÖØ-öø-ÿ](?=[.,;:!?])|[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
#: Letters after at most one blank are one pre-token.
SIMPLE = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
CHARS_AT_ONCE = 2_000_000
REMEMBERED = 1_000_000


@dataclass(frozen=True)
class Bins:
    """Capacities of a sequence and their weights; select: "norm" (least weighted residual left) or "dot" (largest weighted product of need and residual)."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    select: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)


def pack_histogram(counts: dict[int, int], bins: Bins = Bins()) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, number, first bin, offset) for counts of pieces by length, and the number of bins.

    A slot: that many pieces of that length, by rank, one in each bin from the first on, at that offset.
    """
    cap = np.array([bins.tokens, bins.documents, bins.attention], dtype=float)
    weight = np.array(bins.weights)
    slots, made = [], 0
    room = np.zeros((64, 3))
    group = np.zeros((64, 2), dtype=np.int64)  # first bin, number
    used = 0

    def add(residual, first, number):
        nonlocal room, group, used
        if used == len(room):
            room, group = np.concatenate([room, np.zeros_like(room)]), np.concatenate([group, np.zeros_like(group)])
        room[used], group[used] = residual, (first, number)
        used += 1

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        need, left, rank = np.array([length, 1, length * length], dtype=float), counts[length], 0
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            fits = np.flatnonzero((room[:used] >= need).all(1) & (group[:used, 1] > 0))
            if len(fits):
                after = (room[fits] - need) / cap
                value = (weight * after**2).sum(1) if bins.select == "norm" else -(weight * (need / cap) * (room[fits] / cap)).sum(1)
                g = fits[np.lexsort((group[fits, 0], value))[0]]
                first, n = group[g].tolist()
                take = min(n, left)
                slots.append((length, rank, take, first, bins.tokens - int(room[g, 0])))
                residual = room[g] - need
                if take == n:
                    room[g] = residual
                else:
                    group[g] = (first + take, n - take)
                    add(residual, first, take)
                left, rank = left - take, rank + take
                continue
            each = min(int(min(cap // need)), left)
            new = left // each
            for k in range(each):
                slots.append((length, rank, new, made, k * length))
                left, rank = left - new, rank + new
            add(cap - each * need, made, new)
            made += new
            keep = np.flatnonzero((group[:used, 1] > 0) & (room[:used, 0] >= 1) & (room[:used, 1] >= 1))
            if len(keep) < used // 2:
                room[: len(keep)], group[: len(keep)] = room[keep], group[keep]
                used = len(keep)
    return np.array(slots, dtype=np.int64).reshape(-1, 5), made


def _encoder():
    cache = worker_cache()
    if "bpe" not in cache:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        cache["bpe"] = Tokenizer.from_file(tokenizer_path(MODEL)), {}
    return cache["bpe"]


def _bytes_as_letters() -> dict[int, int]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}


def _encoded(tokenizer, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
    """Each piece with its ids. One that is a pre-token by itself needs the library's model only."""
    letters, model, rest = _bytes_as_letters(), tokenizer.model, []
    for p in pieces:
        if SIMPLE.fullmatch(p):
            yield p, array("I", [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes()
        else:
            rest.append(p)
    for s in range(0, len(rest), 10_000):
        part = rest[s : s + 10_000]
        yield from zip(part, (array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True)


def _pieces(texts: list[str]) -> list[bytes]:
    """The ids of each text, whose pieces are remembered."""
    tokenizer, known = _encoder()
    pieces = [CHUNK.findall(t) for t in texts]
    all_ = set().union(*pieces)
    new = all_.difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = all_
    known.update(_encoded(tokenizer, list(new)))
    return [b"".join(map(known.__getitem__, found)) for found in pieces]


def _long(text: str) -> bytes:
    """The ids of a very long text, of which a bounded number of pieces is held at a time."""
    out, found = [], CHUNK.finditer(text)
    while part := [m[0] for m in islice(found, 100_000)]:
        out += _pieces(["".join(part)])
    return b"".join(out)


def encode_all(texts: list[str]) -> Iterator[bytes]:
    """The texts' ids as little-endian unsigned 32-bit numbers; special strings are their tokens, as the library has it by default."""
    group, chars = [], 0
    for t in texts:
        special, long = SPECIAL in t, len(t) > CHARS_AT_ONCE
        if group and (special or long or chars + len(t) > CHARS_AT_ONCE):
            yield from _pieces(group)
            group, chars = [], 0
        if special:
            yield array("I", _encoder()[0].encode(t, add_special_tokens=False).ids).tobytes()
        elif long:
            yield _long(t)
        else:
            group.append(t)
            chars += len(t)
    if group:
        yield from _pieces(group)


def cuts(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of total tokens; the first may be shorter."""
    first = total if total <= most else total % most or most
    return [(0, first), *((s, most) for s in range(first, total, most))]


PIECES = ["part", "nth", ROW, ID, "piece", "start", "length", "ids_crc32"]


def _cut(most):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        tail = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            out = [[] for _ in range(7)]
            for row, i, found in zip(batch.column(ROW).to_pylist(), batch.column(ID).to_pylist(), encode_all(batch.column(TEXT).to_pylist()), strict=True):
                ids = found + tail
                for p, (start, length) in enumerate(cuts(len(ids) // 4, most)):
                    for x, v in zip(out, (seen[length], row, i, p, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        x.append(v)
                    seen[length] += 1
            yield pa.record_batch([pa.array([part] * len(out[0]), pa.int64()), *(pa.array(x, pa.int64()) for x in out)], PIECES)

    return run


def pack(docs: DataFrame, bins: Bins = Bins(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of every document."""
    rows = keyed(docs, id_col, text_col)
    most = int(min(bins.tokens, bins.attention**0.5))
    pieces = shared_table(rows.select(ROW, ID, TEXT).mapInArrow(_cut(most), ", ".join(f"{c} long" for c in PIECES)))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `most` rows
    slots, _ = pack_histogram(counts, bins)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    shared = Shared(docs.sparkSession, slots)

    def place(batches):
        table = shared.value
        starts = table[:, 0] << 44 | table[:, 1]
        for length, rank in batches:
            x = rank.to_numpy()
            at = np.searchsorted(starts, length.to_numpy() << 44 | x, side="right") - 1
            yield pd.DataFrame({"sequence_id": table[at, 3] + x - table[at, 1], "offset": table[at, 4]})

    placed = series_udf(place, "sequence_id long, offset long", 2)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"]).withColumn("slot", placed("length", F.col("before") + F.col("nth")))
    return ranked.select(F.col(ID).alias("doc_id"), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")
