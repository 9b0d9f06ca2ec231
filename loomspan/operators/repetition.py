"""Repeated fragments of a text and the penalty for them.

Works on UTF-8 bytes. Equal windows of 8 bytes are grouped; a group's occurrences are thinned so that they don't overlap.
Level by level each group grows: first by a group that starts where its occurrences end, else by 8 bytes and then by
single bytes. Where fragments overlap, the one that covers more bytes in all stands, of equal ones the longer, then the
earlier. Groups are taken by their first occurrence, so results don't depend on the order of a hash table.
"""

from __future__ import annotations

import functools
import gc
from collections import defaultdict
from itertools import chain, pairwise

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..udf import row_udf
from .markdown import innermost_kinds, parse_tree

SEED = 8
SPANS = "array<struct<text:string,scan_length:int,index:array<int>,tagName:array<string>>>"


def thin(starts: list[int], size: int) -> list[list[int]]:
    """Starts in groups whose members lie at least size apart; a group takes what it can before the next."""
    if len(starts) == 2:
        return [starts] if starts[1] - starts[0] >= size else []
    out, rest = [], starts
    while len(rest) > 1:
        taken, left, end = [], [], -1
        for s in rest:
            if s >= end:
                taken.append(s)
                end = s + size
            else:
                left.append(s)
        if len(taken) > 1:
            out.append(taken)
        rest = left
    return out


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of equal values."""
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return begin, np.append(begin[1:], len(ordered))[: len(begin)]


def _crowded(starts: np.ndarray, begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether some neighbours in a stretch of starts lie closer together than the stretch's size; the stretches cover all starts."""
    close = np.append(0, starts[1:] - starts[:-1] < np.repeat(size, end - begin)[1:])[: len(starts)]
    total = np.cumsum(close)
    return total[end - 1] > total[begin]


def _windows(data: bytes) -> tuple[list[list[int]], np.ndarray]:
    """Thinned starts of each window of 8 bytes that occurs twice or more, and for every place the number of the window there, -1 for others."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(raw) - SEED + 1
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        keys = keys << np.uint64(8) | raw[k : k + n]
    order = np.argsort(keys, kind="stable")
    begin, end = _runs(keys[order])
    several = end - begin > 1
    order = order[np.repeat(several, end - begin)]
    lengths = (end - begin)[several]
    end = np.cumsum(lengths)
    begin = end - lengths
    number = np.full(n + SEED, -1, dtype=np.int64)
    number[order] = np.repeat(np.arange(len(lengths)), lengths)
    places, groups = order.tolist(), []
    for b, e, near in zip(begin.tolist(), end.tolist(), _crowded(order, begin, end, np.full(len(begin), SEED)).tolist(), strict=True):
        groups += thin(places[b:e], SEED) if near else [places[b:e]]
    return groups, number


def _longer(data: bytes, number: list[int], size: int, starts: list[int]) -> tuple[int, list[int]]:
    """Grown by windows of 8 bytes while two occurrences agree, then by bytes while all do."""
    top = len(data)
    while len(starts) > 2:
        groups = defaultdict(list)
        for s in starts:
            if s + size < top and (w := number[s + size]) >= 0:
                groups[w].append(s)
        kept = max((g for found in groups.values() if len(found) > 1 for g in thin(found, size + SEED)), key=lambda g: (len(g), -g[0]), default=None)
        if kept is None or len(kept) * (size + SEED) < len(starts) * size:
            break
        size, starts = size + SEED, kept
    if len(starts) == 2:
        a, b = starts
        while b + size + SEED <= top and b - a >= size + SEED and data[a + size : a + size + SEED] == data[b + size : b + size + SEED]:
            size += SEED
    first, least = starts[0], min((b - a for a, b in pairwise(starts)), default=top)
    while starts[-1] + size < top and least > size and all(data[s + size] == data[first + size] for s in starts):
        size += 1
    return size, starts


def _by_bytes(raw: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sizes, but at most 8 more, to which stretches of starts grow by bytes while all of a stretch agree, none reaches its next and none the end."""
    sizes, left = sizes.copy(), np.arange(len(sizes))
    gaps = np.append(flat[1:] - flat[:-1], 0)
    gaps[end - 1] = len(raw)
    most = np.minimum(np.minimum(np.minimum.reduceat(gaps, begin), len(raw) - flat[end - 1]), sizes + SEED)
    left = left[sizes < most]
    while len(left):
        lengths = end[left] - begin[left]
        at = np.cumsum(lengths) - lengths
        here = raw[flat[np.repeat(begin[left] - at, lengths) + np.arange(lengths.sum())] + np.repeat(sizes[left], lengths)]
        left = left[np.minimum.reduceat(here, at) == np.maximum.reduceat(here, at)]
        sizes[left] += 1
        left = left[sizes[left] < most[left]]
    return sizes


def _grow(data: bytes, number: np.ndarray, level):
    """Each fragment of the level grown: by the one that follows most, else by windows and bytes; those that didn't grow are left out."""
    sizes = np.array([m[0] for m in level])
    lengths = np.array([len(m[1]) for m in level])
    flat = np.fromiter(chain.from_iterable(m[1] for m in level), dtype=np.int64, count=lengths.sum())
    owner = np.repeat(np.arange(len(level)), lengths)
    order = np.argsort(flat, kind="stable")
    ordered, next_ = flat[order], flat + sizes[owner]
    low, high = np.searchsorted(ordered, next_, "left"), np.searchsorted(ordered, next_, "right")
    many = high - low
    source = np.repeat(np.arange(len(flat)), many)
    other = owner[order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(source))]]
    pair = owner[source] * len(level) + other
    order = np.argsort(pair, kind="stable")
    pair, starts = pair[order], flat[source[order]]
    begin, end = _runs(pair)
    several = end - begin > 1
    starts = starts[np.repeat(several, end - begin)]
    pair, lengths_ = pair[begin[several]], (end - begin)[several]
    end = np.cumsum(lengths_)
    begin = end - lengths_
    owners, others = np.divmod(pair, len(level))
    whole = sizes[owners] + sizes[others]
    near = _crowded(starts, begin, end, whole)
    best: list = [None] * len(level)
    for o, w, b, e, close in zip(owners.tolist(), whole.tolist(), begin.tolist(), end.tolist(), near.tolist(), strict=True):
        # Of equal ones the first stands.
        for g in thin(starts[b:e].tolist(), w) if close else (None,):
            n, first = (e - b, int(starts[b])) if g is None else (len(g), g[0])
            key = (n * w, w, -first)
            if best[o] is None or key > best[o][0]:
                best[o] = (key, b, e, g)
    out, places = {}, None
    for m in best:
        if m is not None:
            key, b, e, g = m
            g = starts[b:e].tolist() if g is None else g
            out[key[1], tuple(g)] = (key[1], g)
    rest = np.array([i for i, m in enumerate(best) if m is None], dtype=np.int64)
    if len(rest):
        chosen = np.repeat(np.array([m is None for m in best]), lengths)
        flat, owner = flat[chosen], np.repeat(np.arange(len(rest)), lengths[rest])
        window = number[np.minimum(flat + sizes[rest][owner], len(data))]
        agree = np.sort((owner * len(number) + window)[window >= 0])
        seeded = np.zeros(len(rest), dtype=bool)
        seeded[agree[1:][agree[1:] == agree[:-1]] // len(number)] = True
        end = np.cumsum(lengths[rest])
        longer = _by_bytes(np.frombuffer(data, dtype=np.uint8), sizes[rest], flat, end - lengths[rest], end)
        for i, by_windows, size in zip(rest.tolist(), seeded.tolist(), longer.tolist(), strict=True):
            before, found = level[i]
            if by_windows or size == before + SEED:
                places = number.tolist() if places is None else places
                size, found = _longer(data, places, before, found)
            if size > before:
                out[size, tuple(found)] = (size, found)
    return sorted(out.values(), key=lambda m: (m[1][0], -m[0]))


def _dominant(found, n: int) -> list[tuple[int, list[int]]]:
    """Fragments, the widest in all first, that don't overlap one already kept."""
    kept, taken = [], bytearray(n)
    for size, starts in sorted(found, key=lambda m: (-m[0] * len(m[1]), -m[0], m[1][0])):
        free = [s for s in starts if taken.find(1, s, s + size) < 0]
        if len(free) > 1:
            kept.append((size, free))
            for s in free:
                taken[s : s + size] = bytes([1]) * size
    return sorted(kept, key=lambda m: m[1][0])


def without_collection(run):
    """run without pauses for garbage collection; what it makes has no cycles."""

    @functools.wraps(run)
    def call(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return run(*args)
        finally:
            if on:
                gc.enable()

    return call


@without_collection
def repeated_fragments(text: str) -> list[tuple[str, int, list[int]]]:
    """(fragment, bytes, starts in characters), ordered by first start; texts under 16 bytes have none."""
    data = text.encode()
    if len(data) < 2 * SEED:
        return []
    groups, number = _windows(data)
    level = sorted(((SEED, g) for found in groups for g in thin(found, SEED)), key=lambda m: m[1][0])
    found, rounds = [], 0
    while level and 2 * level[0][0] <= len(data) and rounds < 64:
        found += level
        found = _best_of_each_start(found)
        level, rounds = _grow(data, number, level), rounds + 1
    lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    places = (np.cumsum(lead) - 1).tolist() + [len(text)]
    out = []
    for size, starts in _dominant(found, len(data)):
        a, b = starts[0], starts[0] + size
        left = next((i for i in range(a, b) if data[i] & 0xC0 != 0x80), b) - a
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        size = b - a - left
        if size > 0:
            out.append((data[a + left : b].decode(), size, [places[s + left] for s in starts]))
    return out


def _best_of_each_start(found):
    best = {}
    for m in found:
        key = m[1][0]
        if key not in best or (m[0] * len(m[1]), m[0]) > (best[key][0] * len(best[key][1]), best[key][0]):
            best[key] = m
    return list(best.values())


def repetition_spans_of(text: str | None, tags: bool = True) -> list[dict]:
    found = repeated_fragments(text or "")
    return spans_in(found, parse_tree(text)[0] if tags and found else None)


def spans_in(found, root) -> list[dict]:
    """Fragments with the kinds of the nodes of root around them, null without root."""
    kinds = iter(innermost_kinds(root, [(i, i + len(t)) for t, _, index in found for i in index]) if root is not None else [])
    return [{"text": t, "scan_length": n, "index": index, "tagName": [next(kinds, None) for _ in index]} for t, n, index in found]


@row_udf(SPANS)
def repetition_spans(text):
    return repetition_spans_of(text)


IGNORED = ("TD", "TH", "TR", "TABLE", "Checkbox", "HR", "BR")


def repetition_penalty(spans: Column, least_count: int = 3, least_length: int = 64, distance_multiple: int = 14, least_area: int = 428, ignored: tuple[str, ...] = IGNORED) -> Column:
    """struct(score, error) from the spans of a text: occurrences outside ignored tags, in runs without long gaps; a run counts if it has enough of them."""

    def runs(e):
        kept = F.filter(F.arrays_zip(e["index"], e["tagName"]), lambda z: z["tagName"].isNull() | ~z["tagName"].isin(*ignored))
        start = F.struct(F.array().cast("array<int>").alias("sizes"), F.lit(0).alias("size"), F.lit(None).cast("int").alias("last"))
        step = lambda acc, z: F.when(acc["last"].isNull() | (z["index"] - acc["last"] <= (distance_multiple + 1) * e["scan_length"]), F.struct(acc["sizes"].alias("sizes"), (acc["size"] + 1).alias("size"), z["index"].alias("last"))).otherwise(F.struct(F.concat(acc["sizes"], F.array(acc["size"])).alias("sizes"), F.lit(1).alias("size"), z["index"].alias("last")))
        wanted = F.when(e["scan_length"] < least_length, F.floor(F.lit(least_area) / e["scan_length"]).cast("int")).otherwise(least_count)
        return F.filter(F.aggregate(kept, start, step, lambda acc: F.concat(acc["sizes"], F.array(acc["size"]))), lambda n: n >= wanted)

    counted = F.transform(spans, lambda e: F.struct(e.alias("e"), (F.aggregate(runs(e), F.lit(0), lambda a, n: a + n) * e["scan_length"]).alias("area")))
    hits = F.filter(counted, lambda c: c["area"] > 0)
    score = -F.aggregate(hits, F.lit(0).cast("long"), lambda a, c: a + c["area"]) / least_length
    return F.struct(score.alias("score"), F.transform(hits, lambda c: c["e"]).alias("error"))


def windows_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of 8 bytes that occur twice or more in a text, as numbers whose big-endian bytes they are, in order; how often each does; all their positions, one window's after the other's."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = len(raw) - SEED + 1
    if n < 2:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        keys <<= np.uint64(8)
        keys |= raw[k : k + n]
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(begin, append=n)
    several = counts > 1
    return keys[begin[several]], counts[several], order[np.repeat(several, counts)]


def window_lists(found: list, kind):
    """The Arrow lists of some texts' windows, straight from their numbers: a window costs tens of bytes instead of several Python objects."""
    import pyarrow as pa

    grams, counts, positions = (np.concatenate([f[i] for f in found]) for i in range(3))
    if len(grams) * SEED >= 1 << 31:
        raise ValueError("the repeated windows of one text pass 2 GB, the most that an Arrow array of Spark holds")
    fields = {f.name: f for f in kind.value_type}
    ends = np.cumsum(counts)
    columns = {
        "gram": pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(np.arange(0, SEED * len(grams) + 1, SEED, dtype=np.int32)), pa.py_buffer(grams.astype(">u8"))]),
        "n": pa.array(counts, pa.int64()),
        "first": pa.array(positions[ends - counts]),
        "last": pa.array(positions[ends - 1]),
        "positions": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(positions), type=fields["positions"].type),
    }
    rows = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
    return pa.ListArray.from_arrays(rows, pa.StructArray.from_arrays([columns[name] for name in fields], fields=list(fields.values())), type=kind)


@row_udf("array<struct<gram:binary,n:bigint,first:int,last:int,positions:array<int>>>", build=window_lists)
def equal_windows(text):
    """The windows of 8 bytes that occur twice or more in a text, by their bytes, with all their positions."""
    return windows_of(text)


def seed_groups(docs, id_col: str = "doc_id", text_col: str = "text"):
    """(id, gram, n, first, last, positions) of all equal windows of 8 bytes that occur twice or more in a text.

    Groups never cross a text, so they are found within its row and nothing is shuffled; rows of one id stay apart.
    """
    return docs.select(id_col, F.explode(equal_windows(text_col)).alias("w")).select(id_col, "w.*")
