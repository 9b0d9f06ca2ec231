"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents and stored: each row is a shard, the posting lists of some hundred thousand words of whole
texts. A list holds a term's sorted positions, so a term as frequent as may be is spread over all shards. A test window is
looked up in each shard: its terms are ordered by the lengths of their lists there, the rarest list gives candidate
starts (position less the term's offset), and these are intersected with the other lists, rarest first, each shifted by
its term's offset. A window one of whose terms has no list in a shard costs nothing there. Candidates are taken in slices
of a bounded number, so memory follows neither their number nor a term's frequency.

The texts are read once, for the index; searches read the lists alone, in one pass for any number of test windows: these
are broadcast in blocks, which a task loads one after the other for a run of shards. `search` answers exact phrases and
proximity from the same index.

Defined results: a null or empty text has no words; it is hit by nothing and hits nothing. An item with a null id hits
words but is listed nowhere. Repeated items or documents count each as they are; equal ids are one item. Without windows
nothing is hit, without documents nothing returned.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, Shared, keyed, settled, shared_table

WIDTH = 10
BLOCK = 200_000  # windows in a broadcast block
SHARD = 400_000  # words in a shard (one text may be longer)
AT_ONCE = 500_000  # candidates that are intersected at once
RUN = 8  # shards between two loads of a block of windows, where there are several
WORDS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all other than ASCII characters."""
    return text.translate(WORDS).split()


def windows_of(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class _Terms(dict):
    def __missing__(self, word):
        return -1


class Windows:
    """A block of test windows: their terms, lengths and items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH):
        self.width, self.terms, by_window = width, _Terms(), defaultdict(set)
        for name, text in items:
            for window in windows_of(words_of(text) if text else [], width):
                by_window[window].add(name)
        windows = sorted(by_window)
        for window in windows:
            for word in window:
                self.terms.setdefault(word, len(self.terms))
        self.items = [sorted(x for x in by_window[w] if x is not None) for w in windows]
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.table = np.full((len(windows), width), -1, dtype=np.int64)
        for i, window in enumerate(windows):
            self.table[i, : len(window)] = [self.terms[w] for w in window]

    def hits(self, shard: Postings, reach: np.ndarray) -> np.ndarray:
        """Raises reach (by position) to the length of the longest window that starts there; (text, window) of all hits, once each."""
        none = np.zeros((0, 2), dtype=np.int64)
        if not len(self.table):
            return none
        there = np.array([self.terms[w] for w in shard.terms], dtype=np.int64)
        number = np.full(len(self.terms) + 1, -1, dtype=np.int64)
        number[there[there >= 0]] = np.flatnonzero(there >= 0)  # a test term's number in the shard
        table = np.where(self.table >= 0, number[self.table], -2)
        live = np.flatnonzero((table != -1).all(1))
        if not len(live):
            return none
        table = table[live]
        size = np.where(table >= 0, shard.sizes[table], np.iinfo(np.int64).max)
        order = np.argsort(size, axis=1, kind="stable")
        offset = order[:, 0]
        rarest = table[np.arange(len(live)), offset]
        last = np.cumsum(shard.sizes[rarest])
        found = [none]
        for s in range(0, int(last[-1]), AT_ONCE):
            candidate = np.arange(s, min(s + AT_ONCE, int(last[-1])))
            w = np.searchsorted(last, candidate, side="right")
            inside = candidate - (last[w] - shard.sizes[rarest[w]])
            start = shard.places[shard.begins[rarest[w]] + inside] - offset[w]
            good = start >= 0
            w, start = w[good], start[good]
            for r in range(1, self.width):
                o = order[w, r]
                good = shard.holds(table[w, o], start + o)
                w, start = w[good], start[good]
            window = live[w]
            np.maximum.at(reach, start, self.lengths[window])
            pairs = np.stack([np.searchsorted(shard.ends, start, side="right"), window], axis=1)
            found.append(np.unique(pairs, axis=0))
        return np.unique(np.concatenate(found), axis=0)


class Postings:
    """A shard of the index: its terms, the sizes of their lists, all lists one after the other, and where each text ends.

    Between two texts a position is left out, so no window reaches over it.
    """

    def __init__(self, terms: list[bytes], sizes: np.ndarray, places: np.ndarray, lengths: np.ndarray):
        self.terms, self.sizes, self.places, self.lengths = terms, sizes, places, lengths
        self.begins = np.cumsum(sizes) - sizes
        self.ends = np.cumsum(lengths + 1)
        self.total = int(self.ends[-1]) if len(lengths) else 0
        self.keys = np.repeat(np.arange(len(sizes)) * (self.total + 1), sizes) + places

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term's list has the place; term -2, the end of a short window, is everywhere."""
        key = term * (self.total + 1) + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (term < 0) | ((self.keys[at] == key) & (place <= self.total))


class _Numbers(dict):
    def __missing__(self, word):
        out = self[word] = len(self)
        return out


INDEX = "rows array<long>, ids array<long>, lengths binary, terms array<binary>, sizes binary, gaps binary"


def _postings(batches):
    """Shards: the texts' rows and numbers of words, the terms, the sizes of their lists and the gaps between list members."""

    def shard(batch, begin, end, numbers, seqs):
        lengths = np.array([len(x) for x in seqs], dtype=np.int64)
        flat = np.concatenate(seqs)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(seqs)), lengths)
        order = np.argsort(flat, kind="stable")
        lists = [[batch.column(c)[begin:end].to_pylist()] for c in (ROW, ID)]
        found = [lengths, np.bincount(flat, minlength=len(numbers)), np.diff(place[order], prepend=0)]
        lengths, sizes, gaps = (pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in found)
        rows, ids = (pa.array(x, pa.list_(pa.int64())) for x in lists)
        return pa.record_batch([rows, ids, lengths, pa.array([list(numbers)], pa.list_(pa.binary())), sizes, gaps], ["rows", "ids", "lengths", "terms", "sizes", "gaps"])

    for batch in batches:
        begin, numbers, seqs, total = 0, _Numbers(), [], 0
        for i, text in enumerate(_each_text(batch)):
            words = words_of(text) if text else []
            if total and total + len(words) > SHARD:
                yield shard(batch, begin, i, numbers, seqs)
                begin, numbers, seqs, total = i, _Numbers(), [], 0
            seqs.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
            total += len(words)
        if seqs:
            yield shard(batch, begin, batch.num_rows, numbers, seqs)


def _each_text(batch):
    for s in range(0, batch.num_rows, 500):
        yield from batch.column(TEXT).slice(s, 500).cast(pa.binary()).to_pylist()


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all words of docs, a row for each shard."""
    return shared_table(keyed(docs, id_col, text_col).select(ROW, ID, TEXT).mapInArrow(_postings, INDEX))


def _shards(batch):
    numbers = lambda x: np.frombuffer(x.as_py(), dtype="<i4").astype(np.int64)
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in ("lengths", "terms", "sizes", "gaps")}
        yield Postings(row["terms"].as_py(), numbers(row["sizes"]), np.cumsum(numbers(row["gaps"])), numbers(row["lengths"]))


RESULT = f"{ROW} long, {ID} long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _find(blocks):
    def run(batches):
        kept = blocks[0].value if len(blocks) == 1 else None
        for batch in batches:
            for s in range(0, batch.num_rows, RUN if kept is None else 1):
                part = batch.slice(s, RUN if kept is None else 1)
                shards = [(p, np.zeros(p.total, dtype=np.int64), [set() for _ in p.lengths]) for p in _shards(part)]
                for shared in blocks:
                    block = kept or shared.value
                    for shard, reach, items in shards:
                        for text, window in block.hits(shard, reach).tolist():
                            items[text].update(block.items[window])
                    if kept is None:
                        shared.forget()
                for i, found in enumerate(shards):
                    yield _result(part.column("rows").slice(i, 1).flatten(), part.column("ids").slice(i, 1).flatten(), *found)

    return run


def _result(rows, ids, shard: Postings, reach: np.ndarray, items: list[set]):
    start = np.flatnonzero(reach)
    text = np.searchsorted(shard.ends, start, side="right")
    place = start - (shard.ends - shard.lengths - 1)[text]
    end = place + reach[start]
    # A run goes on while a window begins before or where all earlier ones of its text end; shifted apart, texts never touch.
    shift = text * (shard.total + 2)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place + shift)[1:] > np.maximum.accumulate(end + shift)[:-1]
    first = np.flatnonzero(new)
    begins, ends = place[first], np.maximum.reduceat(end, first) if len(first) else first
    counts = np.bincount(text[first], minlength=len(shard.lengths))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (begins, ends)]
    return pa.record_batch([rows, ids, pa.array(shard.lengths), *lists, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [ROW, ID, "n_words", "starts", "ends", "items"])


def _blocks(bench: DataFrame, item_col: str, text_col: str, width: int, block: int):
    """The items in blocks of about `block` windows, each collected when its turn comes."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * block)))  # a window for every four characters, more than there are
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else items
        yield Windows([(r[0], r[1].encode()) for r in part.collect()], width)


def matches(index: DataFrame, bench: DataFrame, width: int = WIDTH, block: int = BLOCK, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(__row, __id, n_words, starts, ends, items) of every text of the index: the union of all hit words as intervals, and the items that hit."""
    shared = []
    for windows in _blocks(bench, item_col, item_text_col, width, block):
        shared.append(Shared(index.sparkSession, windows))
        shared[-1].forget()
    return index.mapInArrow(_find(shared), RESULT)


def contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The matches in docs, by an index that is built for them."""
    return matches(positional_index(docs, id_col, text_col), bench, width, block, item_col, item_text_col)


def hit_words():
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination_report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, bench, **options).withColumn("n_hit", hit_words())
    return found.select(F.col(ID).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = WIDTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a test window; columns are kept."""
    docs = settled(docs)
    hit = shared_table(contamination(docs, bench, width, block, id_col, text_col).where(F.size("starts") > 0).select(ROW))  # of known size, so broadcast only if small
    return docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias(ROW)).join(hit, ROW, "left_anti").select("doc.*")


def search(index: DataFrame, phrase: str, slop: int = 0) -> DataFrame:
    """(doc_id, start) of the places where the words of the phrase stand in order, with at most slop other words between neighbours.

    Only shards that hold all the terms are read in Python. Lists are intersected from the rarest on: what is reached from a
    member of the rarest list by steps of at most 1 + slop, forwards for later words and backwards for earlier ones.
    """
    words = words_of(phrase.encode()) if phrase else []
    out = "doc_id long, start long"
    if not words:
        return index.sparkSession.createDataFrame([], out)

    def run(batches):
        for batch in batches:
            for i, shard in enumerate(_shards(batch)):
                number = {w: n for n, w in enumerate(shard.terms)}
                lists = [shard.places[shard.begins[n] : shard.begins[n] + shard.sizes[n]] for n in map(number.__getitem__, words)]
                apart = [x + np.searchsorted(shard.ends, x, side="right") * (1 + slop) for x in lists]  # no step leads from text to text
                start = lists[0][np.isin(apart[0], _chains(apart, slop))]
                text = np.searchsorted(shard.ends, start, side="right")
                yield pa.record_batch([batch.column("ids").slice(i, 1).flatten().take(pa.array(text)), pa.array(start - (shard.ends - shard.lengths - 1)[text])], ["doc_id", "start"])

    holding = index
    for word in sorted(set(words)):
        holding = holding.where(F.array_contains("terms", F.lit(bytearray(word))))
    return holding.mapInArrow(run, out)


def _chains(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Members of the first list from which a chain through all lists exists, each next 1 to 1 + slop places on.

    From the rarest list the lists are cut, outwards on either side, to members that a chain may reach; then chains are
    followed back to the first list.
    """
    near = lambda x, y: np.searchsorted(y, x + 1 + slop, side="right") > np.searchsorted(y, x + 1)  # noqa: E731  x has a y after it
    after = lambda y, x: np.searchsorted(x, y - 1, side="right") > np.searchsorted(x, y - 1 - slop)  # noqa: E731  y has an x before it
    lists, rarest = list(lists), int(np.argmin([len(x) for x in lists]))
    for k in range(rarest + 1, len(lists)):
        lists[k] = lists[k][after(lists[k], lists[k - 1])]
    for k in range(rarest - 1, -1, -1):
        lists[k] = lists[k][near(lists[k], lists[k + 1])]
    for k in range(len(lists) - 2, -1, -1):
        lists[k] = lists[k][near(lists[k], lists[k + 1])]
    return lists[0]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
