"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of distinct value are cut into blocks; if two differ in at most 4 bits, then of b blocks at least b - 4 are
equal, so rows meet under some choice of b - 4 equal blocks. b follows the number of distinct fingerprints, so that
chance meetings stay few; any b finds every link. Each meeting is verified by the Hamming distance, and each bucket
gives a spanning forest of its links, not all of its pairs. A bucket above the limit isn't compared in one task: two
fingerprints within 4 bits share a point within 2 bits of both, so its members are joined on those points instead.
Components are contracted round by round over tables in the shared folder.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other. A null doc_id keeps
its row; the component's name is the smallest doc_id that isn't null, so components without a doc_id share the name null
and unlinked texts of one doc_id may share theirs. What tells components apart is their root, a fingerprint. Repeated
rows are returned as often as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, keyed, settled, shared_table

BITS = 64
NEAR = 4
BUCKET_LIMIT = 8192


def fingerprint(text: bytes, width: int = 4) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), len(words) - k + 1
    for s in range(0, n, 20_000):
        e = min(n, s + 20_000)
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[s:e].tolist(), ends[s + k - 1 : e + k - 1].tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column(TEXT).cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.record_batch([batch.column(ROW), batch.column(ID), pa.array(found.view(np.int64))], [ROW, ID, "fp"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """(__row, __id, fp) of the rows of keyed(); fp is the fingerprint as a signed long."""
    return rows.select(ROW, ID, TEXT).mapInArrow(_fingerprints, f"{ROW} long, {ID} long, fp long")


def block_masks(blocks: int, near: int = NEAR) -> list[int]:
    """Masks of every choice of blocks - near blocks, as signed longs."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(chosen)) for chosen in combinations(parts, blocks - near)]


def blocks_for(distinct: int) -> int:
    """As few blocks as keep the chance meetings of a fingerprint at about eight or fewer."""
    for blocks in range(6, 12):
        if len(block_masks(blocks)) * distinct <= 8 * 2 ** (BITS * (blocks - NEAR) // blocks):
            return blocks
    return 12


def forest(fps: np.ndarray) -> tuple[list, list]:
    """Links of a bucket's fingerprints that connect what all of its links connect."""
    left, right, rest = [], [], np.sort(fps)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            hit_by, hit = np.full(len(rest), -1), np.zeros(len(rest), dtype=bool)
            for s in range(0, len(front), 256):
                near = np.bitwise_count(front[s : s + 256, None] ^ rest[None]) <= NEAR
                fresh = near.any(0) & ~hit
                hit_by[fresh] = s + near[:, fresh].argmax(0)
                hit |= fresh
            left.append(front[hit_by[hit]])
            right.append(rest[hit])
            front, rest = rest[hit], rest[~hit]
    return left, right


def _links(limit):
    """Sorted rows (choice, part, fp) to links (a, b); of a bucket above the limit, all its rows, with b null."""

    def run(batches):
        held, last, over = [], None, False

        def close(parts):
            fps = np.unique(np.concatenate(parts).view(np.uint64)) if len(parts) > 1 else parts[0].view(np.uint64)
            return forest(fps) if len(fps) > 1 else ([], [])

        def batch_of(left, right):
            a = np.concatenate(left).view(np.int64)
            return pa.record_batch([pa.array(a), pa.array(np.concatenate(right).view(np.int64))], ["a", "b"])

        def spilled(parts):
            a = np.concatenate(parts)
            return pa.record_batch([pa.array(a), pa.nulls(len(a), pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, p, fp = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("choice", "part", "fp"))
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (p[1:] != p[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(c)]])
            left, right = [], []
            for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                key, final = (c[s], p[s]), i == len(bounds) - 2
                if key != last:
                    if held and not over:
                        x, y = close(held)
                        left, right = left + x, right + y
                    held, last, over = [], key, False
                elif i:
                    continue
                if not final and e - s == 1 and not held and not over:
                    continue
                held.append(fp[s:e].copy())
                if over or sum(map(len, held)) > limit:
                    over = True
                    yield spilled(held)
                    held = []
            if left:
                yield batch_of(left, right)
        if held and not over:
            left, right = close(held)
            if left:
                yield batch_of(left, right)

    return run


def links(distinct: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that connect the rows of distinct (fp) as all links of 4 bits or fewer do."""
    masks = block_masks(blocks_for(distinct.count()))
    meetings = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)))).alias("k")).select("k.choice", "k.part", "fp")
    found = shared_table(meetings.repartition("choice", "part").sortWithinPartitions("choice", "part").mapInArrow(_links(limit), "a long, b long"))
    out, over = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("fp"))
    if over.head(1):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        near = [0, *(signed(1 << i) for i in range(BITS)), *(signed(1 << i | 1 << j) for i, j in combinations(range(BITS), 2))]
        flips = distinct.sparkSession.createDataFrame([(near,)], "flips array<long>")
        points = over.distinct().join(F.broadcast(flips)).select("fp", F.explode("flips").alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        lowest = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("point", "low")
        out = out.unionByName(shared_table(points.join(lowest, "point").where("fp > low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): every round each node follows its smallest neighbour, and the roots' edges remain."""
    edges = shared_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots = None
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        again = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        parent = shared_table(parent.join(again, "root").select("node", F.col("next").alias("root")))
        if roots is None:
            roots = parent
        else:
            roots = shared_table(roots.join(parent.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        first, second = parent.select(F.col("node").alias("a"), F.col("root").alias("x")), parent.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = shared_table(edges.join(first, "a").join(second, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET_LIMIT) -> DataFrame:
    """(__row, __id, fp, root, component_id) of every row; rows of one component, and no others, have one root."""
    prints = shared_table(fingerprints(keyed(docs, id_col, text_col)))
    distinct = shared_table(prints.groupBy("fp").agg(F.min(ID).alias("least")))
    roots = components(links(distinct.select("fp"), limit))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "root", "component_id"), "fp")


def component_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs, id_col, text_col).select(F.col(ID).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id (of rows that repeat it, the first). Columns are kept."""
    docs = settled(docs)
    groups = near_duplicates(docs, id_col, text_col)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col(ID).isNull().alias("nil"), F.col(ID), F.col(ROW))).alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    return docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias(ROW)).join(best, ROW, "left_semi").select("doc.*")
