"""SimHash near-duplicate groups by anchor-point covering.

A fingerprint has 64 bits.  Its bits are cut into ``blocks`` blocks, so that
two fingerprints that differ in at most ``max_bits`` bits differ in at most
``max_bits // blocks`` (held at 1 here) bits of some block.  The anchors of a
block are the words of a covering code: a perfect Hamming code of length 31 or
15 on the block's low bits, with every value of the bits left over.  Its
covering radius is 1, so that each fingerprint has one home anchor within
distance 1.  A fingerprint is copied to every anchor within radius + threshold
= 2 that can be the home of one linked to it, and each anchor compares its
homes with its guests.  By the triangle inequality no link is lost.

Fingerprints, not documents, are copied and compared, so that a group of exact
copies counts once however large it is.  The copies are sorted by anchor and
streamed: a task holds ``HOLD`` rows, or those of one anchor.  It emits a
spanning forest of the links that it found (at most one edge a fingerprint)
and never the pairs themselves; the components are then found by star
contraction over DataFrames.  Fingerprints of many documents are given their
component by broadcast, the others by shuffle.

Nulls and edge cases: a null text or one without a word has fingerprint 0,
which links like any other.  Null ids take part in links but not in the
smallest id; a group without any id has a null ``component_id``.  Repeated rows
are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import durable, hot_join, spread, words_of

SEED = 42
#: Rows of sorted copies that are compared at once.
HOLD = 1 << 18
#: Odd multipliers that turn one shingle hash into independent 64-bit lanes.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(words: list[bytes], size: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by spaces; fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if size == 1:
        parts = words
    elif len(words) <= size:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        parts = [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    if distinct:
        parts = set(parts)
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def majority_bits(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """64 bits, each 1 if set in over half of the hashes; worked in blocks, so that memory is bounded."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[at : at + block]).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3, distinct: bool = False) -> int:
    """The 64-bit SimHash of a whole text, its A-Z lower-cased."""
    return majority_bits(shingle_hashes([w.lower() for w in words_of(text)], size, distinct))


def fingerprints(docs: DataFrame, size: int = 3, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(text.as_py(), size, distinct) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


# --------------------------------------------------------------------- anchors
def _hamming(length: int) -> tuple[list[int], np.ndarray]:
    """Parity masks of the Hamming code of this length, and by syndrome the flips to the codewords within distance 2 (0 padded by the first)."""
    r = length.bit_length()
    masks = [sum(1 << (p - 1) for p in range(1, length + 1) if p >> k & 1) for k in range(r)]
    flips = np.zeros((length + 1, 1 + (length - 1) // 2), np.uint64)
    for s in range(1, length + 1):
        pairs = [(i, i ^ s) for i in range(1, length + 1) if i < i ^ s]
        flips[s] = [1 << (s - 1)] + [1 << (i - 1) | 1 << (j - 1) for i, j in pairs]
    return masks, flips


def blocks_of(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of the 64 bits."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def anchors(fps: np.ndarray, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, keys, home) for the anchors of each fingerprint: its home in each block, then those it visits."""
    for b, (shift, width) in enumerate(blocks_of(blocks)):
        length = 31 if width >= 31 else 15
        masks, flips = _hamming(length)
        x = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        syndrome = np.zeros(len(x), np.int64)
        for k, mask in enumerate(masks):
            syndrome |= (np.bitwise_count(x & np.uint64(mask)) & 1).astype(np.int64) << k
        tag = np.uint64(b << 40)
        home = x ^ flips[syndrome, 0]
        rows = np.arange(len(x))
        yield rows, home | tag, True
        off = np.nonzero(syndrome)[0]
        near = x[off, None] ^ flips[syndrome[off], 1:]
        yield np.repeat(off, near.shape[1]), near.ravel() | tag, False
        for p in range(length, width):  # the bits left over: one of them may differ
            yield rows, (home ^ np.uint64(1 << p)) | tag, False


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges, each node hung on the smallest of its tree."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))
    for u, v in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        if u != v:
            parent[max(u, v)] = min(u, v)
    for k in range(len(parent)):  # a parent is never larger than its child
        parent[k] = parent[parent[k]]
    root = np.array(parent, np.int64)
    keep = root != np.arange(len(root))
    return nodes[keep], nodes[root[keep]]


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole anchors, whose rows are sorted by key; ``step`` bounds the pairs held at once."""
    change = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.nonzero(change)[0]
    size = np.diff(np.concatenate((start, [len(key)])))
    group = np.cumsum(change) - 1
    mine = np.nonzero(home & (size[group] > 1))[0]
    mates = size[group[mine]]
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    upto = np.cumsum(mates)
    at = 0
    while at < len(mine):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + step)))
        one = np.repeat(mine[at:end], mates[at:end])
        two = np.arange(len(one)) - np.repeat(upto[at:end] - mates[at:end] - done, mates[at:end]) + start[group[one]]
        near = (np.bitwise_count(fp[one] ^ fp[two]) <= max_bits) & (fp[one] != fp[two])
        if near.any():
            a, b = _forest(fp[one[near]].view(np.int64), fp[two[near]].view(np.int64))
            found_a.append(a)
            found_b.append(b)
        at = end
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return _forest(a, b) if len(a) else (a, b)


def links(classes: DataFrame, max_bits: int = 2, blocks: int = 2, hold: int = HOLD) -> DataFrame:
    """Edges ``a``, ``b`` between linked fingerprints ``fp`` (distinct ones) that span the groups of linked ones."""
    if max_bits // blocks > 1:
        raise ValueError("a block may differ in one bit at most: take more blocks")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for rows, keys, home in anchors(fps, blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(rows), home)), batch.column(0).take(pa.array(rows))], ["anchor", "home", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _compare(rows[0], rows[2].view(np.uint64), rows[1], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        n = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= hold:
                rows = [np.concatenate(c) for c in zip(*held)]
                last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
                if last:
                    yield solve([x[:last] for x in rows])
                held, n = [[x[last:] for x in rows]], 0
        if held:
            yield solve([np.concatenate(c) for c in zip(*held)])

    copies = classes.select("fp").mapInArrow(replicate, "anchor long, home boolean, fp long")
    n = spread(classes.sparkSession, classes.count() * 31, 4_000_000)
    return copies.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


# ------------------------------------------------------------------ components
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for the nodes of edges ``a``, ``b``.

    Large-star and small-star contraction in turn (Kiveris et al. 2014), by
    joins and aggregations that combine on the map side; each round is
    checkpointed.  The count of rounds grows with the logarithm of the nodes.
    """
    star = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(rounds):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        star = durable(small.select("e.u", "e.v").where("u <> v").distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2, blocks: int = 2, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp``, ``component_id`` (the smallest id of its group)."""
    marked = durable(fingerprints(docs, size, distinct, id_col, text_col))
    classes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(links(classes, max_bits, blocks)).select(F.col("node").alias("fp"), "root")
    placed = durable(classes.join(roots, "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("group")))
    named = durable(placed.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    labelled = durable(hot_join(placed, named, "group", "classes").select("fp", "component_id", "rows"))
    return hot_join(marked, labelled, "fp", "rows").select("doc_id", "fp", "component_id")
