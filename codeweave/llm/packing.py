"""Best-fit packing into bins of several permitted lengths.

Documents become pieces: those longer than the largest length are cut into pieces of that
length and a rest, no token is lost.  Pieces are dealt by a hash of their document to shards of about
``shard_tokens`` tokens, so that a shard fits a task however large the corpus is, and each
shard is packed by itself.

A shard places its pieces from the longest down.  A piece goes into the open bin whose room it fills
best.  If none has room, a bin is opened: for each permitted length the pieces still to come are
laid into it, longest first, and the length with the least cost for each token laid is
taken.  In the end each bin shrinks to the smallest permitted length that holds what it got.
The cost of a length is ``length + overhead + quadratic * length^2``; all lengths take part in
each choice.  Three cost views are tried for a shard (the cost itself, and the largest or the
smallest length first) and the cheapest result after downsizing is kept.

Nulls and edge cases: documents without tokens (null or empty text) take no place and give no
row.  A null id is a document of its own.  Rows with equal ids are packed as separate
documents; ``copy`` numbers them.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import column, durable, word_count

LENGTHS = (512, 1024, 2048, 4096)
SCHEMA = "shard long, bin long, capacity int, offset int, doc_id long, copy int, piece int, start long, length int"


def cost(length: float, overhead: float, quadratic: float) -> float:
    return length + overhead + quadratic * length * length


def _pack(sizes: list[int], lengths: tuple[int, ...], price: dict[int, float], choose: str) -> tuple[list[int], list[list[int]]]:
    """Bins, as lists of indices of ``sizes`` (longest first), and their capacities."""
    left = Counter(sizes)
    kinds = sorted(left)
    rooms: list[int] = []  # the rooms of open bins, sorted
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    room: list[int] = []
    opened: dict[tuple[int, int], int] = {}

    def filled(cap: int) -> int:
        """Tokens of the pieces to come that are laid into a bin of this length, longest first."""
        free, took = cap, Counter()
        at = bisect_left(kinds, free + 1) - 1
        while free > 0 and at >= 0:
            kind = kinds[at]
            n = min(free // kind, left[kind] - took[kind]) if kind <= free else 0
            if n > 0:
                took[kind] += n
                free -= n * kind
            at = min(at - 1, bisect_left(kinds, free + 1) - 1)
        return cap - free

    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            r = rooms.pop(at)
            b = by_room[r].pop()
        else:
            fits = [c for c in lengths if c >= size]
            if choose == "largest":
                r = fits[-1]
            elif choose == "smallest":
                r = fits[0]
            else:  # the choice is kept for pieces of this size while few have gone
                key = (size, i // 64)
                if key not in opened:
                    opened[key] = min(fits, key=lambda c: (price[c] / max(1, filled(c)), -c))
                r = opened[key]
            b = len(bins)
            bins.append([])
            room.append(r)
        bins[b].append(i)
        left[size] -= 1
        if not left[size]:
            del left[size]
            kinds.pop(bisect_left(kinds, size))
        r -= size
        if r:
            insort(rooms, r)
            by_room.setdefault(r, []).append(b)
    caps = [next(c for c in lengths if c >= sum(sizes[i] for i in own)) for own in bins]
    return caps, bins


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = 0.0, quadratic: float = 0.0) -> tuple[list[int], list[list[int]]]:
    """The cheapest packing of sizes in falling order, found by the three views of the cost."""
    lengths = tuple(sorted(lengths))
    price = {c: cost(c, overhead, quadratic) for c in lengths}
    tried = [_pack(sizes, lengths, price, how) for how in ("cost", "largest", "smallest")]
    return min(tried, key=lambda t: sum(price[c] for c in t[0]))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_tokens: int = 1 << 21, overhead: float = 0.0, quadratic: float = 0.0, id_col: str = "doc_id", text_col: str = "text", tokens=word_count) -> DataFrame:
    """A row for each piece: ``shard``, ``bin``, ``capacity``, ``offset`` in the bin, ``doc_id``, ``copy``, ``piece``, ``start`` in the document, ``length``."""
    longest = max(lengths)
    sized = docs.select(column(id_col).cast("long").alias("doc_id"), tokens(column(text_col)).cast("long").alias("n")).where("n > 0")
    # Equal rows are counted, not gathered.
    counted = durable(sized.groupBy("doc_id", "n").agg(F.count("*").cast("int").alias("copies")))
    total = counted.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    copies = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    pieces = copies.select("doc_id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))).alias("piece"))
    pieces = pieces.select(
        F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)).alias("shard"),
        "doc_id",
        "copy",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("length"),
    )

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        caps, bins = best_fit(rows["length"].tolist(), lengths, overhead, quadratic)
        order = np.concatenate([np.array(b, np.int64) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = rows.iloc[order].reset_index(drop=True)
        upto = out["length"].cumsum() - out["length"]
        first = upto[np.concatenate(([0], np.nonzero(np.diff(number))[0] + 1))].to_numpy()
        out["bin"], out["capacity"], out["offset"] = number, np.array(caps)[number], (upto - first[number]).to_numpy()
        return out[["shard", "bin", "capacity", "offset", "doc_id", "copy", "piece", "start", "length"]]

    return pieces.groupBy("shard").applyInPandas(shard, SCHEMA)
