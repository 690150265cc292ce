"""Exact top-k inner products by a Voronoi join.

Vectors are made integers, floor(256 * x).  Inner products become distances by one more component: a candidate x gets
sqrt(M^2 - |x|^2), with M the largest norm, a query gets 0; then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so that the nearest
candidates are those with the highest products.

Candidates are grouped by their nearest pivots, of which there are about 4 sqrt(rows), ``MOST_PIVOTS`` at most.  A cell's
summary is its ``k`` + 1 smallest distances to the pivot (the pivot is a candidate too), and its candidates are cut by their distance to
the pivot into rings of about ``chunk`` rows, each with its least and largest distance.  For a query the k-th smallest of d(q, p_j) + d(x, p_j) over the
summaries is an upper bound U of its k-th distance.  It is sent to a ring of cell j only if

- d(q, p_j) lies within U of the ring's distances, and
- the query lies within U of the cell: (d(q, p_j)^2 - d(q, p_i)^2) / (2 d(p_i, p_j)), i its own cell, does not exceed U.

Candidates are never copied: each goes to its ring alone.  Rings that hold more than ``chunk`` rows, such as that of one
very common vector, are cut by hash.  A task streams the queries of a ring past its candidates, and holds no more than
a ring and a batch of queries; it returns candidates within a query's bound only, k at most.  Bounds are loosened by
a hair against rounding, and the scores themselves are exact integers.

How much is pruned depends on the vectors: clustered ones meet few rings, vectors without structure nearly all.

Nulls and edge cases: vectors that are null, empty, or hold a null or a non-finite component take no part, nor do rows
with a null id.  Vectors of unequal length are compared as if the shorter one ended in zeros.  Rows with equal ids are
all candidates, but never of a query with that id; rows with a query's id are a query each, with ranks of its own.
Ties go to the smaller id.  With fewer than k candidates all are returned.  Components beyond 2^40 in size are scored
in Python's integers and held to the range of a long.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import column, durable, spread

SCALE = 256.0
SLACK = 1e-9
MOST_PIVOTS = 4096


def sound_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` of the vectors that take part, as doubles."""
    x = column(vector_col).cast("array<double>")
    sound = column(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(sound).select(column(id_col).cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled up with zeros."""
    if isinstance(column, pd.Series):
        rows = column.tolist()
    else:
        sizes = np.diff(column.offsets.to_numpy())
        if len(sizes) and (sizes == sizes[0]).all() and (width is None or sizes[0] == width):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        rows = [np.asarray(r) for r in column.to_pylist()]
    width = max(map(len, rows), default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : min(len(r), width)] = r[:width]
    return out


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE)


class Cells:
    """Pivots in the space with one more component."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most = most
        self.pivots = self.lift(pivots, True)
        self.norms = (self.pivots**2).sum(1)
        self.between = self.far(self.pivots)

    def lift(self, v: np.ndarray, candidate: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(0, self.most**2 - (v**2).sum(1))) if candidate else np.zeros(len(v))
        return np.hstack([v, extra[:, None]])

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors to all pivots."""
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + self.norms - 2 * (x @ self.pivots.T)))

    def place(self, v: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each candidate and distance to its pivot."""
        cell, far = np.zeros(len(v), np.int64), np.zeros(len(v))
        for at in range(0, len(v), step):
            x = self.lift(v[at : at + step], True)
            cell[at : at + step] = near = self.far(x).argmin(1)
            far[at : at + step] = np.sqrt(((x - self.pivots[near]) ** 2).sum(1))
        return cell, far


class Rings:
    """What the driver knows of the cells: a row a ring, and the smallest distances of each cell."""

    def __init__(self, cells: Cells, k: int, cell: np.ndarray, least: np.ndarray, most: np.ndarray, rows: np.ndarray, low: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: int):
        self.cells, self.k = cells, k
        self.cell, self.least, self.most = cell, least, most
        self.low_cell, self.low_far, self.low_id = low
        self.pieces = np.maximum(1, -(-rows // chunk))
        self.first = np.cumsum(self.pieces) - self.pieces  # numbers of pieces
        # Squares of large numbers are differences here: the hair by which bounds are loosened grows with the largest norm.
        self.slack = 1e-6 * (1 + cells.most)

    def bound(self, far: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """U of queries, given their distances to the pivots."""
        upper = far[:, self.low_cell] + self.low_far
        upper[self.low_id[None, :] == ids[:, None]] = np.inf
        if upper.shape[1] < self.k:
            return np.full(len(far), np.inf)
        return np.partition(upper, self.k - 1, axis=1)[:, self.k - 1] + self.slack

    def needed(self, far: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) pairs that may hold one of the k nearest."""
        own = far.argmin(1)
        between = self.cells.between[own]
        gap = np.where(between > 0, (far**2 - far[np.arange(len(far)), own][:, None] ** 2) / np.where(between > 0, 2 * between, 1), 0)
        open_ = (gap <= bound[:, None] + self.slack)[:, self.cell]
        d = far[:, self.cell]
        return np.nonzero(open_ & (d >= self.least - bound[:, None] - self.slack) & (d <= self.most + bound[:, None] + self.slack))


def mix(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(32)) >> np.uint64(8)).astype(np.int64)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products, held to a long's range."""
    top = (np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0)) * q.shape[1]
    if top < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, me: int, floor: float, k: int) -> np.ndarray:
    """Places of the k highest scores of ids other than one's own, at least ``floor``; ties to the smaller id."""
    open_ = np.nonzero((ids != me) & (score >= floor))[0]
    if len(open_) > k:
        least = np.partition(score[open_], len(open_) - k)[len(open_) - k]
        open_ = open_[score[open_] >= least]
    return open_[np.lexsort((ids[open_], ~score[open_]))][:k]


def plan(own: DataFrame, k: int, pivots: int | None, chunk: int) -> tuple[Rings, DataFrame, int, int] | None:
    """Rings, the placed candidates (``vec_id``, ``v``, ``ring``), the width of the vectors and the count of rows; nothing for no vectors."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)) * SCALE
    largest, width, rows = own.agg(F.max(norm), F.max(F.size("v")), F.count("*")).first()
    if not rows:
        return None
    pivots = pivots or int(min(MOST_PIVOTS, max(16, 4 * rows**0.5)))
    first = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    most = (float(largest) + width**0.5) * (1 + SLACK)  # floor() moves a component by 1 at most
    cells = Cells(np.unique(integers(_matrix(pd.Series([r.v for r in first]), width)), axis=0), most)
    del first

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = integers(_matrix(b.column(1), width))
            cell, far = cells.place(v)
            yield pa.RecordBatch.from_arrays([b.column(0), _flat(v), pa.array(cell), pa.array(far)], ["vec_id", "v", "cell", "far"])

    data = durable(own.mapInArrow(placed, "vec_id long, v array<double>, cell long, far double"))
    sizes = data.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()
    cuts = np.zeros((len(cells.pivots), 3))  # least distance, width of a ring, number of rings
    for r in sizes:
        n = -(-r.n // chunk)
        cuts[r.cell] = r.least, (r.most - r.least) / n, n
    table = own.sparkSession.createDataFrame([(j, *map(float, c)) for j, c in enumerate(cuts)], "cell long, l double, w double, m double")
    ring = F.when(F.col("w") > 0, F.least(F.floor((F.col("far") - F.col("l")) / F.col("w")), F.col("m").cast("long") - 1)).otherwise(F.lit(0)).cast("long")
    data = data.join(F.broadcast(table), "cell").select("vec_id", "v", "cell", "far", ring.alias("ring"))
    rings = data.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).orderBy("cell", "ring").toArrow()
    low = _smallest(data.select("cell", "far", "vec_id"), k + 1)
    found = Rings(cells, k, *(rings.column(c).to_numpy() for c in ("cell", "least", "most", "n")), low, chunk)
    number = {}
    for i, (c, r) in enumerate(zip(rings.column("cell").to_pylist(), rings.column("ring").to_pylist())):
        number[c, r] = i
    keys = np.zeros((len(cells.pivots), int(max(1, cuts[:, 2].max()))), np.int64)
    for (c, r), i in number.items():
        keys[c, r] = i

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cell, ring = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            i = keys[cell, ring]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.first[i] + mix(ids) % found.pieces[i])], ["vec_id", "v", "key"])

    return found, data.select("vec_id", "v", "cell", "ring").mapInArrow(numbered, "vec_id long, v array<double>, key long"), width, rows


def _flat(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def routed(queries: DataFrame, rings: Rings, width: int) -> DataFrame:
    """A row for each query ``vec_id``, ``v``, ``row`` and piece of a ring that it needs: ``key``, ``row``, ``vec_id``, ``v``, and ``floor``, the least score of use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(256, 20_000_000 // (1 + len(rings.low_cell) + len(rings.cell))))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                v = integers(_matrix(b.column(1), width))
                x = rings.cells.lift(v, False)
                far = rings.cells.far(x)
                bound = rings.bound(far, b.column(0).to_numpy(zero_copy_only=False))
                square = (v**2).sum(1) + rings.cells.most**2
                floor = (square - bound**2) / 2
                floor = np.clip(floor - 1e-9 * (1 + square) - 1, -(2.0**63), 2.0**63 * (1 - 1e-9))
                who, ring = rings.needed(far, bound)
                pieces = rings.pieces[ring]
                who, ring = np.repeat(who, pieces), np.repeat(ring, pieces)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                for cut in range(0, len(who), 16_384):
                    part = slice(cut, cut + 16_384)
                    take = pa.array(who[part])
                    yield pa.RecordBatch.from_arrays([pa.array(rings.first[ring[part]] + piece[part]), b.column(2).take(take), b.column(0).take(take), _flat(v).take(take), pa.array(floor[who[part]])], ["key", "row", "vec_id", "v", "floor"])

    return queries.mapInArrow(run, "key long, row long, vec_id long, v array<double>, floor double")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int | None = None, chunk: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the queries, the rows whose id is divisible by ``every``.

    The pivots are the vectors with the smallest hashes of their ids.
    """
    spark = vectors.sparkSession
    own = sound_vectors(vectors, id_col, vector_col)
    made = plan(own, k, pivots, chunk)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rings, data, width, rows = made
    # Rows of equal ids are told apart by numbers, which hold since they are written.
    queries = durable(own.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.monotonically_increasing_id().alias("row")))
    right = routed(queries, rings, width)
    left = data.select("key", F.lit(-1).cast("long").alias("row"), "vec_id", "v", F.lit(0.0).alias("floor"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, x, held = None, None, None, []
        for whole in batches:
            keys = whole.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                b = whole.slice(a, z - a)
                if keys[a] != key:
                    key, ids, x, held = keys[a], None, None, []
                n = int((b.column(1).to_numpy(zero_copy_only=False) < 0).sum())  # candidates come first
                if n:
                    held.append((b.column(2).slice(0, n).to_numpy(zero_copy_only=False), _matrix(b.column(3).slice(0, n), width)))
                if n == b.num_rows:
                    continue
                if x is None:
                    if not held:
                        continue
                    ids, x, held = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), []
                for at in range(n, b.num_rows, 256):
                    part = b.slice(at, 256)
                    score = _scores(_matrix(part.column(3), width), x)
                    row, me, floor = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 4))
                    found = [best(score[r], ids, me[r], floor[r], k) for r in range(len(me))]
                    n_found = [len(f) for f in found]
                    flat = np.concatenate(found)
                    who = np.repeat(np.arange(len(me)), n_found)
                    yield pa.RecordBatch.from_arrays([pa.array(row[who]), pa.array(me[who]), pa.array(ids[flat]), pa.array(score[who, flat])], ["row", "query_id", "vec_id", "score"])

    n = spread(spark, rows, 500_000)
    both = left.unionByName(right).repartition(n, "key").sortWithinPartitions("key", "row")
    found = both.mapInArrow(solve, "row long, query_id long, vec_id long, score long")
    window = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, distance and id of the k candidates of each cell that are nearest to its pivot; tasks keep k a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        for b in batches:
            held = [np.concatenate((h, b.column(c).to_numpy(zero_copy_only=False))) for c, h in enumerate(held)]
            order = np.lexsort((held[2], held[1], held[0]))
            held = [h[order] for h in held]
            start = np.nonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))[0] if len(held[0]) else np.empty(0, np.int64)
            place = np.arange(len(held[0])) - np.repeat(start, np.diff(np.concatenate((start, [len(held[0])]))))
            held = [h[place < k] for h in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["cell", "far", "vec_id"])

    least = rows.mapInArrow(run, "cell long, far double, vec_id long")
    window = Window.partitionBy("cell").orderBy("far", "vec_id")
    got = least.withColumn("r", F.row_number().over(window)).where(F.col("r") <= k).toArrow()
    return got.column("cell").to_numpy(), got.column("far").to_numpy(), got.column("vec_id").to_numpy()
