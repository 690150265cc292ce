"""Places of the codes in the rotated space, and centroids of the networks.

A network's node weights are each connection's weight at both of its codes, halved for plain
undirected networks (a self-connection counts ``self_weight`` times), as shares of their sum.  Nodes X
solve (W'W) X = W'T for weights W and points T; both products are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import UNIT
from ..plans.linalg import col, cross, dot, solve
from .normalize import is_zero

FLOOR = 1e-4


def node_weights(table: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]], codes: Sequence[str], self_weight: float = 2.0, prefix: str = "") -> DataFrame:
    """The table with a column for each code in place of the connections."""
    share = 0.5 if len(pairs) == len(codes) * (len(codes) - 1) // 2 and all(i < j for i, j in pairs) else 1.0
    raw: list[list] = [[] for _ in codes]
    for n, (i, j) in zip(names, pairs):
        if i == j:
            raw[i].append((n, self_weight))
        else:
            raw[i].append((n, share))
            raw[j].append((n, share))
    columns = [dot([n for n, _ in r], [w for _, w in r]).alias(f"__w{k}") for k, r in enumerate(raw)]
    rest = [col(c) for c in table.columns if c not in set(names)]
    made = table.select(*rest, *columns)
    total = F.lit(0.0)
    for k in range(len(codes)):
        total = total + F.abs(F.col(f"__w{k}"))
    made = made.withColumn("__sum", F.greatest(total, F.lit(FLOOR)))
    return made.select(*rest, *[(F.col(f"__w{k}") / F.col("__sum")).alias(prefix + c) for k, c in enumerate(codes)])


def place_nodes(weights_and_points: DataFrame, weight_columns: Sequence[str], labels: Sequence[str]) -> np.ndarray:
    """Codes x dimensions by least squares."""
    w = cross(weights_and_points, weight_columns)
    return solve(w, cross(weights_and_points, weight_columns, labels))


def centroids(weights: DataFrame, weight_columns: Sequence[str], nodes: np.ndarray, labels: Sequence[str]) -> DataFrame:
    rest = [col(c) for c in weights.columns if c not in set(weight_columns)]
    return weights.select(*rest, *[dot(weight_columns, nodes[:, k]).alias(d) for k, d in enumerate(labels)])


def combine_pairs(table: DataFrame, columns: Sequence[str], index: str) -> DataFrame:
    """Rows of ground and response, each pair of neighbours in ``index`` (from 0), summed."""
    if table.count() % 2:
        raise ValueError("an odd number of rows cannot be paired")
    return table.groupBy(F.floor(F.col(index) / 2).alias(index)).agg(*[F.sum(col(c)).alias(c) for c in columns])


def optimize(line_weights: DataFrame, points: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]], codes: Sequence[str], labels: Sequence[str], by: Sequence[str] = (UNIT,), directed: bool = False, self_weight: float = 2.0, exclude_zero: bool = True, given: np.ndarray | None = None) -> tuple[np.ndarray, DataFrame]:
    """Nodes and centroids; empty networks take no part in the fit, and their centroid is 0."""
    columns = [f"__c{k}" for k in range(len(codes))]
    marked = line_weights.withColumn("__empty", is_zero(names))
    weights = node_weights(marked, names, pairs, columns, self_weight)
    if given is None:
        joined = weights.select(*by, "__empty", *columns).join(points.select(*by, *[col(d) for d in labels]), list(by))
        used = joined.where(~F.col("__empty")) if exclude_zero else joined
        given = place_nodes(used, columns, labels)
    made = centroids(weights, columns, given, labels)
    if exclude_zero:
        made = made.select(*[c for c in made.columns if c not in labels and c != "__empty"], *[F.when(F.col("__empty"), 0.0).otherwise(col(d)).alias(d) for d in labels])
        if not directed:
            row = made.join(marked.select(*by, "__empty"), list(by)).agg(F.max(F.col("__empty").cast("int")), *[F.avg(F.when(~F.col("__empty"), col(d))) for d in labels]).first()
            if row[0]:
                move = np.array([x or 0.0 for x in row[1:]])
                given = given - move
                made = made.join(marked.select(*by, "__empty"), list(by)).select(*[c for c in made.columns if c not in labels], *[F.when(F.col("__empty"), 0.0).otherwise(col(d) - float(m)).alias(d) for d, m in zip(labels, move)])
    else:
        made = made.drop("__empty")
    return given, made


def unit_circle(nodes: np.ndarray, dx: int = 0, dy: int = 1, mode: str = "equal") -> np.ndarray:
    """Nodes moved onto a circle in two dimensions; its radius is the longest node's length, nodes at the origin stay.

    ``radial`` keeps each node's direction.  ``equal`` spaces them evenly: they are taken in turn, those
    at or above the x axis from right to left, then those below from left to right (ties in their own order), and
    follow the longest node (the first on ties), which stays where it is.
    """
    if dx == dy or not (0 <= dx < nodes.shape[1] and 0 <= dy < nodes.shape[1]):
        raise ValueError("two different dimensions of the nodes are needed")
    if mode not in ("radial", "equal"):
        raise ValueError(f"unknown mode {mode!r}")
    z = nodes[:, dx] + 1j * nodes[:, dy]
    size = np.sqrt(nodes[:, dx] ** 2 + nodes[:, dy] ** 2)
    moving = np.nonzero(size)[0]
    out = nodes.astype(float).copy()
    if not len(moving):
        return out
    if mode == "radial":
        put = z[moving] * (size.max() / size[moving])
    else:
        below = z.imag[moving] < 0
        turn = moving[np.lexsort((np.where(below, z.real[moving], -z.real[moving]), below))]
        longest = int(np.argmax(size))
        turn = np.roll(turn, -int(np.nonzero(turn == longest)[0][0]))
        put = z[longest] * np.exp(2j * np.pi * np.arange(len(turn)) / len(turn))
        moving = turn
    out[moving, dx], out[moving, dy] = put.real, put.imag
    return out
