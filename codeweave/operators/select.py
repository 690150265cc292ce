"""Lines behind a connection, and the search for codes that a model can do without."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..model import CONVERSATION, FIRST, UNIT, Accumulation
from ..plans.linalg import col
from .accumulate import INFINITE, composite, window_size


@dataclass
class ConnectionLines:
    """``matched``: lines of the units with any of the codes whose window has them all; ``unit_lines``: lines with any of the codes;
    ``removed``: those of them that failed; ``windows``: every line of the matched lines' windows, once; ``conversations``: those of the matched lines."""

    matched: DataFrame
    unit_lines: DataFrame
    removed: DataFrame
    windows: DataFrame
    conversations: DataFrame


def connection_lines(df: DataFrame, units: Sequence[str] | DataFrame | None, units_by: Sequence[str], codes: Sequence[str], conversation: Sequence[str], order_by: Sequence[str], window: float = 4, exclude: Sequence[str] = ()) -> ConnectionLines:
    """Lines of some units (names, a DataFrame of them, or all if None) that stand behind a connection of codes, within a back window."""
    window = window_size(window)
    rows = df.withColumn(UNIT, composite(units_by)).withColumn(CONVERSATION, composite(conversation))
    if exclude:
        rows = rows.where(~F.col(CONVERSATION).isin(list(exclude)))
    rows = rows.withColumn(FIRST, F.struct(*[col(c) for c in order_by]))
    mine = F.lit(True)
    if isinstance(units, DataFrame):
        wanted = units.select(col(units.columns[0]).cast("string").alias("__wanted")).distinct()
        rows = rows.join(wanted, F.col(UNIT) == F.col("__wanted"), "left").withColumn("__mine", F.col("__wanted").isNotNull()).drop("__wanted")
        mine = F.col("__mine")
    elif units is not None:
        mine = F.col(UNIT).isin(list(units))
    spec = Window.partitionBy(CONVERSATION).orderBy(FIRST)
    frame = spec.rowsBetween(Window.unboundedPreceding if window == INFINITE else -max(0, int(window) - 1), 0)
    any_code, all_codes = F.lit(False), F.lit(True)
    for c in codes:
        any_code = any_code | (col(c).cast("double") > 0)
        all_codes = all_codes & (F.sum(col(c).cast("double")).over(frame) > 0)
    marked = rows.withColumn("__any", mine & any_code).withColumn("__hit", F.col("__any") & all_codes)
    ahead = spec.rowsBetween(0, Window.unboundedFollowing if window == INFINITE else max(0, int(window) - 1))
    # A line lies in the window of a hit if a hit stands among the next lines; no join is needed.
    marked = marked.withColumn("__in", F.max(F.col("__hit").cast("int")).over(ahead) == 1)
    clean = lambda d: d.drop("__any", "__hit", "__in", "__mine", FIRST)
    hits = marked.where("__hit")
    return ConnectionLines(clean(hits), clean(marked.where("__any")), clean(marked.where("__any and not __hit")), clean(marked.where("__in")), hits.select(CONVERSATION).distinct())


# -------------------------------------------------------------------------- PRIA
@dataclass
class Reduction:
    removed: list[str]
    variance: float | None


def restrict(acc: Accumulation, codes: Sequence[str]) -> Accumulation:
    """The accumulation without the connections of other codes; the codes keep their order."""
    keep = [c for c in acc.codes if c in set(codes)]
    names = set(L.pair_names(keep, acc.layout))
    gone = [n for n in acc.names if n not in names]
    return replace(acc, codes=keep, counts=acc.counts.drop(*gone))


def _dense_fit(x: np.ndarray, pairs: list[tuple[int, int]], p: int, directed: bool, self_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Points, centroids and nodes on two dimensions, and the first one's share of the variance."""
    from ..plans.linalg import eigen, solve

    size = np.linalg.norm(x, axis=1, keepdims=True)
    full = size[:, 0] > 0
    y = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    z = np.where(full[:, None], y - y[full].mean(0), 0.0)
    _, axes = eigen(z.T @ z)
    every = z @ axes
    share = every.var(0, ddof=1)
    w = np.zeros((len(x), p))
    for k, (i, j) in enumerate(pairs):
        if i == j:
            w[:, i] += self_weight * y[:, k]
        else:
            w[:, i] += y[:, k]
            w[:, j] += y[:, k]
    w /= np.maximum(np.abs(w).sum(1, keepdims=True), 1e-4)
    nodes = solve(w[full].T @ w[full], w[full].T @ every[full, :2])
    return every[:, :2], w @ nodes, nodes, float(share[0] / share.sum()) if share.sum() else 0.0


def _pair_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's r over the differences of all pairs of rows, by sums."""
    n = len(a)
    lead = (n - 1 - 2 * np.arange(n))[:, None]
    pairs = n * (n - 1) / 2
    da, db = (lead * a).sum(0), (lead * b).sum(0)
    cov = n * (a * b).sum(0) - a.sum(0) * b.sum(0) - da * db / pairs
    va = n * (a * a).sum(0) - a.sum(0) ** 2 - da**2 / pairs
    vb = n * (b * b).sum(0) - b.sum(0) ** 2 - db**2 / pairs
    return cov / np.sqrt(np.maximum(va * vb, 1e-300))


def pria(acc: Accumulation, most: int = 3, threshold: float = 0.95, cells: int = 5_000_000, self_weight: float = 2.0) -> Reduction:
    """The largest set of codes (at most ``most``, three stay) without which the model keeps its fit and shape on two dimensions.

    Both the ratio of fits and the correlations of points and nodes with the full model's must reach the threshold;
    among sets of one size the one with the larger first variance wins.  Lines are counted once; the search works on the
    table of units, which comes to the driver only if it has at most ``cells`` cells.
    """
    p = len(acc.codes)
    most = min(most, p - 3)
    if most < 1:
        return Reduction([], None)
    n = acc.counts.count()
    if n * len(acc.names) > cells:
        raise ValueError("the table of units is too large for the search on the driver")
    table = acc.counts.orderBy(FIRST).select(*[col(c) for c in acc.names]).toPandas().to_numpy(float)
    pairs = L.index_pairs(p, acc.layout)
    directed = acc.layout == "ordered"

    def without(gone: tuple[int, ...]):
        keep = [k for k in range(p) if k not in gone]
        place = {c: k for k, c in enumerate(keep)}
        cols = [k for k, (i, j) in enumerate(pairs) if i in place and j in place]
        return _dense_fit(table[:, cols], [(place[pairs[k][0]], place[pairs[k][1]]) for k in cols], len(keep), directed, self_weight), keep

    (points, centers, nodes, _), _ = without(())
    fit_all = _pair_correlation(points, centers)
    best: tuple[int, float, tuple[int, ...]] = (0, -np.inf, ())
    for k in range(1, most + 1):
        for gone in combinations(range(p), k):
            (pts, cen, nod, share), keep = without(gone)
            ratio = _pair_correlation(pts, cen) / fit_all
            if not (ratio >= threshold).all():
                continue
            same, shape = _pair_correlation(points, pts), _pair_correlation(nodes[keep], nod)
            sign = np.where(same < 0, -1.0, 1.0)
            if min((same * sign).min(), (shape * sign).min()) < threshold:
                continue
            if k > best[0] or share > best[1]:
                best = (k, share, gone)
    return Reduction([acc.codes[i] for i in best[2]], None if best[0] == 0 else best[1])
