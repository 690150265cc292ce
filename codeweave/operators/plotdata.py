"""Tables that a plot would be drawn from; nothing is drawn here."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..model import STEP, UNIT, Model
from ..plans.linalg import col
from . import stats as S


def axis_range(table: DataFrame, labels: Sequence[str]) -> float:
    """The largest distance of a coordinate from 0."""
    row = table.agg(*[F.max(F.abs(col(d))) for d in labels]).first()
    return max([0.0, *(x for x in row if x is not None)])


def scale_to_nodes(model: Model, dims: tuple[int, int] = (0, 1)) -> tuple[DataFrame, float]:
    """Points scaled to the range of the nodes, and the factor."""
    labels = [model.dimensions[k] for k in dims]
    most = axis_range(model.points, labels)
    factor = float(np.abs(model.rotation.nodes[:, list(dims)]).max()) / most if most else 1.0
    rest = [col(c) for c in model.points.columns if c not in labels]
    return model.points.select(*rest, *[(col(d) * factor).alias(d) for d in labels]), factor


def points(model: Model, dims: tuple[int, int] = (0, 1), group: str | None = None) -> DataFrame:
    x, y = (model.dimensions[k] for k in dims)
    return model.points.select(F.col(UNIT).alias("unit"), col(x).alias("x"), col(y).alias("y"), *([col(group).cast("string").alias("group")] if group else []))


def group_marks(model: Model, condition: Column, dims: tuple[int, int] = (0, 1), level: float = 0.95) -> dict[str, tuple[float, float, float, float, float]]:
    """For each dimension the mean, its interval and the outlier interval of a group."""
    part = model.points.where(condition)
    labels = [model.dimensions[k] for k in dims]
    row = part.agg(*[F.avg(col(d)) for d in labels]).first()
    ci, out = S.mean_intervals(part, labels, level), S.outlier_intervals(part, labels)
    return {d: (row[k], *ci[d], row[k] + out[d][0], row[k] + out[d][1]) for k, d in enumerate(labels)}


def network(model: Model, weights: dict[str, float], dims: tuple[int, int] = (0, 1), threshold: tuple[float, float] = (0.0, float("inf")), multiplier: float = 1.0) -> tuple[list[dict], list[dict]]:
    """Edges (heaviest first) and nodes of one network; weights outside the threshold are dropped or clamped, and widths are shares of the largest."""
    acc = model.accumulation
    place = {c: model.rotation.nodes[k, list(dims)] for k, c in enumerate(acc.codes)}
    size = dict.fromkeys(acc.codes, 0.0)
    edges = []
    for (a, b), name in zip(acc.key, acc.names):
        w = weights[name] * multiplier
        size[a] += abs(w)
        if a != b:
            size[b] += abs(w)
        if abs(w) <= threshold[0] or w == 0:
            continue
        edges.append({"from": a, "to": b, "weight": float(np.sign(w) * min(abs(w), threshold[1])), "x0": float(place[a][0]), "y0": float(place[a][1]), "x1": float(place[b][0]), "y1": float(place[b][1])})
    most = max([abs(e["weight"]) for e in edges], default=1.0)
    for e in edges:
        e["width"] = abs(e["weight"]) / most
    edges.sort(key=lambda e: -abs(e["weight"]))
    low, high = min(size.values()), max(size.values())
    nodes = [{"code": c, "x": float(place[c][0]), "y": float(place[c][1]), "size": (size[c] - low) / (high - low) if high > low else 1.0} for c in acc.codes]
    return edges, nodes


def mean_network(model: Model, condition: Column | None = None) -> dict[str, float]:
    table = model.line_weights if condition is None else model.line_weights.where(condition)
    row = table.agg(*[F.avg(col(n)) for n in model.accumulation.names]).first()
    return dict(zip(model.accumulation.names, row))


def subtraction_network(model: Model, one: Column, two: Column, multiplier: float = 1.0) -> dict[str, float]:
    row = S.subtraction(model.line_weights, model.accumulation.names, one, two, multiplier).first()
    return dict(zip(model.accumulation.names, row))


def trajectory(model: Model, dims: tuple[int, int] = (0, 1)) -> DataFrame:
    """Points of each unit along its steps."""
    x, y = (model.dimensions[k] for k in dims)
    return model.points.select(F.col(UNIT).alias("unit"), F.col(STEP).alias("step"), col(x).alias("x"), col(y).alias("y"))


def trajectory_ends(steps: DataFrame) -> DataFrame:
    """The last step of each unit."""
    return steps.groupBy("unit").agg(F.max("step").alias("step"), F.max_by("x", "step").alias("x"), F.max_by("y", "step").alias("y"))


def smooth(steps: Sequence[float], values: Sequence[float], most: int = 3) -> np.ndarray:
    """Coefficients (highest power first) of the polynomial of degree up to ``most`` with the least leave-one-out error."""
    t, v = np.asarray(steps, float), np.asarray(values, float)
    best = None
    for degree in range(0, min(most, len(t) - 2) + 1):
        x = np.vander(t, degree + 1)
        hat = x @ np.linalg.pinv(x)
        error = (((v - hat @ v) / np.maximum(1 - np.diag(hat), 1e-9)) ** 2).mean()
        if best is None or error < best[0] - 1e-12:
            best = (error, np.polyfit(t, v, degree))
    return np.array([v.mean()]) if best is None else best[1]


def fill_forward(table: DataFrame, unit: str, step: str, values: Sequence[str], steps: DataFrame | None = None) -> DataFrame:
    """Every unit at every step: its latest values from strictly earlier steps or this one, and 0 before its first.

    The grid is units x distinct steps; it meets the values in one union and one Window operator.
    """
    steps = (table if steps is None else steps).select(col(step)).distinct()
    grid = table.select(col(unit)).distinct().crossJoin(steps).withColumn("__grid", F.lit(1))
    both = grid.unionByName(table.select(col(unit), col(step), *[col(v) for v in values]).withColumn("__grid", F.lit(0)), allowMissingColumns=True)
    frame = Window.partitionBy(col(unit)).orderBy(col(step), "__grid").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select(col(unit), col(step), "__grid", *[F.coalesce(F.last(col(v), ignorenulls=True).over(frame), F.lit(0.0)).alias(v) for v in values])
    return filled.where("__grid = 1").drop("__grid")


def frames(lines: DataFrame, names: Sequence[str], time: str, unit: str = UNIT) -> DataFrame:
    """Cumulative networks of each unit at each distinct time of its lines: a running sum, not a join of times with lines."""
    at = lines.groupBy(unit, col(time)).agg(*[F.sum(col(n)).alias(n) for n in names])
    running = Window.partitionBy(unit).orderBy(col(time)).rowsBetween(Window.unboundedPreceding, 0)
    return at.select(unit, col(time), *[F.sum(col(n)).over(running).alias(n) for n in names])


def movie(lines: DataFrame, names: Sequence[str], time: str, unit: str = UNIT) -> DataFrame:
    """Frames of all units at every time of any line."""
    return fill_forward(frames(lines, names, time, unit), unit, time, names)


def pairs_of(model: Model) -> list[tuple[int, int]]:
    return L.index_pairs(len(model.accumulation.codes), model.accumulation.layout)
