"""From an accumulation to a model: normalise, center, rotate, project, place the codes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..functions import layout as L
from ..model import STEP, Accumulation, Model, RotationSet
from ..plans.linalg import col
from . import nodes as N
from . import normalize as Z
from .rotate import Rotation, Space, rotate

NORMS: dict[str, Callable] = {"sphere": Z.sphere_norm, "skip_sphere": Z.skip_sphere_norm, "none": lambda df, names: df}


def fit(
    acc: Accumulation,
    dims: int = 2,
    rotation: str | np.ndarray | Callable[[Space], Rotation] = "svd",
    rotation_options: dict | None = None,
    norm: str | Callable[[DataFrame, list[str]], DataFrame] = "sphere",
    exclude_zero: bool = True,
    rotation_set: RotationSet | None = None,
    node_positions: Callable | None = None,
    self_weight: float = 2.0,
    center_to_origin: bool = False,
    cache: bool = True,
) -> Model:
    """A model.  With ``rotation_set`` the networks are centered and rotated as those of another model.

    The table of units is cached, as several small aggregations read it; rows never come to the driver.
    """
    names, codes, directed = acc.names, acc.codes, acc.layout == "ordered"
    counts = acc.counts.cache() if cache else acc.counts
    weights = (NORMS[norm] if isinstance(norm, str) else norm)(counts, names)
    if rotation_set is not None:
        if rotation_set.layout != acc.layout:
            raise ValueError("the rotation set is of another layout")
        source = rotation_set.for_codes(codes)
        vector = source.center
    else:
        source, vector = None, Z.center_vector(weights, names, exclude_zero)
    centered = Z.center(weights, names, vector, exclude_zero)
    if acc.metadata is not None:
        extra = [c for c in acc.metadata.columns if c not in centered.columns]
        centered = centered.join(acc.metadata.select("ENA_UNIT", *[col(c) for c in extra]), "ENA_UNIT", "left")
    if source is None:
        found = rotate(Space.of(centered, names), rotation, **(rotation_options or {}))
    else:
        found = Rotation(source.matrix, source.labels, source.eigenvalues)
    if not 1 <= dims <= found.matrix.shape[1]:
        raise ValueError(f"dims must be from 1 to {found.matrix.shape[1]}")
    every = Z.project(centered, names, found.matrix, found.labels)
    variance = Z.variance_shares(every, found.labels)[:dims]
    labels = found.labels[:dims]
    kept = [c for c in every.columns if c not in found.labels]
    points = every.select(*[col(c) for c in kept], *[col(d) for d in labels])
    pairs = L.index_pairs(len(codes), acc.layout)
    given = None if source is None or source.nodes is None else source.nodes[:, :dims]
    if node_positions is not None:
        place, centroids = node_positions(weights, points, names, pairs, codes, labels)
    else:
        place, centroids = N.optimize(weights, points, names, pairs, codes, labels, acc.by, directed, self_weight, exclude_zero, given)
    if center_to_origin:
        mean = Z.center_vector(points, labels, False)
        points, centroids, place = Z.shift(points, labels, mean), Z.shift(centroids, labels, mean), place - mean
    if STEP in acc.counts.columns and STEP not in points.columns:
        points = points.join(acc.counts.select(*acc.by, STEP), acc.by)
    kept_set = RotationSet(found.matrix, found.labels, codes, names, acc.layout, vector, found.eigenvalues, place, self_weight)
    return Model(acc, weights, centered, points, centroids, kept_set, variance, labels)


def project_in(model: Model, other: RotationSet, dims: int = 2) -> DataFrame:
    """Points of a model, as it is centered itself, in the rotation of another."""
    own = other.for_codes(model.accumulation.codes)
    return Z.project(model.centered, model.accumulation.names, own.matrix[:, :dims], own.labels[:dims])


def move_nodes(model: Model, dx: int = 0, dy: int = 1, mode: str = "equal") -> Model:
    """The model with its nodes on the unit circle and centroids to match."""
    r, acc = model.rotation, model.accumulation
    moved = N.unit_circle(r.nodes, dx, dy, mode)
    columns = [f"__c{k}" for k in range(len(acc.codes))]
    weights = N.node_weights(model.line_weights, acc.names, L.index_pairs(len(acc.codes), acc.layout), columns, r.self_weight)
    centroids = N.centroids(weights, columns, moved, model.dimensions)
    kept = RotationSet(r.matrix, r.labels, r.codes, r.names, r.layout, r.center, r.eigenvalues, moved, r.self_weight)
    return Model(acc, model.line_weights, model.centered, model.points, centroids, kept, model.variance, model.dimensions)
