"""What the operators hand on: an accumulation, a fitted model, a rotation set."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .functions import layout as L

UNIT, CONVERSATION, FIRST, STEP = "ENA_UNIT", "ENA_CONV", "ENA_FIRST", "ENA_STEP"


@dataclass
class Accumulation:
    """``lines``: a row a line; ``counts``: a row a unit (or a unit and step) with the connection columns."""

    counts: DataFrame
    lines: DataFrame | None
    codes: list[str]
    units: list[str]
    conversation: list[str]
    layout: str = "unordered"
    by: list[str] = field(default_factory=lambda: [UNIT])
    parameters: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    self_counts: DataFrame | None = None
    misses: DataFrame | None = None
    metadata: DataFrame | None = None

    @property
    def names(self) -> list[str]:
        return L.pair_names(self.codes, self.layout)

    @property
    def key(self) -> list[tuple[str, str]]:
        return L.adjacency_key(self.codes, self.layout)


@dataclass
class RotationSet:
    """A rotation that other models can be projected with."""

    matrix: np.ndarray
    labels: list[str]
    codes: list[str]
    names: list[str]
    layout: str
    center: np.ndarray
    eigenvalues: np.ndarray
    nodes: np.ndarray | None = None
    self_weight: float = 2.0

    def save(self, path: str) -> None:
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        with open(path, "w") as f:
            json.dump(plain, f)

    @classmethod
    def load(cls, path: str) -> RotationSet:
        with open(path) as f:
            plain = json.load(f)
        for k in ("matrix", "center", "eigenvalues", "nodes"):
            plain[k] = None if plain[k] is None else np.array(plain[k], float)
        return cls(**plain)

    def for_codes(self, codes: list[str]) -> RotationSet:
        """The same set with its rows in the order of other codes; they must be the same codes."""
        if sorted(codes) != sorted(self.codes):
            raise ValueError("the codes of the rotation set differ from those of the model")
        key = L.adjacency_key(codes, self.layout)
        own = {pair: k for k, pair in enumerate(L.adjacency_key(self.codes, self.layout))}
        order = [own[a, b] if (a, b) in own else own[b, a] for a, b in key]
        nodes = None if self.nodes is None else self.nodes[[self.codes.index(c) for c in codes]]
        return RotationSet(self.matrix[order], self.labels, list(codes), L.pair_names(codes, self.layout), self.layout, self.center[order], self.eigenvalues, nodes, self.self_weight)


@dataclass
class Model:
    """A fitted model; tables are lazy and share the key columns of the accumulation."""

    accumulation: Accumulation
    line_weights: DataFrame
    centered: DataFrame
    points: DataFrame
    centroids: DataFrame
    rotation: RotationSet
    variance: np.ndarray
    dimensions: list[str]

    @property
    def nodes(self) -> dict[str, np.ndarray]:
        return dict(zip(self.rotation.codes, self.rotation.nodes))

    def nodes_table(self, spark) -> DataFrame:
        rows = [(c, *map(float, self.rotation.nodes[k])) for k, c in enumerate(self.rotation.codes)]
        return spark.createDataFrame(rows, "code string, " + ", ".join(f"`{d}` double" for d in self.dimensions))

    def _one(self, table: DataFrame, unit: str):
        row = table.where(table[UNIT] == unit).first()
        if row is None:
            raise KeyError(f"no unit {unit!r}")
        return row

    def point(self, unit: str) -> np.ndarray:
        row = self._one(self.points, unit)
        return np.array([row[d] for d in self.dimensions])

    def centroid(self, unit: str) -> np.ndarray:
        row = self._one(self.centroids, unit)
        return np.array([row[d] for d in self.dimensions])

    def network(self, unit: str) -> dict[str, float]:
        row = self._one(self.line_weights, unit)
        return {n: row[n] for n in self.accumulation.names}

    def summary(self, correlations: bool = True) -> str:
        """Units, codes and connections, the variance and eigenvalue of each dimension, and how well points and centroids agree (Pearson's r)."""
        from .operators.stats import fit_correlation

        a = self.accumulation
        lines = [f"{self.points.count()} units, {len(a.codes)} codes, {len(a.names)} connections ({a.layout})"]
        found = fit_correlation(self.points, self.centroids, self.dimensions, a.by, FIRST) if correlations and FIRST in self.points.columns else {}
        for k, (d, v) in enumerate(zip(self.dimensions, self.variance)):
            value = self.rotation.eigenvalues[k] if k < len(self.rotation.eigenvalues) else float("nan")
            r = f", correlation {found[d][0]:.3f}" if d in found else ""
            lines.append(f"{d}: variance {v:.3f}, eigenvalue {value:.4g}{r}")
        return "\n".join(lines)
