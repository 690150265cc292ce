"""Normalising, centering and projecting networks; each is one pass of expressions after one small aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.linalg import col, dot, sums


def _others(df: DataFrame, names: Sequence[str]):
    return [col(c) for c in df.columns if c not in set(names)]


def norm(names: Sequence[str]):
    total = F.lit(0.0)
    for k, n in enumerate(names):
        total = col(n) * col(n) if not k else total + col(n) * col(n)
    return F.sqrt(total)


def sphere_norm(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows divided by their length; a row of zeros stays."""
    with_norm = df.withColumn("__norm", norm(names))
    return with_norm.select(*_others(df, names), *[F.when(F.col("__norm") > 0, col(n) / F.col("__norm")).otherwise(0.0).alias(n) for n in names])


def skip_sphere_norm(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All rows divided by the largest length."""
    most = df.agg(F.max(norm(names))).first()[0] or 0.0
    return df.select(*_others(df, names), *[(col(n) / most if most > 0 else F.lit(0.0)).alias(n) for n in names])


def is_zero(names: Sequence[str]):
    out = F.lit(True)
    for n in names:
        out = out & (col(n) == 0)
    return out


def center_vector(df: DataFrame, names: Sequence[str], exclude_zero: bool = True) -> np.ndarray:
    """Column means, over rows that are not empty networks if ``exclude_zero``."""
    used = df.where(~is_zero(names)) if exclude_zero else df
    n, total = sums(used, names)
    if not n:
        raise ValueError("all networks are empty")
    return total / n


def center(df: DataFrame, names: Sequence[str], vector: np.ndarray, exclude_zero: bool = True) -> DataFrame:
    """Rows less a vector; empty networks stay at the origin if ``exclude_zero``."""
    marked = df.withColumn("__zero", is_zero(names)) if exclude_zero else df
    moved = lambda n, v: F.when(F.col("__zero"), 0.0).otherwise(col(n) - float(v)) if exclude_zero else col(n) - float(v)
    return marked.select(*_others(df, names), *[moved(n, v).alias(n) for n, v in zip(names, vector)])


def project(df: DataFrame, names: Sequence[str], matrix: np.ndarray, labels: Sequence[str]) -> DataFrame:
    """Points: rows times a matrix."""
    return df.select(*_others(df, names), *[dot(names, matrix[:, k]).alias(d) for k, d in enumerate(labels)])


def variance_shares(points: DataFrame, labels: Sequence[str]) -> np.ndarray:
    """Each dimension's share of the summed sample variances; equal shares if there is none."""
    row = points.agg(F.count("*"), *[F.var_samp(col(d)) for d in labels]).first()
    values = np.array([x if x is not None and x == x else 0.0 for x in row[1:]])
    if row[0] < 2 or values.sum() <= 0:
        return np.full(len(labels), 1 / len(labels))
    return values / values.sum()


def shift(df: DataFrame, labels: Sequence[str], vector: np.ndarray) -> DataFrame:
    return df.select(*_others(df, labels), *[(col(d) - float(v)).alias(d) for d, v in zip(labels, vector)])
