"""The whole analysis in one call, with the groups to compare resolved from what the data hold."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import FIRST, Model
from .operators.accumulate import accumulate, unit_metadata
from .operators.fit import fit
from .operators.rotate import group_pair
from .operators.stats import compare_groups
from .plans.linalg import col


@dataclass
class Analysis:
    model: Model
    groups: list
    comparison: dict | None = None


def resolve_groups(values: Sequence, groups: Sequence | None) -> list:
    """The two groups to compare, or none: ``values`` are those of the grouping column in order of appearance."""
    if groups is None:
        if len(values) < 2:
            warnings.warn("the grouping column has one value; no groups are compared", stacklevel=2)
            return []
        return list(values[:2])
    unknown = [g for g in groups if g not in values]
    if unknown:
        raise ValueError(f"unknown group {unknown[0]!r}")
    if len(groups) > 2:
        warnings.warn("only the first two groups are compared", stacklevel=2)
    return list(groups[:2]) if len(groups) > 1 else []


def analyse(df: DataFrame, units: Sequence[str], conversation: Sequence[str], codes: Sequence[str], order_by: Sequence[str], group_by: str | None = None, groups: Sequence | None = None, tests: bool = False, dims: int = 2, **options) -> Analysis:
    """Accumulate and fit; with two groups the first axis goes through their means, without it is that of the SVD."""
    acc = accumulate(df, units, conversation, codes, order_by, **options)
    chosen: list = []
    if group_by is not None:
        acc.metadata = unit_metadata(df, units, order_by, [group_by], constant=False)
        extra = acc.counts.select("ENA_UNIT", FIRST).join(acc.metadata.select("ENA_UNIT", col(group_by)), "ENA_UNIT")
        first = extra.groupBy(col(group_by)).agg(F.min(FIRST).alias("f"))
        # The groups asked for are looked up, and else the first two taken, so that the values need not be gathered.
        found = first.where(col(group_by).isin(list(groups))) if groups is not None else first.orderBy("f").limit(2)
        chosen = resolve_groups([r[0] for r in found.orderBy("f").collect()], groups)
    if not chosen:
        return Analysis(fit(acc, dims), [])
    pair = group_pair(group_by, *chosen)
    model = fit(acc, dims, "means", {"pairs": [pair]})
    return Analysis(model, chosen, compare_groups(model.points, model.dimensions, *pair) if tests else None)


def product(table: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The product of dimension columns of each row, as ``product``."""
    out = F.lit(1.0)
    for d in labels:
        out = out * col(d)
    return table.withColumn("product", out)
