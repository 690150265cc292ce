"""Weights of the connections of a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Weight = str | Callable[[Column], Column]
MODELS: dict[str, Callable[[Column], Column]] = {
    "binary": lambda x: F.when(x > 0, 1.0).otherwise(0.0),
    "product": lambda x: x,
    "sqrt": F.sqrt,
    "log1p": F.log1p,
    "log": F.log1p,
}


def weight_function(weight: Weight, ordered: bool = False) -> Callable[[Column], Column]:
    """The function of a weight model; directed counts stay raw under ``binary``."""
    if callable(weight):
        return weight
    if weight not in MODELS:
        raise ValueError(f"unknown weight model {weight!r}: take one of {', '.join(MODELS)} or a function")
    return MODELS["product"] if ordered and weight == "binary" else MODELS[weight]
