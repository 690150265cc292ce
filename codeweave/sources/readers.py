"""Tables of coded lines from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**{"header": True, "inferSchema": True} | options).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_rows(spark: SparkSession, rows: list[dict], codes: list[str] = ()) -> DataFrame:
    """A table of row objects; codes that are text or booleans become numbers, and text that is none raises."""
    made = []
    for k, r in enumerate(rows):
        one = dict(r)
        for c in codes:
            try:
                one[c] = float(one[c])
            except (TypeError, ValueError):
                raise ValueError(f"row {k}: {c} is no number: {one.get(c)!r}") from None
        made.append(one)
    return spark.createDataFrame(made)
