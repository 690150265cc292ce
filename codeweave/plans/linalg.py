"""Small matrices from large tables: sums of products by Spark, decompositions by the driver.

Only k x k, k x m and k numbers come to the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import durable

#: Up to so many sums of products are expressions of one aggregation; more are summed by blocks of rows.
EXPRESSIONS = 1500


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def sums(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Rows and column sums."""
    row = df.agg(F.count("*"), *[F.sum(col(c)) for c in columns]).first()
    return row[0], np.array([x or 0.0 for x in row[1:]], float)


def cross(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> np.ndarray:
    """left' right summed over rows; left' left if ``right`` is None."""
    same = right is None
    right = left if same else right
    pairs = [(i, j) for i in range(len(left)) for j in range(i if same else 0, len(right))]
    if not pairs:
        return np.zeros((len(left), len(right)))
    if len(pairs) <= EXPRESSIONS:
        row = df.agg(*[F.sum(col(left[i]) * col(right[j])) for i, j in pairs]).first()
        values = [x or 0.0 for x in row]
    else:
        names = list(dict.fromkeys([*left, *right]))

        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(left), len(right)))
            for b in batches:
                total += b[list(left)].to_numpy(float).T @ b[list(right)].to_numpy(float)
            at = np.nonzero(total)
            yield pd.DataFrame({"i": at[0], "j": at[1], "s": total[at]})

        parts = df.select(*[col(c) for c in names]).mapInPandas(block, "i long, j long, s double")
        out = np.zeros((len(left), len(right)))
        for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            out[r.i, r.j] = r.s
        return out
    out = np.zeros((len(left), len(right)))
    for (i, j), v in zip(pairs, values):
        out[i, j] = v
        if same:
            out[j, i] = v
    return out


def centered_gram(df: DataFrame, columns: Sequence[str], center: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and (V - center)'(V - center), in one pass; the center is the mean by default."""
    one = "__one"
    both = cross(df.withColumn(one, F.lit(1.0)), [*columns, one])
    n, total, gram = int(round(both[-1, -1])), both[-1, :-1], both[:-1, :-1]
    mean = total / max(n, 1)
    at = mean if center is None else center
    return n, mean, gram - np.outer(total, at) - np.outer(at, total) + n * np.outer(at, at)


def eigen(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors, largest first; each vector's largest loading is positive (the first on ties)."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    size = np.abs(vectors)
    top = np.argmax(size >= size.max(0, keepdims=True) - 1e-9, axis=0)
    sign = np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors * sign


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a symmetric system; least squares if it is singular."""
    if np.linalg.cond(a) < 1e12:
        return np.linalg.solve(a, b)
    return np.linalg.lstsq(a, b, rcond=1e-10)[0]


def dot(columns: Sequence[str], weights: Sequence[float]):
    """The sum of columns times numbers, as an expression; zeros are left out."""
    terms = [col(c) * F.lit(float(w)) for c, w in zip(columns, weights) if w != 0]
    out = F.lit(0.0)
    for k, t in enumerate(terms):
        out = t if not k else out + t
    return out


def dense_index(df: DataFrame, *order, name: str = "index") -> DataFrame:
    """A number from 0 in the given order: ranges are sorted by themselves and shifted by the counts before them.

    The sorted ranges are checkpointed, as ranges drawn anew could differ.
    """
    part, row = "__part", "__row"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    marked = durable(sorted_.withColumn(row, F.monotonically_increasing_id())).withColumn(part, F.shiftright(row, 33))
    counts = sorted(marked.groupBy(part).count().collect(), key=lambda r: r[0])
    shift, pairs = 0, []
    for r in counts:
        pairs += [F.lit(r[0]), F.lit(shift)]
        shift += r[1]
    offset = F.create_map(*pairs)[F.col(part)] if pairs else F.lit(0)
    return marked.withColumn(name, (F.col(row) - F.shiftleft(F.col(part), 33) + offset).cast("long")).drop(part, row)
