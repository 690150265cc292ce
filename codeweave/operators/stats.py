"""Descriptions and comparisons of points: sums and ranks by Spark, tail areas on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..plans.linalg import col, dense_index


def mean_intervals(points: DataFrame, labels: Sequence[str], level: float = 0.95) -> dict[str, tuple[float, float]]:
    """t confidence intervals of the means."""
    row = points.agg(F.count("*"), *[x for d in labels for x in (F.avg(col(d)), F.stddev_samp(col(d)))]).first()
    n, out = row[0], {}
    for k, d in enumerate(labels):
        mean, sd = row[1 + 2 * k], row[2 + 2 * k]
        if n < 2:
            out[d] = (math.nan, math.nan)
            continue
        half = D.t_quantile((1 + level) / 2, n - 1) * sd / math.sqrt(n)
        out[d] = (mean - half, mean + half)
    return out


def outlier_intervals(points: DataFrame, labels: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Plus and minus a multiple of the interquartile range."""
    row = points.agg(*[F.percentile(col(d), F.array(F.lit(0.25), F.lit(0.75))) for d in labels]).first()
    return {d: (-factor * (q[1] - q[0]), factor * (q[1] - q[0])) for d, q in zip(labels, row)}


def tukey_fences(points: DataFrame, labels: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """The quartiles less and plus a multiple of the range between them."""
    row = points.agg(*[F.percentile(col(d), F.array(F.lit(0.25), F.lit(0.75))) for d in labels]).first()
    return {d: (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0])) for d, q in zip(labels, row)}


def moments(points: DataFrame, by: str, labels: Sequence[str]) -> DataFrame:
    """Count, mean, sample variance and median of each dimension for each group."""
    per = [x for d in labels for x in (F.avg(col(d)).alias(f"{d}_mean"), F.var_samp(col(d)).alias(f"{d}_var"), F.percentile(col(d), 0.5).alias(f"{d}_median"))]
    return points.groupBy(col(by)).agg(F.count("*").alias("n"), *per)


def average_ranks(points: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties averaged.

    Equal values are counted first, so that the ordered pass sees a row a distinct value.
    """
    value = points.groupBy(col(column).alias("__v")).agg(F.count("*").alias("__n"))
    value = dense_index(value, "__v", name="__i").withColumn("__block", F.floor(F.col("__i") / 65536))
    before = Window.partitionBy("__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    blocks = value.groupBy("__block").agg(F.sum("__n").alias("__t"))
    carried = blocks.select("__block", F.coalesce(F.sum("__t").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"))
    ranked = value.join(carried, "__block").withColumn(name, F.coalesce(F.sum("__n").over(before), F.lit(0)) + F.col("__c") + (F.col("__n") + 1) / 2)
    return points.join(ranked.select("__v", "__n", name), points[column] == F.col("__v")).drop("__v")


def cohens_d(points: DataFrame, column: str, one: Column, two: Column) -> float:
    """The difference of two means in pooled standard deviations, without sign."""
    x, y = F.when(one, col(column)), F.when(two, col(column))
    n1, m1, v1, n2, m2, v2 = points.agg(F.count(x), F.avg(x), F.var_samp(x), F.count(y), F.avg(y), F.var_samp(y)).first()
    pooled = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return abs(m1 - m2) / pooled if pooled else math.nan


#: Units of a group from which the normal approximation of U is taken.
EXACT_U = 50


def compare_groups(points: DataFrame, labels: Sequence[str], one: Column, two: Column) -> dict[str, dict[str, float]]:
    """Welch's t, Cohen's d, Mann-Whitney U (exact for groups of fewer than ``EXACT_U`` units without ties, else the normal approximation with ties and continuity), rank-biserial r and medians of two groups."""
    out = {}
    rows = points.select(*[col(d) for d in labels], F.when(one, 1).when(two, 2).alias("__g")).where("__g is not null")
    for d in labels:
        x, y = F.when(F.col("__g") == 1, col(d)), F.when(F.col("__g") == 2, col(d))
        ranked = average_ranks(rows.select(col(d).alias("__x"), "__g"), "__x")
        n1, m1, v1, q1, n2, m2, v2, q2 = rows.agg(F.count(x), F.avg(x), F.var_samp(x), F.percentile(x, 0.5), F.count(y), F.avg(y), F.var_samp(y), F.percentile(y, 0.5)).first()
        if n1 < 2 or n2 < 2:
            raise ValueError("a group has fewer than two units")
        rank_sum, ties = ranked.agg(F.sum(F.when(F.col("__g") == 1, F.col("rank"))), F.sum(F.col("__n") * F.col("__n") - 1.0)).first()
        error = v1 / n1 + v2 / n2
        t = (m1 - m2) / math.sqrt(error) if error else math.nan
        df = error**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) if error else math.nan
        u = rank_sum - n1 * (n1 + 1) / 2
        n = n1 + n2
        spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / spread if spread else 0.0
        # Few units without ties have an exact distribution.
        u_p = D.u_two_sided(u, n1, n2) if n1 < EXACT_U and n2 < EXACT_U and not ties else min(1.0, D.normal_two_sided(z))
        pooled = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n - 2))
        out[d] = {"n1": n1, "n2": n2, "mean1": m1, "mean2": m2, "sd1": math.sqrt(v1), "sd2": math.sqrt(v2), "median1": q1, "median2": q2, "t": t, "df": df, "p": D.t_two_sided(t, df), "d": abs(m1 - m2) / pooled if pooled else math.nan, "U": u, "U_p": u_p, "r": 2 * u / (n1 * n2) - 1}
    return out


def group(table: DataFrame, by: str | Column, columns: Sequence[str], method: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """Means (or another aggregate) of columns for each value of a column or expression."""
    kinds = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "sum": F.sum, "min": F.min, "max": F.max, "sd": F.stddev_samp, "var": F.var_samp}
    f = kinds[method] if isinstance(method, str) else method
    key = col(by) if isinstance(by, str) else by.alias("group")
    return table.groupBy(key).agg(*[f(col(c)).alias(c) for c in columns])


def subtraction(table: DataFrame, names: Sequence[str], one: Column, two: Column, multiplier: float = 1.0) -> DataFrame:
    """The mean network of a group less that of another, in one row."""
    return table.agg(*[((F.avg(F.when(one, col(n))) - F.avg(F.when(two, col(n)))) * multiplier).alias(n) for n in names])


# ----------------------------------------------------------------- correlations
def fit_correlation(points: DataFrame, centroids: DataFrame, labels: Sequence[str], by: Sequence[str], order: str, level: float = 0.95) -> dict[str, tuple[float, float, float]]:
    """Pearson's r (with Fisher's interval) between the differences of all pairs of points and those of their centroids.

    Sums over pairs follow from sums over units, so that no pair is made:
    with i a unit's index from 0, the differences of x sum to the sum of (n - 1 - 2i) x.
    """
    both = points.select(*by, order, *[col(d).alias(f"p_{d}") for d in labels]).join(centroids.select(*by, *[col(d).alias(f"c_{d}") for d in labels]), list(by))
    rows = dense_index(both, order, *by, name="__i")
    n = rows.count()
    lead = F.lit(float(n - 1)) - 2 * F.col("__i")
    per = []
    for d in labels:
        x, y = col(f"p_{d}"), col(f"c_{d}")
        per += [F.sum(lead * x), F.sum(lead * y), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)]
    values = rows.agg(*per).first()
    pairs, out = n * (n - 1) / 2, {}
    for k, d in enumerate(labels):
        dx, dy, sx, sy, xx, yy, xy = values[7 * k : 7 * k + 7]
        cov = n * xy - sx * sy - dx * dy / pairs
        vx, vy = n * xx - sx * sx - dx * dx / pairs, n * yy - sy * sy - dy * dy / pairs
        r = max(-1.0, min(1.0, cov / math.sqrt(vx * vy))) if vx > 0 and vy > 0 else math.nan
        half = D.normal_quantile((1 + level) / 2) / math.sqrt(pairs - 3) if pairs > 3 else math.nan
        z = math.atanh(r) if abs(r) < 1 else math.copysign(math.inf, r)
        out[d] = (r, math.tanh(z - half), math.tanh(z + half))
    return out


#: Units of which all pairs are made (12.5 million).
MOST_PAIRED = 5_000


def _pairs(points: DataFrame, other: DataFrame, labels: Sequence[str], by: Sequence[str], order: str) -> DataFrame:
    both = points.select(*by, order, *[col(d).alias(f"p_{d}") for d in labels]).join(other.select(*by, *[col(d).alias(f"c_{d}") for d in labels]), list(by))
    rows = dense_index(both, order, *by, name="__i").drop(*by, order)
    n = rows.count()
    if n > MOST_PAIRED:
        raise ValueError(f"{n} units have too many pairs to rank: the closed form fit_correlation and distance_correlation need none or a draw of them")
    left = rows.select([col(c).alias(c if c == "__i" else f"a_{c}") for c in rows.columns])
    right = rows.select([col(c).alias("__j" if c == "__i" else f"b_{c}") for c in rows.columns])
    return left.join(right, F.col("__i") < F.col("__j"))


def pair_correlations(points: DataFrame, centroids: DataFrame, labels: Sequence[str], by: Sequence[str], order: str) -> dict[str, tuple[float, float]]:
    """Pearson and Spearman over all pairs of units; ranks need the pairs themselves, so that more than ``MOST_PAIRED`` units are refused."""
    pairs, out = _pairs(points, centroids, labels, by, order).cache(), {}
    for d in labels:
        diff = pairs.select((col(f"a_p_{d}") - col(f"b_p_{d}")).alias("x"), (col(f"a_c_{d}") - col(f"b_c_{d}")).alias("y"))
        pearson = diff.agg(F.corr("x", "y")).first()[0]
        ranked = average_ranks(average_ranks(diff, "x", "rx").drop("__n"), "y", "ry")
        out[d] = (pearson, ranked.agg(F.corr("rx", "ry")).first()[0])
    pairs.unpersist()
    return out


def distance_correlation(one: DataFrame, two: DataFrame, labels: Sequence[str], by: Sequence[str], order: str, most: int = 100_000, seed: int = 1) -> float:
    """Pearson's r between the distances of pairs of units in two spaces: all pairs, or ``most`` drawn pairs if there are more."""
    both = one.select(*by, order, *[col(d).alias(f"p_{d}") for d in labels]).join(two.select(*by, *[col(d).alias(f"c_{d}") for d in labels]), list(by))
    rows = dense_index(both, order, *by, name="__i").drop(*by, order).cache()
    n = rows.count()
    names = [c for c in rows.columns if c != "__i"]
    left = rows.select(F.col("__i").alias("__a"), *[col(c).alias(f"a_{c}") for c in names])
    right = rows.select(F.col("__i").alias("__b"), *[col(c).alias(f"b_{c}") for c in names])
    if n * (n - 1) / 2 <= most:
        pairs = left.join(right, F.col("__a") < F.col("__b"))
    else:
        draw = rows.sparkSession.range(most).select((F.floor(F.rand(seed) * n)).alias("__a"), (F.floor(F.rand(seed + 1) * n)).alias("__b")).where("__a <> __b")
        pairs = draw.join(left, "__a").join(right, "__b")
    far = lambda s: F.sqrt(sum(((col(f"a_{s}_{d}") - col(f"b_{s}_{d}")) ** 2 for d in labels), F.lit(0.0)))
    out = pairs.agg(F.corr(far("p"), far("c"))).first()[0]
    rows.unpersist()
    return math.nan if out is None else out
