"""Estimators of a window's size: lagged cross-covariance, diversity of grounds, stability."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import UNIT
from ..plans.linalg import col
from .accumulate import accumulate, composite
from .fit import fit
from .stats import distance_correlation


# ------------------------------------------------------------------ ground types
def ground_types(df: DataFrame, codes: Sequence[str], conversation: Sequence[str], order_by: Sequence[str], most: int = 20) -> DataFrame:
    """``conversation``, ``window``, ``ground_type``, ``n``: how many lines have each set of codes in their last ``window`` lines.

    A set is coded in bits.  All windows are columns of one Window operator, and are unfolded before the count.
    """
    if len(codes) > 62:
        raise ValueError("at most 62 codes fit a ground type")
    spec = Window.partitionBy("conversation").orderBy("__o")
    rows = df.select(composite(conversation).alias("conversation"), F.struct(*[col(c) for c in order_by]).alias("__o"), *[(col(c).cast("double") > 0).cast("long").alias(f"__c{k}") for k, c in enumerate(codes)])
    kinds = []
    for w in range(1, most + 1):
        frame = spec.rowsBetween(-(w - 1), 0)
        bits = [F.max(f"__c{k}").over(frame) * F.lit(1 << k) for k in range(len(codes))]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        kinds.append(total.alias(f"__w{w}"))
    wide = rows.select("conversation", *kinds)
    long = wide.select("conversation", F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"__w{w}").alias("ground_type")) for w in range(1, most + 1)])).alias("e"))
    return long.groupBy("conversation", "e.window", "e.ground_type").agg(F.count("*").alias("n"))


def ground_entropy(counts: DataFrame, p: int, method: str = "mean", normalize: bool = True) -> DataFrame:
    """``window``, ``entropy``: Shannon entropy of ground types, as a mean over conversations, one weighted by lines, or pooled."""
    scale = math.log(2**p) if normalize else 1.0
    if method not in ("mean", "weighted", "pooled"):
        raise ValueError(f"unknown method {method!r}")
    if method == "pooled":
        counts = counts.groupBy("window", "ground_type").agg(F.sum("n").alias("n")).withColumn("conversation", F.lit(""))
    # entropy = log N - sum(n log n) / N, so that no second pass joins the totals back.
    per = counts.groupBy("window", "conversation").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = (F.log("N") - F.col("s") / F.col("N")) / scale
    if method == "weighted":
        return per.groupBy("window").agg((F.sum(entropy * F.col("N")) / F.sum("N")).alias("entropy"))
    return per.groupBy("window").agg(F.avg(entropy).alias("entropy"))


def ground_curves(counts: DataFrame, p: int, methods: Sequence[str] = ("mean", "weighted", "pooled"), normalize: bool = True) -> DataFrame:
    out = None
    for m in methods:
        one = ground_entropy(counts, p, m, normalize).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def ground_peak(curve: DataFrame) -> DataFrame:
    """The row of the largest entropy, the smallest window on ties."""
    return curve.orderBy(F.col("entropy").desc(), "window").limit(1)


def ground_diversity_window(df: DataFrame, codes: Sequence[str], conversation: Sequence[str], order_by: Sequence[str], most: int = 20) -> int:
    return ground_peak(ground_entropy(ground_types(df, codes, conversation, order_by, most), len(codes))).first()["window"]


# ---------------------------------------------------- lagged cross-covariance
@dataclass
class Lags:
    """The curve of corrected norms by lag, and the window read from it."""

    window: int
    peak_lag: int
    lags: list[int]
    signed: list[float]


def lag_sums(df: DataFrame, codes: Sequence[str], conversation: Sequence[str], order_by: Sequence[str], most: int = 20) -> DataFrame:
    """Sums of products between each line and the one ``lag`` lines before it, by conversation and lag.

    Both ends of a lag stand in one row by lag(), one Window operator for all; nothing is joined.
    """
    p = len(codes)
    spec = Window.partitionBy("conversation").orderBy("__o")
    rows = df.select(composite(conversation).alias("conversation"), F.struct(*[col(c) for c in order_by]).alias("__o"), F.array(*[col(c).cast("double") for c in codes]).alias("a"))
    wide = rows.select("conversation", "a", *[F.lag("a", lag).over(spec).alias(f"__l{lag}") for lag in range(0, most + 1)])
    long = wide.select("conversation", "a", F.posexplode(F.array(*[F.col(f"__l{lag}") for lag in range(0, most + 1)])).alias("lag", "b")).where("b is not null")
    a, b = (lambda k: F.col("a")[k]), (lambda k: F.col("b")[k])
    per = [F.sum(a(i)).alias(f"a{i}") for i in range(p)] + [F.sum(b(i)).alias(f"b{i}") for i in range(p)]
    per += [F.sum(a(i) * a(i)).alias(f"aa{i}") for i in range(p)] + [F.sum(b(i) * b(i)).alias(f"bb{i}") for i in range(p)]
    per += [F.sum(b(i) * a(j)).alias(f"ba{i}_{j}") for i in range(p) for j in range(p)]
    return long.groupBy("conversation", "lag").agg(F.count("*").alias("w"), *per)


def lag_curve(df: DataFrame, codes: Sequence[str], conversation: Sequence[str], order_by: Sequence[str], most: int = 20, overlap: int = 10) -> DataFrame:
    """``lag``, ``corrected``, ``signed``: pooled cross-covariance norms less their noise, for lags with ``overlap`` lines in a conversation."""
    p = len(codes)
    s = lag_sums(df, codes, conversation, order_by, most).where(F.col("w") >= max(2, overlap))
    w = F.col("w")
    cov = [(F.col(f"ba{i}_{j}") / w - F.col(f"b{i}") / w * F.col(f"a{j}") / w).alias(f"c{i}_{j}") for i in range(p) for j in range(p)]
    spread = lambda x: sum((F.col(f"{x}{x}{i}") - F.col(f"{x}{i}") * F.col(f"{x}{i}") / w for i in range(p)), F.lit(0.0)) / (w - 1)
    per = s.select("lag", "w", (spread("a") * spread("b")).alias("noise"), *cov)
    pooled = per.groupBy("lag").agg(F.sum("w").alias("w"), F.sum(w * F.col("noise")).alias("noise"), *[F.sum(w * F.col(f"c{i}_{j}")).alias(f"c{i}_{j}") for i in range(p) for j in range(p)])
    norm = sum(((F.col(f"c{i}_{j}") / w) ** 2 for i in range(p) for j in range(p)), F.lit(0.0))
    corrected = norm - F.col("noise") / (w * w)
    return pooled.select("lag", corrected.alias("corrected"), (F.signum(corrected) * F.sqrt(F.abs(corrected))).alias("signed"))


def lag_window(df: DataFrame, codes: Sequence[str], conversation: Sequence[str], order_by: Sequence[str], most: int = 20, overlap: int = 10, fill: bool = True) -> Lags:
    """The window: the first lag from the peak on at which the curve has fallen to half; null codes count as 0 if ``fill``."""
    if fill:
        df = df.fillna(0, subset=list(codes))
    elif df.where(" or ".join(f"`{c}` is null" for c in codes)).first() is not None:
        raise ValueError("codes have nulls")
    curve = {r.lag: r.signed for r in lag_curve(df, codes, conversation, order_by, most, overlap).collect()}
    later = [k for k in sorted(curve) if k >= 1 and math.isfinite(curve[k])]
    positive = [k for k in later if curve[k] > 0]
    lags = sorted(curve)
    if not positive:
        return Lags(1, 0, lags, [curve[k] for k in lags])
    peak = max(positive, key=lambda k: (curve[k], -k))
    fallen = [k for k in later if k >= peak and curve[k] / curve[peak] <= 0.5]
    return Lags(fallen[0] if fallen else later[-1], peak, lags, [curve[k] for k in lags])


# ------------------------------------------------------------------------ tuning
def tune_by_stability(df: DataFrame, units: Sequence[str], conversation: Sequence[str], codes: Sequence[str], order_by: Sequence[str], windows: Sequence[int] = tuple(range(2, 11)), cutoff: float = 0.95, dims: int | None = 2, most: int = 100_000, **options) -> tuple[int, dict[int, float]]:
    """The first window whose space's distances correlate with those of the next window by at least ``cutoff`` of the best.

    All columns of the input that are needed are cached once; each window is one pass over them.
    """
    rows = df.select(*[col(c) for c in dict.fromkeys([*units, *conversation, *codes, *order_by])]).cache()
    correlations: dict[int, float] = {}
    before = None
    try:
        for k, w in enumerate(windows):
            acc = accumulate(rows, units, conversation, codes, order_by, back=w, check_rows=not k, **options)
            model = fit(acc, dims=2)
            if dims is None:
                labels = model.rotation.labels
                from .normalize import project

                points = project(model.centered, acc.names, model.rotation.matrix, labels)
            else:
                points, labels = model.points, model.dimensions[:dims]
            points = points.cache()
            if before is not None:
                correlations[windows[k - 1]] = distance_correlation(before, points, labels, [UNIT], "ENA_FIRST", most)
                before.unpersist()
            before = points
    finally:
        rows.unpersist()
    best = np.nanmax(list(correlations.values()))
    chosen = next(w for w in correlations if correlations[w] >= cutoff * best)
    return chosen, correlations


def tune_window(df: DataFrame, units: Sequence[str], conversation: Sequence[str], codes: Sequence[str], order_by: Sequence[str], method: str = "ccd", rebuild: bool = False, **options):
    """A window by a named method, and the accumulation with it if ``rebuild``."""
    if method == "ccd":
        found = lag_window(df, codes, conversation, order_by, **options).window
    elif method == "stability":
        found = tune_by_stability(df, units, conversation, codes, order_by, **options)[0]
    elif method == "ground_diversity":
        found = ground_diversity_window(df, codes, conversation, order_by, **options)
    else:
        raise ValueError(f"unknown method {method!r}")
    return (found, accumulate(df, units, conversation, codes, order_by, back=found)) if rebuild else found
