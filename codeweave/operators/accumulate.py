"""Co-occurrence of codes in windows of lines, and their sums by unit.

With C the codes of a line, H the sum over the back window before it and T the sum over the lines
after it, an undirected connection is C_i C_j + C_i (H_j + T_j) + (H_i + T_i) C_j + H_i T_j + T_i H_j,
a directed one from ground i to response j is H_i C_j, and half of C_i C_j where i and j differ.
Weights apply to each line before the sum.

All window sums stand in one Window operator (one shuffle by conversation, one sort);
units are then summed with a partial aggregation, which is the second shuffle.  A back window of one line
needs no window at all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.weights import Weight, weight_function
from ..model import CONVERSATION, FIRST, STEP, UNIT, Accumulation
from ..plans.linalg import col

INFINITE = math.inf
TRAJECTORIES = ("EndPoint", "SeparateTrajectory", "AccumulatedTrajectory")


def key_part(value: Column, separator: str = "::") -> Column:
    """A part of a key as text such that different rows of parts never join into one key.

    Ordinary values stay as they are.  One that holds the separator or an escape, or begins or ends with the separator's
    sign, has its signs escaped (``%25`` and ``%3A`` for ``%`` and ``:``), and null is ``%00``.
    """
    sign = separator[0]
    escape = f"%{ord(sign):02X}"
    text = value.cast("string")
    odd = text.contains(separator) | text.startswith(sign) | text.endswith(sign) | text.contains(escape) | text.contains("%25") | text.contains("%00")
    escaped = F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(sign), F.lit(escape))
    return F.coalesce(F.when(odd, escaped).otherwise(text), F.lit("%00"))


def composite(columns: Sequence[str], separator: str = "::") -> Column:
    """Columns joined into one key, another for each row of values (see ``key_part``)."""
    return F.concat_ws(separator, *[key_part(col(c), separator) for c in columns])


def only_units(df: DataFrame, units_used: Sequence[str] | DataFrame | None, name: str = UNIT) -> DataFrame:
    """The rows of the units wanted: a list of their names, or a DataFrame whose first column holds them, which is joined."""
    if units_used is None:
        return df
    if isinstance(units_used, DataFrame):
        wanted = units_used.select(col(units_used.columns[0]).cast("string").alias("__wanted"))
        return df.join(wanted, F.col(name) == F.col("__wanted"), "left_semi")
    return df.where(F.col(name).isin(list(units_used)))


def check_keys(df: DataFrame, columns: Sequence[str], separator: str = "__") -> None:
    """Raise if two different rows of key columns join into one plain key, as names for other tools would (``composite`` keeps them apart)."""
    keys = df.select(*[col(c).cast("string").alias(f"k{n}") for n, c in enumerate(columns)]).distinct()
    clash = keys.groupBy(F.concat_ws(separator, *keys.columns).alias("k")).count().where("count > 1").first()
    if clash:
        raise ValueError(f"different keys join into {clash[0]!r}")


def window_size(value) -> float:
    """A whole number of lines, or infinity."""
    if isinstance(value, str) and value.lower() in ("inf", "infinite", "infinity"):
        return INFINITE
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or value < 0 or (value != INFINITE and value != int(value)):
        raise ValueError(f"a window is a whole number of lines from 0, or infinite, not {value!r}")
    return value


def validate(df: DataFrame, units: Sequence[str], conversation: Sequence[str], codes: Sequence[str], order_by: Sequence[str], check_rows: bool = True) -> None:
    """Raise on missing columns, null keys, codes that are not numbers or not finite, and equal places in a conversation; one pass each."""
    if not units or not conversation or not codes or not order_by:
        raise ValueError("units, conversation, codes and order_by are all needed")
    if len(set(codes)) != len(codes):
        raise ValueError("codes must be unique")
    missing = [c for c in [*units, *conversation, *codes, *order_by] if c not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}")
    kinds = dict(df.dtypes)
    wrong = [c for c in codes if not any(kinds[c].startswith(k) for k in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"))]
    if wrong:
        raise ValueError(f"codes must be numbers: {', '.join(wrong)}")
    if not check_rows:
        return
    bad_key = [F.count(F.when(col(c).isNull(), 1)).alias(f"k{n}") for n, c in enumerate([*units, *conversation])]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITE)
    bad_code = [F.count(F.when(~finite(col(c).cast("double")), 1)).alias(f"c{n}") for n, c in enumerate(codes)]
    row = df.agg(*bad_key, *bad_code).first()
    for n, c in enumerate([*units, *conversation]):
        if row[f"k{n}"]:
            raise ValueError(f"{c} has nulls")
    for n, c in enumerate(codes):
        if row[f"c{n}"]:
            raise ValueError(f"{c} has values that are null or not finite")
    keys = list(dict.fromkeys([*conversation, *order_by]))
    if df.groupBy(*[col(c) for c in keys]).count().where("count > 1").first():
        raise ValueError("two lines of a conversation have the same place in its order")


def _frames(codes: Sequence[str], spec, back: float, forward: float) -> tuple[list[Column], list[Column]]:
    """H and T of each code."""
    zero = [F.lit(0.0)] * len(codes)
    h = zero
    if back > 1:
        frame = spec.rowsBetween(Window.unboundedPreceding if back == INFINITE else -(int(back) - 1), -1)
        h = [F.coalesce(F.sum(col(c)).over(frame), F.lit(0.0)) for c in codes]
    t = zero
    if forward >= 1:
        frame = spec.rowsBetween(1, Window.unboundedFollowing if forward == INFINITE else int(forward))
        t = [F.coalesce(F.sum(col(c)).over(frame), F.lit(0.0)) for c in codes]
    return h, t


def connections(codes: Sequence[str], layout: str, weight: Weight, c: Sequence[Column], h: Sequence[Column], t: Sequence[Column] | None, gone: set[int]) -> list[Column]:
    """The connection columns of a line from its own codes, its ground and what follows."""
    f = weight_function(weight, layout == "ordered")
    out = []
    for n, ((i, j), name) in enumerate(zip(L.index_pairs(len(codes), layout), L.pair_names(codes, layout))):
        if n in gone:
            value = F.lit(0.0)
        elif layout == "ordered":
            value = f(h[i] * c[j] + 0.5 * c[i] * c[j] if i != j else h[i] * c[j])
        elif i == j:
            value = f(h[i] * c[i])
        elif t is None:
            value = f(c[i] * c[j] + c[i] * h[j] + h[i] * c[j])
        else:
            value = f(c[i] * c[j] + c[i] * (h[j] + t[j]) + (h[i] + t[i]) * c[j] + h[i] * t[j] + t[i] * h[j])
        out.append(value.cast("double").alias(name))
    return out


def prepare(df: DataFrame, units: Sequence[str], conversation: Sequence[str], codes: Sequence[str], order_by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Only the columns that are needed: keys, order, codes as doubles, and ``keep``."""
    others = [c for c in dict.fromkeys([*units, *conversation, *keep]) if c not in codes]
    order = F.struct(*[col(c).alias(f"o{n}") for n, c in enumerate(order_by)]).alias(FIRST)
    return df.select(composite(units).alias(UNIT), composite(conversation).alias(CONVERSATION), order, *[col(c) for c in others], *[col(c).cast("double").alias(c) for c in codes])


def sum_by(lines: DataFrame, names: Sequence[str], by: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Sums of columns by key, with the place of the first line and the carried columns there."""
    first = [F.min_by(col(c), FIRST).alias(c) for c in carry if c not in by]
    return lines.groupBy(*by).agg(F.min(FIRST).alias(FIRST), *first, *[F.sum(col(n)).alias(n) for n in names])


def accumulate(
    df: DataFrame,
    units: Sequence[str],
    conversation: Sequence[str],
    codes: Sequence[str],
    order_by: Sequence[str],
    back: float = 4,
    forward: float = 0,
    weight: Weight = "binary",
    ordered: bool = False,
    self_connections: bool = False,
    misses: bool = False,
    window: str = "MovingStanza",
    model: str = "EndPoint",
    units_used: Sequence[str] | DataFrame | None = None,
    mask=None,
    self_mask=None,
    metadata: Sequence[str] | str = (),
    check_rows: bool = True,
) -> Accumulation:
    """Count connections by line and sum them by unit (or by unit and conversation for trajectories).

    Units outside ``units_used`` (their names, or a DataFrame of them) stay in the windows of others but get no network.
    """
    units, conversation, codes, order_by = list(units), list(conversation), list(codes), list(order_by)
    back, forward = window_size(back), window_size(forward)
    if model not in TRAJECTORIES:
        raise ValueError(f"unknown model {model!r}")
    if ordered and forward:
        raise ValueError("ordered networks have no forward window")
    weight_function(weight, ordered)
    validate(df, units, conversation, codes, order_by, check_rows)
    layout = "ordered" if ordered else "self" if self_connections else "unordered"
    gone = L.masked(codes, layout, mask, self_mask)
    rows = prepare(df, units, conversation, codes, order_by)
    names = L.pair_names(codes, layout)
    keys = [c for c in dict.fromkeys([*units, *conversation]) if c not in codes]
    c = [col(x) for x in codes]
    if window.lower() == "conversation":
        groups = rows.groupBy(UNIT, CONVERSATION).agg(F.min(FIRST).alias(FIRST), *[F.first(col(x)).alias(x) for x in keys], *[F.sum(col(x)).alias(x) for x in codes])
        zero = [F.lit(0.0)] * len(codes)
        lines = groups.select(UNIT, CONVERSATION, FIRST, *[col(x) for x in keys], *connections(codes, layout, weight, c, zero, None, gone))
        base, h = groups, None
    elif window == "MovingStanza":
        h, t = _frames(codes, Window.partitionBy(CONVERSATION).orderBy(FIRST), back, forward)
        base = rows
        if back > 1 or forward >= 1:
            base = rows.select("*", *[x.alias(f"__h{n}") for n, x in enumerate(h)], *[x.alias(f"__t{n}") for n, x in enumerate(t)])
            h, t = [F.col(f"__h{n}") for n in range(len(codes))], [F.col(f"__t{n}") for n in range(len(codes))]
        lines = base.select(UNIT, CONVERSATION, FIRST, *[col(x) for x in keys], *connections(codes, layout, weight, c, h, t if forward >= 1 else None, gone))
    else:
        raise ValueError(f"unknown window {window!r}")
    lines, base = only_units(lines, units_used), only_units(base, units_used)
    counts, by = summed(lines, names, units, conversation, model)
    out = Accumulation(counts, lines, codes, units, conversation, layout, by, {"back": back, "forward": forward, "weight": weight, "window": window, "model": model})
    out.options = {"units_used": units_used, "misses": misses, "mask": mask, "self_mask": self_mask, "metadata": metadata, "check_rows": check_rows}
    if h is not None and self_connections:
        own = base.select(UNIT, FIRST, *[(h[i] * c[i]).alias(codes[i]) for i in range(len(codes))])
        out.self_counts = sum_by(own, codes, [UNIT])
    if h is not None and misses:
        absent = [(h[i] * F.when(c[j] == 0, 1.0).otherwise(0.0)).alias(L.pair_names(codes, "ordered")[n]) for n, (i, j) in enumerate(L.index_pairs(len(codes), "ordered"))]
        out.misses = sum_by(base.select(UNIT, FIRST, *absent), L.pair_names(codes, "ordered"), [UNIT])
    if metadata:
        wanted = None if metadata == "constant" else list(metadata)
        out.metadata = unit_metadata(df, units, order_by, wanted, constant=metadata == "constant")
    return out


def summed(lines: DataFrame, names: Sequence[str], units: Sequence[str], conversation: Sequence[str], model: str = "EndPoint") -> tuple[DataFrame, list[str]]:
    """Line connections summed by unit, or along its steps."""
    if model == "EndPoint":
        return sum_by(lines, names, [UNIT], units), [UNIT]
    steps = sum_by(lines, names, [UNIT, CONVERSATION], [*units, *[c for c in conversation if c not in units]])
    order = Window.partitionBy(UNIT).orderBy(FIRST)
    if model == "AccumulatedTrajectory":
        running = order.rowsBetween(Window.unboundedPreceding, 0)
        rest = [c for c in steps.columns if c not in names]
        steps = steps.select(*[col(c) for c in rest], *[F.sum(col(n)).over(running).alias(n) for n in names])
    return steps.withColumn(STEP, F.row_number().over(order)), [UNIT, CONVERSATION]


def as_trajectory(df: DataFrame, acc: Accumulation, by: Sequence[str], order_by: Sequence[str], model: str = "AccumulatedTrajectory") -> Accumulation:
    """The same accumulation, with all its options, along the steps of other columns."""
    p = acc.parameters
    if p["window"] == "tensor":
        from .tensor import accumulate_tensor

        return accumulate_tensor(df, acc.units, by, acc.codes, order_by, p["tensor"], p["weight"], acc.layout == "ordered", acc.layout == "self", model=model, **acc.options)
    if p["window"] == "horizons":
        raise ValueError("networks over flexible horizons have no steps")
    return accumulate(df, acc.units, by, acc.codes, order_by, p["back"], p["forward"], p["weight"], acc.layout == "ordered", acc.layout == "self", window=p["window"], model=model, **acc.options)


def unit_metadata(df: DataFrame, units: Sequence[str], order_by: Sequence[str], columns: Sequence[str] | None = None, constant: bool = True) -> DataFrame:
    """The columns of each unit's first line; only those constant within every unit if ``constant``."""
    columns = [c for c in (df.columns if columns is None else columns) if c not in units]
    order = F.struct(*[col(c) for c in order_by])
    rows = df.withColumn(UNIT, composite(units))
    keep = columns
    if constant and columns:
        values = rows.groupBy(UNIT).agg(*[(F.count_distinct(col(c)) + F.max(col(c).isNull().cast("int"))).alias(f"m{n}") for n, c in enumerate(columns)])
        most = values.agg(*[F.max(f"m{n}") for n in range(len(columns))]).first()
        keep = [c for c, m in zip(columns, most) if m is None or m <= 1]
    return rows.groupBy(UNIT).agg(*[F.min_by(col(c), order).alias(c) for c in [*units, *keep]])


def connection_matrix(table: DataFrame, codes: Sequence[str], layout: str = "unordered", by: str = UNIT) -> DataFrame:
    """A row for each unit and code, with a column for each second code; null below the upper triangle."""
    entry = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(n).alias("w")) for (a, b), n in zip(L.adjacency_key(codes, layout), L.pair_names(codes, layout))])).alias("e")
    cells = table.select(by, entry).select(by, "e.*")
    rows = table.select(by, F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))
    wide = cells.groupBy(by, "a").agg(*[F.max(F.when(F.col("b") == c, F.col("w"))).alias(c) for c in codes])
    wide = wide.withColumnRenamed("a", "code")
    return rows.join(wide, [by, "code"], "left")
