"""Windows whose width and weight depend on who speaks to whom, on time, and on horizons.

A tensor gives each combination of factor values a weight and a window.  Sender factors are read on
the ground line, receiver factors on the response line, mode factors on the ground line.
A constant tensor is a plain moving window and is planned as one (a Window operator).  Windows of a few lines
are a join of each response with the ground lines of its conversation, which has a band on the lines' places
rather than a bare range: ground lines are bucketed by the widest window and responses look into the two buckets that
their window reaches, so that it is an equi-join on (conversation, bucket).  A window of time or of many lines may hold
any number of lines, and its pairs grow with the square of a conversation: such sums are made without pairs, in
one pass over the sorted lines (``plans.sweep``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import layout as L
from ..functions.times import seconds_per_unit, time_seconds
from ..functions.weights import Weight, weight_function
from ..model import CONVERSATION, FIRST, UNIT, Accumulation
from ..plans.linalg import col
from ..plans.sweep import window_sums
from .accumulate import INFINITE, accumulate, composite, only_units, prepare, summed, validate

ROLES = ("sender", "receiver", "mode")
#: The widest window, in lines, that is joined.
JOINED_LINES = 64


@dataclass
class Tensor:
    """``factors``: (column, role) in order; ``cells``: values of the factors → (weight, window)."""

    factors: list[tuple[str, str]] = field(default_factory=list)
    cells: dict[tuple, tuple[float, float]] = field(default_factory=dict)
    default: tuple[float, float] = (1.0, 4)
    time: str | None = None
    time_unit: str | None = None
    time_end: str | None = None

    def __post_init__(self):
        for _, role in self.factors:
            if role not in ROLES:
                raise ValueError(f"unknown role {role!r}")
        for key, (weight, window) in self.cells.items():
            if len(key) != len(self.factors):
                raise ValueError(f"cell {key!r} has not one value for each factor")
            if window < 0:
                raise ValueError("a window is not negative")

    @property
    def constant(self) -> bool:
        return self.time is None and all(c == self.default for c in self.cells.values())

    @property
    def widest(self) -> float:
        return max([self.default[1], *(w for _, w in self.cells.values())])


def default_tensor(window: float = 4, weight: float = 1.0) -> Tensor:
    return Tensor(default=(weight, window))


def factor_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """The values of factors, sorted."""
    return {c: [r[0] for r in df.select(col(c)).distinct().orderBy(col(c)).collect()] for c in columns}


def check_levels(df: DataFrame, tensor: Tensor, levels: dict[str, Sequence]) -> None:
    """Raise if a line has a factor value that is not among the levels."""
    for c, _ in tensor.factors:
        row = df.where(~col(c).isin(list(levels[c])) | col(c).isNull()).select(col(c)).first()
        if row is not None:
            raise ValueError(f"{c} has the value {row[0]!r}, which the tensor does not know")


def _looked_up(tensor: Tensor, which: int) -> Column:
    """Weight (0) or window (1) of a pair of lines, the factors of which are named g_ and r_."""
    out = F.lit(float(tensor.default[which]))
    for key, cell in tensor.cells.items():
        same = F.lit(True)
        for (c, role), value in zip(tensor.factors, key):
            side = "r_" if role == "receiver" else "g_"
            same = same & (F.col(side + c) == F.lit(value))
        out = F.when(same, float(cell[which])).otherwise(out)
    return out


def places(rows: DataFrame, time: Column | None) -> DataFrame:
    """Lines numbered in their conversation, their places in lines or seconds, and the least place from each line on."""
    order = Window.partitionBy(CONVERSATION).orderBy(FIRST)
    if time is None:
        rows = rows.withColumn("__n", F.row_number().over(order)).withColumn("__at", F.col("__n").cast("double"))
        return rows.withColumn("__low", F.col("__at"))
    # Times need not follow the order.
    back = Window.partitionBy(CONVERSATION).orderBy(F.desc(FIRST)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__at", time)
    return rows.withColumn("__low", F.min("__at").over(back)).withColumn("__n", F.row_number().over(order))


def line_time(df: DataFrame, tensor: Tensor, numeric_time: bool) -> Column:
    """The seconds at which a line stands: its time, or its end."""
    start = time_seconds(col(tensor.time), numeric_time)
    if not tensor.time_end:
        return start
    kind = dict(df.dtypes)[tensor.time_end]
    if any(kind.startswith(k) for k in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        return start + col(tensor.time_end).cast("double")
    return time_seconds(col(tensor.time_end), False)


def accumulate_tensor(
    df: DataFrame,
    units: Sequence[str],
    conversation: Sequence[str],
    codes: Sequence[str],
    order_by: Sequence[str],
    tensor: Tensor,
    weight: Weight = "binary",
    ordered: bool = False,
    self_connections: bool = False,
    units_used: Sequence[str] | DataFrame | None = None,
    model: str = "EndPoint",
    numeric_time: bool = False,
    check_rows: bool = True,
    levels: dict[str, Sequence] | None = None,
    misses: bool = False,
    mask=None,
    self_mask=None,
    metadata: Sequence[str] | str = (),
) -> Accumulation:
    """Connections with a tensor: the ground of a line is the weighted sum of the earlier lines within the window of their cell.

    In time windows a ground line counts if less than the window has passed; of equal times, lines
    before the response in the order of the conversation count.  A line's time is its end if the tensor has a
    ``time_end``: a numeric one is a duration in seconds after the start, another is read as a time.  ``levels`` are
    the values that each factor may have, by default those of the cells; any other value is an error.
    """
    if levels is None:
        levels = {c: sorted({key[k] for key in tensor.cells}, key=str) for k, (c, _) in enumerate(tensor.factors)}
    if tensor.cells or any(levels.values()):
        check_levels(df, tensor, levels)
    if tensor.constant and tensor.default[0] == 1.0:
        return accumulate(df, units, conversation, codes, order_by, tensor.default[1], 0, weight, ordered, self_connections, units_used=units_used, model=model, check_rows=check_rows, misses=misses, mask=mask, self_mask=self_mask, metadata=metadata)
    validate(df, units, conversation, codes, order_by, check_rows)
    codes = list(codes)
    p, layout = len(codes), "ordered" if ordered else "self" if self_connections else "unordered"
    factors = list(dict.fromkeys(c for c, _ in tensor.factors))
    extra = [c for c in (tensor.time, tensor.time_end) if c]
    rows = prepare(df, units, conversation, codes, order_by, [*factors, *extra])
    time = None
    if tensor.time:
        time = line_time(df, tensor, numeric_time)
        if df.where(time.isNull()).first() is not None:
            raise ValueError(f"{tensor.time} has values that cannot be read as times")
    rows = places(rows, time)
    scale = float(seconds_per_unit(tensor.time_unit) or 1) if tensor.time else 1.0
    joined = grounds(rows, tensor, codes, factors, scale)
    h = [F.coalesce(F.col(f"__h{k}"), F.lit(0.0)) for k in range(p)]
    from .accumulate import connections, sum_by, unit_metadata

    names = L.pair_names(codes, layout)
    own = tensor_own_weight(tensor, factors)
    c = [col(x) for x in codes]
    gone = L.masked(codes, layout, mask, self_mask)
    if own is None:
        made = connections(codes, layout, weight, c, h, None, gone)
    else:
        joined = joined.withColumn("__own", own)
        made = own_weighted(codes, layout, weight, c, h, F.col("__own"), gone)
    keys = [x for x in dict.fromkeys([*units, *conversation]) if x not in codes]
    lines = joined.select(UNIT, CONVERSATION, FIRST, *[col(x) for x in keys], *made)
    lines, joined = only_units(lines, units_used), only_units(joined, units_used)
    counts, by = summed(lines, names, list(units), list(conversation), model)
    out = Accumulation(counts, lines, codes, list(units), list(conversation), layout, by, {"tensor": tensor, "weight": weight, "window": "tensor", "model": model})
    out.options = {"units_used": units_used, "numeric_time": numeric_time, "check_rows": check_rows, "levels": levels, "misses": misses, "mask": mask, "self_mask": self_mask, "metadata": metadata}
    if self_connections:
        out.self_counts = sum_by(joined.select(UNIT, FIRST, *[(h[i] * c[i]).alias(codes[i]) for i in range(p)]), codes, [UNIT])
    if misses:
        pairs = L.pair_names(codes, "ordered")
        absent = [(h[i] * F.when(c[j] == 0, 1.0).otherwise(0.0)).alias(pairs[n]) for n, (i, j) in enumerate(L.index_pairs(p, "ordered"))]
        out.misses = sum_by(joined.select(UNIT, FIRST, *absent), pairs, [UNIT])
    if metadata:
        out.metadata = unit_metadata(df, units, order_by, None if metadata == "constant" else list(metadata), constant=metadata == "constant")
    return out


def tensor_own_weight(tensor: Tensor, factors: Sequence[str]) -> Column | None:
    """The weight of a line's own codes: that of its cell with itself; None if it is always 1."""
    if tensor.default[0] == 1.0 and all(w == 1.0 for w, _ in tensor.cells.values()):
        return None
    out = F.lit(float(tensor.default[0]))
    for key, cell in tensor.cells.items():
        same = F.lit(True)
        for (c, _), value in zip(tensor.factors, key):
            same = same & (col(c) == F.lit(value))
        out = F.when(same, float(cell[0])).otherwise(out)
    return out


def own_weighted(codes: Sequence[str], layout: str, weight: Weight, c: Sequence[Column], h: Sequence[Column], own: Column, gone: set[int] = frozenset()) -> list[Column]:
    f = weight_function(weight, layout == "ordered")
    out = []
    for n, ((i, j), name) in enumerate(zip(L.index_pairs(len(codes), layout), L.pair_names(codes, layout))):
        if n in gone:
            out.append(F.lit(0.0).alias(name))
            continue
        if layout == "ordered":
            value = h[i] * c[j] + 0.5 * own * c[i] * c[j] if i != j else h[i] * c[j]
        elif i == j:
            value = h[i] * c[i]
        else:
            value = own * c[i] * c[j] + c[i] * h[j] + h[i] * c[j]
        out.append(f(value).cast("double").alias(name))
    return out


def grounds(rows: DataFrame, tensor: Tensor, codes: Sequence[str], factors: Sequence[str], scale: float = 1.0) -> DataFrame:
    """The lines with ``__h0`` ...: the weighted sums of each response's ground lines; null may stand for none."""
    if tensor.time is not None or not 0 < tensor.widest <= JOINED_LINES:
        return swept(rows, tensor, codes, scale)
    widest = tensor.widest
    g = rows.select(CONVERSATION, F.col("__n").alias("g_n"), *[col(c).alias("g_" + c) for c in factors], *[col(c).alias(f"g__{k}") for k, c in enumerate(codes)])
    r = rows.select(CONVERSATION, F.col("__n").alias("r_n"), *[col(c).alias("r_" + c) for c in factors])
    near = (F.col("g_n") < F.col("r_n")) & (F.col("r_n") - F.col("g_n") < _looked_up(tensor, 1))
    g = g.withColumn("__b", F.floor(F.col("g_n") / widest))
    r = r.withColumn("__b", F.explode(F.sequence(F.floor(F.col("r_n") / widest) - 1, F.floor(F.col("r_n") / widest))))
    pairs = g.join(r, [CONVERSATION, "__b"]).where(near)
    w = _looked_up(tensor, 0)
    sums = pairs.groupBy(CONVERSATION, F.col("r_n").alias("__n")).agg(*[F.sum(w * F.col(f"g__{k}")).alias(f"__h{k}") for k in range(len(codes))])
    return rows.join(sums, [CONVERSATION, "__n"], "left")


def swept(rows: DataFrame, tensor: Tensor, codes: Sequence[str], scale: float = 1.0) -> DataFrame:
    """``grounds`` by one pass over the lines of each conversation, which one task holds as windows do."""
    sides = [[k for k, (_, role) in enumerate(tensor.factors) if (role == "receiver") == response] for response in (False, True)]
    keys = [list(dict.fromkeys(tuple(key[k] for k in side) for key in tensor.cells)) for side in sides]
    tables = [np.full([len(k) + 1 for k in keys], float(tensor.default[which])) for which in (0, 1)]
    for key, cell in tensor.cells.items():
        place = tuple(known.index(tuple(key[k] for k in side)) + 1 for known, side in zip(keys, sides))
        for table, value in zip(tables, cell):
            table[place] = value
    kinds = []
    for known, side in zip(keys, sides):
        kind = F.lit(0)
        for n, key in enumerate(known, 1):
            kind = F.when(reduce(and_, [col(tensor.factors[k][0]) == F.lit(v) for k, v in zip(side, key)], F.lit(True)), n).otherwise(kind)
        kinds.append(kind)
    rows = rows.withColumn("__g", kinds[0]).withColumn("__r", kinds[1])
    schema = StructType([*rows.schema.fields, *[StructField(f"__h{k}", DoubleType()) for k in range(len(codes))]])
    return rows.repartition(CONVERSATION).sortWithinPartitions(CONVERSATION, "__n").mapInArrow(window_sums(list(codes), tables[1] * scale, tables[0]), schema)


# --------------------------------------------------------------------- horizons
def rule_columns(rules: dict[str, Sequence[str]]) -> list[str]:
    """The columns of all rules, each once."""
    if not rules:
        raise ValueError("there must be a rule")
    for value, columns in rules.items():
        if not columns:
            raise ValueError(f"rule {value!r} has no columns")
    return list(dict.fromkeys(c for columns in rules.values() for c in columns))


def horizon_lines(df: DataFrame, units: Sequence[str], by: str, rules: dict[str, Sequence[str]]) -> DataFrame:
    """Each unit's context: a row for each line and each unit that has it, with the unit in ENA_UNIT and its piece in ENA_CONV.

    A line whose ``by`` value has a rule is in a unit's context if every column of the rule holds a value that the
    unit has on some line.  Pieces are split on the columns of all rules.
    """
    split = rule_columns(rules)
    rows = df.withColumn("__own", composite(units)).withColumn(CONVERSATION, composite(split))
    parts = []
    for value, columns in rules.items():
        lines = rows.where(col(by) == F.lit(value))
        has = {c: rows.select(F.col("__own").alias(UNIT), col(c).alias(f"__v_{c}")).distinct() for c in columns}
        first, *rest = columns
        found = lines.join(has[first], col(first) == col(f"__v_{first}")).drop(f"__v_{first}")
        for c in rest:
            found = found.join(has[c].withColumnRenamed(UNIT, "__u"), (col(c) == col(f"__v_{c}")) & (F.col(UNIT) == F.col("__u")), "left_semi")
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accumulate_horizons(df: DataFrame, units: Sequence[str], codes: Sequence[str], order_by: Sequence[str], by: str, rules: dict[str, Sequence[str]], back: float = 4, weight: Weight = "binary", ordered: bool = False, self_connections: bool = False) -> Accumulation:
    """Networks over flexible horizons: windows run in each unit's pieces, and the unit's own lines are its responses.

    Only the pieces in which a unit has a line of its own give it responses.  Such a line holds the piece's values of all
    rules' columns, so that the unit meets every rule there: its context is the piece's lines that have a rule, the same for
    all units.  Windows therefore run once in each piece, and no line is copied to the units whose context it is in.
    """
    from .accumulate import _frames, connections, sum_by

    codes = list(codes)
    layout = "ordered" if ordered else "self" if self_connections else "unordered"
    split = rule_columns(rules)
    rows = df.withColumn(UNIT, composite(units)).withColumn(CONVERSATION, composite(split))
    ruled = [(col(by) == F.lit(value)) & reduce(and_, [col(c).isNotNull() for c in columns]) for value, columns in rules.items()]
    lines = rows.where(reduce(or_, ruled))
    lines = lines.select(UNIT, CONVERSATION, F.struct(*[col(c) for c in order_by]).alias(FIRST), *[col(c).cast("double").alias(c) for c in codes])
    h, _ = _frames(codes, Window.partitionBy(CONVERSATION).orderBy(FIRST), back, 0)
    marked = lines.select("*", *[x.alias(f"__h{n}") for n, x in enumerate(h)])
    h = [F.col(f"__h{n}") for n in range(len(codes))]
    made = marked.select(UNIT, CONVERSATION, FIRST, *connections(codes, layout, weight, [col(c) for c in codes], h, None, set()))
    counts = sum_by(made, L.pair_names(codes, layout), [UNIT])
    return Accumulation(counts, made, codes, list(units), [by], layout, [UNIT], {"back": back, "forward": 0, "weight": weight, "window": "horizons", "model": "EndPoint"})
