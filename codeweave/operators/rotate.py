"""Rotations of the centered networks.

A rotation sees a ``Space``: the table of centered networks and its Gram matrix.  Axes that
depend on groups or covariates come from group means and cross products that Spark sums; the
decompositions work on the k x k Gram matrix on the driver.  Removing an axis a from the data is
(I - aa') G (I - aa') on the Gram matrix, so that no second pass over the data is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.linalg import centered_gram, col, cross, eigen, solve, sums


@dataclass
class Space:
    """Centered networks, the numbers of their rows, their means and Gram matrix (about 0)."""

    table: DataFrame
    names: list[str]
    n: int
    gram: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, names: Sequence[str]) -> Space:
        n, _, gram = centered_gram(table, names, np.zeros(len(names)))
        return cls(table, list(names), n, gram)

    def mean(self, condition: Column | None = None) -> tuple[int, np.ndarray]:
        n, total = sums(self.table if condition is None else self.table.where(condition), self.names)
        return n, total / n if n else total


@dataclass
class Rotation:
    matrix: np.ndarray
    labels: list[str]
    eigenvalues: np.ndarray


def remove(gram: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """The Gram matrix of the data without its component along unit axes (columns)."""
    axis = axis.reshape(len(gram), -1)
    p = np.eye(len(gram)) - axis @ axis.T
    return p @ gram @ p


def deflate(table: DataFrame, names: Sequence[str], axis: np.ndarray) -> DataFrame:
    """Rows without their component along a unit axis."""
    from ..plans.linalg import dot

    marked = table.withColumn("__along", dot(names, axis))
    rest = [col(c) for c in table.columns if c not in set(names)]
    return marked.select(*rest, *[(col(n) - F.col("__along") * float(a)).alias(n) for n, a in zip(names, axis)])


def _numbered(first: int, count: int) -> list[str]:
    return [f"SVD{first + k}" for k in range(count)]


def svd(space: Space) -> Rotation:
    values, vectors = eigen(space.gram)
    keep = min(space.n, len(values))
    return Rotation(vectors[:, :keep], _numbered(1, keep), values[:keep] / max(1, space.n - 1))


def orthogonal_svd(space: Space, axes: np.ndarray, labels: Sequence[str]) -> Rotation:
    """Given axes made orthonormal in turn, then the SVD of the rest."""
    axes = np.asarray(axes, float).reshape(len(space.gram), -1)
    q, r = np.linalg.qr(axes)
    q = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    m = q.shape[1]
    values, vectors = eigen(remove(space.gram, q))
    # The rest is orthogonal to the axes; null directions are made so.
    rest = _orthogonal_to(vectors, q)[:, : len(space.gram) - m]
    own = np.array([a @ space.gram @ a for a in q.T])
    return Rotation(np.hstack([q, rest]), [*labels, *_numbered(m + 1, rest.shape[1])], np.concatenate((own, [a @ space.gram @ a for a in rest.T])) / max(1, space.n - 1))


def _orthogonal_to(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Gram-Schmidt of columns against a basis and one another; columns that vanish go."""
    kept = [b for b in basis.T]
    out = []
    for v in vectors.T:
        w = v.copy()
        for _ in range(2):
            for b in kept:
                w = w - (w @ b) * b
        size = np.linalg.norm(w)
        if size > 1e-6:
            kept.append(w / size)
            out.append(w / size)
    return np.array(out).T.reshape(len(vectors), -1)


def complete_rotation(space: Space, axes: np.ndarray, labels: Sequence[str]) -> Rotation:
    """Given axes as they are, then the SVD of the data without each of them."""
    axes = np.asarray(axes, float).reshape(len(space.gram), -1)
    gram = space.gram
    unit = axes / np.linalg.norm(axes, axis=0)
    for a in unit.T:
        gram = remove(gram, a)
    values, vectors = eigen(gram)
    basis, _ = np.linalg.qr(unit)
    full = values > 1e-14 * max(values.max(initial=0.0), 1e-300)
    rest = np.hstack([vectors[:, full], _orthogonal_to(vectors[:, ~full], np.hstack([basis, vectors[:, full]]))])[:, : len(gram) - axes.shape[1]]
    m = axes.shape[1]
    whole = np.hstack([axes, rest])
    return Rotation(whole, [*labels, *_numbered(m + 1, rest.shape[1])], np.array([a @ space.gram @ a for a in whole.T]) / max(1, space.n - 1))


def means_rotation(space: Space, pairs: Sequence[tuple[Column, Column]], recenter: bool = True) -> Rotation:
    """Axes along the differences of the means of pairs of groups, each without those before it."""
    gram = space.gram
    if recenter:
        n, mean = space.mean()
        gram = gram - n * np.outer(mean, mean)
    axes: list[np.ndarray] = []
    for one, two in pairs:
        (n1, m1), (n2, m2) = space.mean(one), space.mean(two)
        if not n1 or not n2:
            raise ValueError("a group of the means rotation has no units")
        d = m1 - m2
        for a in axes:
            d = d - (d @ a) * a
        size = np.linalg.norm(d)
        if size < 1e-12:
            raise ValueError("the groups of the means rotation have the same mean")
        axes.append(d / size)
    return orthogonal_svd(Space(space.table, space.names, space.n, gram), np.array(axes).T, [f"MR{k + 1}" for k in range(len(axes))])


def group_pair(column: str, first, second) -> tuple[Column, Column]:
    return col(column) == F.lit(first), col(column) == F.lit(second)


# -------------------------------------------------------------- designs and slopes
@dataclass
class Design:
    """Columns of a model matrix, and the source of each."""

    table: DataFrame
    columns: list[str]
    source: list[frozenset[str]]


#: Values of a column of groups: more are no groups, and are refused rather than collected.
MOST_LEVELS = 10_000


def levels(table: DataFrame, column: str) -> list:
    found = [r[0] for r in table.select(col(column)).distinct().orderBy(col(column)).limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} values")
    return found


def is_numeric(table: DataFrame, column: str) -> bool:
    kind = dict(table.dtypes)[column]
    return any(kind.startswith(k) for k in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"))


def design(table: DataFrame, terms: Sequence[str], interactions: Sequence[tuple[str, str]] = (), centered: bool = False) -> Design:
    """Numeric columns as they are, others as dummies of their sorted levels but the first, and products of both."""
    made: dict[str, list[str]] = {}
    out, columns, source = table, [], []
    terms = list(dict.fromkeys(terms))
    for term in [*terms, *[t for pair in interactions for t in pair if t not in terms]]:
        if term in made:
            continue
        own = []
        if is_numeric(table, term):
            own = [f"__x_{term}"]
            out = out.withColumn(own[0], col(term).cast("double"))
        else:
            for k, level in enumerate(levels(table, term)[1:]):
                own.append(f"__x_{term}_{k}")
                out = out.withColumn(own[-1], F.when(col(term) == F.lit(level), 1.0).otherwise(0.0))
        made[term] = own
        if term in terms:
            columns += own
            source += [frozenset([term])] * len(own)
    if centered:
        n, total = sums(out, columns)
        for c, t in zip(columns, total):
            out = out.withColumn(c, col(c) - float(t / max(n, 1)))
    for a, b in interactions:
        for x in made[a]:
            for y in made[b]:
                columns.append(f"{x}:{y}")
                source.append(frozenset([a, b]))
                out = out.withColumn(columns[-1], col(x) * col(y))
    return Design(out, columns, source)


def slopes(space: Space, made: Design) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares coefficients of each connection on the design (with intercept), and the design's centered cross products."""
    n, x = sums(made.table, made.columns)
    _, v = sums(made.table, space.names)
    xx = cross(made.table, made.columns) - np.outer(x, x) / n
    xv = cross(made.table, made.columns, space.names) - np.outer(x, v) / n
    return solve(xx, xv), xx


def scatter(space: Space, column: str, axes: np.ndarray | None = None) -> np.ndarray:
    """Between-group scatter: sum over groups of n (m - mean)(m - mean)'."""
    rows = space.table.groupBy(col(column)).agg(F.count("*"), *[F.avg(col(c)) for c in space.names]).collect()
    n = np.array([r[1] for r in rows], float)
    m = np.array([[r[2 + k] for k in range(len(space.names))] for r in rows])
    d = m - (n @ m) / n.sum()
    if axes is not None:
        d = d - (d @ axes) @ axes.T
    return (d * n[:, None]).T @ d


def codes_of(space: Space, column: str, order: str) -> Design:
    """A categorical column as numbers 0, 1, ... in the order in which its values first appear."""
    seen = [r[0] for r in space.table.groupBy(col(column)).agg(F.min(order).alias("f")).orderBy("f").collect()]
    value = F.lit(None).cast("double")
    for k, level in enumerate(seen):
        value = F.when(col(column) == F.lit(level), float(k)).otherwise(value)
    return Design(space.table.withColumn("__code", value), ["__code"], [frozenset([column])])


def _unit(v: np.ndarray, what: str) -> np.ndarray:
    size = np.linalg.norm(v)
    if not size > 1e-12:
        raise ValueError(f"{what} has no direction in these networks")
    return v / size


def gmr_axis(space: Space, column: str, controls: Sequence[str] = (), categorical: str = "codes", order: str = "ENA_FIRST", before: np.ndarray | None = None) -> np.ndarray:
    """The direction in which the networks follow a variable, given controls.

    Without controls: the slope on a numeric variable; for a categorical one the slope
    on its codes, or the leading axis of the between-group scatter (``categorical="scatter"``).
    With controls: the leading axis of the part of the least-squares fit that is the variable's own.
    """
    numeric = is_numeric(space.table, column)
    if not controls:
        if numeric:
            axis = slopes(space, design(space.table, [column]))[0][0]
        elif categorical == "codes":
            axis = slopes(space, codes_of(space, column, order))[0][0]
        else:
            axis = eigen(scatter(space, column, before))[1][:, 0]
    else:
        terms = [column, *controls]
        made = design(space.table, terms, list(combinations(terms, 2)))
        b, xx = slopes(space, made)
        own = [k for k, s in enumerate(made.source) if s == frozenset([column])]
        axis = b[own[0]] if len(own) == 1 else eigen(b[own].T @ xx[np.ix_(own, own)] @ b[own])[1][:, 0]
    if before is not None:
        axis = axis - before @ (before.T @ axis)
    return _unit(axis, column)


def select_two(space: Space, column: str, groups: Sequence) -> Space:
    """The space of the rows of two groups."""
    table = space.table.where(col(column).isin(list(groups)))
    return Space.of(table, space.names)


def generalized_rotation(space: Space, x: str, y: str | None = None, controls: Sequence[str] = (), categorical: str = "codes", select_groups: Sequence | None = None, order: str = "ENA_FIRST") -> Rotation:
    """Generalised means rotation: an axis for x, one for y orthogonal to it, and the SVD of the rest."""
    fitted = select_two(space, x, select_groups) if select_groups else space
    first = gmr_axis(fitted, x, controls, categorical, order)
    axes, labels = [first], ["GMR1"]
    if y is not None:
        axes.append(gmr_axis(space, y, controls, categorical, order, before=first[:, None]))
        labels.append("GMR2")
    return complete_rotation(space, np.array(axes).T, labels)


def regression_rotation(space: Space, x: str, y: str | None = None, controls: Sequence[str] = ()) -> Rotation:
    """Axes along the slopes of the networks on x, and of the networks without that axis on y."""
    axes: list[np.ndarray] = []
    for target in [x] + ([y] if y else []):
        b = slopes(space, design(space.table, [target, *controls]))[0][0]
        for a in axes:
            b = b - (b @ a) * a
        axes.append(_unit(b, target))
    return orthogonal_svd(space, np.array(axes).T, [f"{t}_reg" for t in [x] + ([y] if y else [])])


def regression_rotation_2(space: Space, x: str, y: str | None = None, controls: Sequence[str] = (), interactions: Sequence[tuple[str, str]] = ()) -> Rotation:
    """Axes along the coefficients of x on the networks (least norm if they are not unique), controls and products of them held.

    What controls explain is taken from x and from the networks by their cross products (Frisch and Waugh), so
    that the coefficients of the networks are those of the whole regression.
    """
    axes: list[np.ndarray] = []
    held = design(space.table, list(controls), list(interactions)) if controls or interactions else None
    n, mean = space.mean()
    for target in [x] + ([y] if y else []):
        table = held.table if held else space.table
        made = design(table, [target]) if is_numeric(table, target) else codes_of(Space(table, space.names, space.n, space.gram), target, "ENA_FIRST")
        _, t = sums(made.table, made.columns[:1])
        gram = space.gram - n * np.outer(mean, mean)
        xv = cross(made.table, space.names, made.columns[:1])[:, 0] - mean * t[0]
        if held:
            _, total = sums(made.table, held.columns)
            cc = cross(made.table, held.columns) - np.outer(total, total) / n
            cv = cross(made.table, held.columns, space.names) - np.outer(total, mean)
            ct = cross(made.table, held.columns, made.columns[:1])[:, 0] - total * t[0] / n
            part = solve(cc, np.hstack([cv, ct[:, None]]))
            gram, xv = gram - cv.T @ part[:, :-1], xv - cv.T @ part[:, -1]
        for a in axes:
            gram, xv = remove(gram, a), xv - (xv @ a) * a
        b = np.linalg.lstsq(gram, xv, rcond=1e-10)[0]
        axes.append(_unit(b, target))
    return orthogonal_svd(space, np.array(axes).T, [f"{t}_reg" for t in [x] + ([y] if y else [])])


def hierarchical_rotation(space: Space, x: str, y: str | None = None, controls: Sequence[str] = (), centered: bool = True, interaction: bool = True) -> Rotation:
    """Slopes on x and y with controls in one model, x and y centered and their product taken in; y orthogonal to x."""
    terms = [t for t in [x, y, *controls] if t]
    made = design(space.table, terms, [(x, y)] if y and interaction else [], centered)
    b, _ = slopes(space, made)
    axes: list[np.ndarray] = []
    for target in [t for t in (x, y) if t]:
        v = b[next(k for k, s in enumerate(made.source) if s == frozenset([target]))]
        for a in axes:
            v = v - (v @ a) * a
        axes.append(_unit(v, target))
    return orthogonal_svd(space, np.array(axes).T, [f"{t}_h" for t in (x, y) if t])


def formula_terms(text: str) -> tuple[str, list[str], list[tuple[str, str]]]:
    """``target ~ a + b + a:b`` as its parts; V stands for the networks."""
    left, _, right = text.partition("~")
    parts = [p.strip() for p in right.split("+") if p.strip()]
    return left.strip(), [p for p in parts if ":" not in p], [tuple(q.strip() for q in p.split(":")) for p in parts if ":" in p]


def custom(space: Space, matrix: np.ndarray, labels: Sequence[str] | None = None) -> Rotation:
    matrix = np.asarray(matrix, float)
    if matrix.shape[0] != len(space.names):
        raise ValueError("the rotation has another number of rows than there are connections")
    labels = list(labels) if labels else [f"DIM{k + 1}" for k in range(matrix.shape[1])]
    return Rotation(matrix, labels, np.array([a @ space.gram @ a for a in matrix.T]) / max(1, space.n - 1))


def rotate(space: Space, rotation: str | np.ndarray | Callable[[Space], Rotation] = "svd", **options) -> Rotation:
    """The rotation of a name, a matrix, a function or a formula.

    ``V ~ x + a + x:a`` takes the slopes on its first term, the others held; ``x ~ V + a`` the coefficients of the networks.
    """
    if callable(rotation):
        return rotation(space, **options)
    if isinstance(rotation, np.ndarray):
        return custom(space, rotation, **options)
    if "~" in rotation:
        target, terms, products = formula_terms(rotation)
        if target == "V":
            made = design(space.table, terms, products)
            return orthogonal_svd(space, _unit(slopes(space, made)[0][0], terms[0]), [f"{terms[0]}_reg"])
        if "V" not in terms or any("V" in pair for pair in products):
            raise ValueError("a formula has V on one side, and not in a product")
        return regression_rotation_2(space, target, None, [t for t in terms if t != "V"], products)
    kinds = {"svd": svd, "means": means_rotation, "generalized": generalized_rotation, "regression": regression_rotation, "regression_2": regression_rotation_2, "hierarchical": hierarchical_rotation}
    if rotation not in kinds:
        raise ValueError(f"unknown rotation {rotation!r}")
    return kinds[rotation](space, **options)
