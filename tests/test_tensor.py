"""Horizons and windows of tensors against slow versions, with plans that make no pairs and no copies for units."""

import math

import numpy as np
import pyarrow as pa
import pytest

from codeweave.operators import tensor as T
from codeweave.plans import sweep


def by_unit(df, names):
    return {r["ENA_UNIT"]: [r[n] for n in names] for r in df.collect()}


def slow_horizons(df, rules, back):
    """Counts under ``product`` from the contexts of all units, line by line."""
    pieces, out = {}, {}
    for r in sorted(T.horizon_lines(df, ["u"], "m", rules).collect(), key=lambda r: r.seq):
        pieces.setdefault((r.ENA_UNIT, r.ENA_CONV), []).append(r)
    for (unit, _), rows in pieces.items():
        for n, r in enumerate(rows):
            if r["__own"] == unit:
                h = [sum(g[c] for g in rows[max(0, n - back + 1) : n]) for c in "AB"]
                out[unit] = out.get(unit, 0.0) + r.A * r.B + r.A * h[1] + h[0] * r.B
    return out


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(7)
    pick = lambda values: [None if v == "-" else v for v in rng.choice(list(values), 300)]
    rows = list(zip(pick("abcde-"), pick("pqrs"), pick("xyz-"), pick("123-"), rng.integers(0, 3, 300).tolist(), rng.integers(0, 2, 300).tolist(), range(300)))
    return spark.createDataFrame(rows, "u string, m string, g string, k string, A int, B int, seq long")


@pytest.mark.parametrize("rules", [{"p": ["g"]}, {"p": ["g"], "q": ["g"]}])
def test_one_horizon_is_not_copied_to_units(talk, rules):
    for back in (1, 4, 1000):
        acc = T.accumulate_horizons(talk, ["u"], ["A", "B"], ["seq"], "m", rules, back=back, weight="product")
        assert {u: v[0] for u, v in by_unit(acc.counts, acc.names).items()} == slow_horizons(talk, rules, back)
    assert "Join" not in acc.counts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rules", [{"p": ["g"], "q": ["k"]}, {"p": ["g", "k"], "q": ["k"], "s": ["m"]}, {"p": ["k", "u"], "r": ["g"]}])
def test_rules_on_other_columns_are_not_copied_to_units(talk, rules):
    acc = T.accumulate_horizons(talk, ["u"], ["A", "B"], ["seq"], "m", rules, back=4, weight="product")
    assert {u: v[0] for u, v in by_unit(acc.counts, acc.names).items()} == slow_horizons(talk, rules, 4)
    assert "Join" not in acc.counts._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        T.accumulate_horizons(talk, ["u"], ["A", "B"], ["seq"], "m", rules | {"z": []})


def slow_grounds(rows, near, weight):
    """Counts under ``product`` by pairs of lines; rows have c, at, n, f, A, B."""
    out = {}
    for r in rows:
        ground = [g for g in rows if g["c"] == r["c"] and g["n"] < r["n"] and near(r, g)]
        h = [sum(weight(r, g) * g[x] for g in ground) for x in "AB"]
        own = weight(r, r)
        out[r["u"]] = out.get(r["u"], 0.0) + own * r["A"] * r["B"] + r["A"] * h[1] + h[0] * r["B"]
    return out


@pytest.fixture(scope="module")
def clock(spark):
    """One long conversation and many short ones; times tie and run back, and windows end on them."""
    rng = np.random.default_rng(11)
    rows = []
    for n in range(1500):
        late = int(rng.choice([0, 0, 0, 600, -300, 5000]))
        rows.append({"u": f"u{n % 7}", "c": "long" if n % 5 else f"s{n // 20}", "at": 1.7e9 + n // 3 * 40 + late, "n": n, "f": "xy"[int(rng.integers(2))], "A": float(rng.integers(0, 3)), "B": float(rng.integers(0, 2))})
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], "u string, c string, at double, n long, f string, A double, B double")


def test_time_windows_out_of_order_make_no_pairs(clock):
    rows, df = clock
    acc = T.accumulate_tensor(df, ["u"], ["c"], ["A", "B"], ["n"], T.Tensor(default=(1.0, 10), time="at", time_unit="mins"), "product", numeric_time=True)
    assert {u: v[0] for u, v in by_unit(acc.counts, acc.names).items()} == slow_grounds(rows, lambda r, g: r["at"] - g["at"] < 600, lambda r, g: 1.0)
    assert "Join" not in acc.counts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("time", [None, "at"])
@pytest.mark.parametrize("roles", [["sender"], ["receiver"], ["mode", "receiver"]])
def test_wide_windows_of_cells_make_no_pairs(clock, time, roles):
    """Windows and weights that depend on both lines, infinite and empty ones among them."""
    rows, df = clock
    windows = iter([(2.0, math.inf), (1.0, 0), (0.5, 700), (1.0, 65)])
    cells = {key: next(windows) for key in ([("x",), ("y",)] if len(roles) == 1 else [(a, b) for a in "xy" for b in "xy"])}
    side = lambda r, g: tuple((r if role == "receiver" else g)["f"] for role in roles)
    places = {}
    for r in rows:
        places[r["n"]] = r["at"] if time else sum(x["c"] == r["c"] and x["n"] < r["n"] for x in rows)
    acc = T.accumulate_tensor(df, ["u"], ["c"], ["A", "B"], ["n"], T.Tensor([("f", x) for x in roles], cells, (1.0, 4), time), "product", numeric_time=True)
    want = slow_grounds(rows, lambda r, g: places[r["n"]] - places[g["n"]] < cells[side(r, g)][1], lambda r, g: cells[side(r, g)][0])
    assert {u: v[0] for u, v in by_unit(acc.counts, acc.names).items()} == want
    assert "Join" not in acc.counts._jdf.queryExecution().optimizedPlan().toString()


def test_rounded_places_and_values_that_are_not_finite():
    at = np.sort(np.round(np.random.default_rng(2).random(500), 2) * 0.7)
    for window in (0.1, 0.3, 0.0, math.inf):
        line = np.concatenate([at, at + window, [math.inf, -math.inf]])
        k = sweep.first_within(at, line, np.full(len(line), window))
        assert [int(x) for x in k] == [len(at) - int((x - at < window).sum()) for x in line]
    n = np.arange(1, 1501, dtype="int32")
    v = np.where(n == 1000, np.nan, 1.0)
    zero = np.zeros(1500, "int32")
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (n, n * 1.0, n * 1.0, zero, zero, v)], names=["__n", "__at", "__low", "__g", "__r", "x"])
    parts = [batch.slice(0, 700), batch.slice(700, 3), batch.slice(703)]
    got = np.concatenate([b.column("__h0").to_numpy() for b in sweep.window_sums(["x"], np.array([[101.0]]), np.array([[1.0]]))(iter(parts))])
    want = [v[max(0, k - 100) : k].sum() for k in range(1500)]
    assert np.array_equal(got, want, equal_nan=True) and np.isnan(got).sum() == 100
