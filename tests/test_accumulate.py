import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.functions import distributions as D
from codeweave.functions import layout as L
from codeweave.functions import times
from codeweave.operators import accumulate as A
from codeweave.operators import fit as M
from codeweave.operators import plotdata as P
from codeweave.operators import select as X
from codeweave.operators import tensor as T
from codeweave.operators import windows as W
from codeweave.sources import report, roles


def rows_of(acc):
    return [[r[n] for n in acc.names] for r in acc.lines.orderBy("ENA_FIRST").collect()]


def table(df, names):
    return {r["ENA_UNIT"]: [r[n] for n in names] for r in df.collect()}


# Rows (user, group, codes A, B, C, place), and rows (name, day, act, codes c1, c2, c3, place).
SIX = [
    ("User1", "g", 3, 0, 0, 0),
    ("User2", "g", 0, 1, 2, 1),
    ("User3", "g", 1, 0, 0, 2),
    ("User1", "g", 0, 0, 4, 3),
    ("User2", "g", 0, 2, 0, 4),
    ("User3", "g", 3, 0, 1, 5),
]
TWELVE = [
    ("J", 1, 1, 1, 1, 0, 0),
    ("Z", 1, 1, 1, 1, 0, 1),
    ("J", 1, 1, 1, 1, 1, 2),
    ("Z", 1, 1, 1, 0, 0, 3),
    ("J", 1, 2, 1, 0, 1, 4),
    ("Z", 1, 2, 0, 1, 0, 5),
    ("J", 2, 2, 0, 0, 1, 6),
    ("Z", 2, 2, 1, 1, 0, 7),
    ("J", 2, 3, 1, 0, 0, 8),
    ("Z", 2, 3, 0, 1, 0, 9),
    ("J", 2, 3, 0, 0, 1, 10),
    ("Z", 2, 3, 1, 0, 0, 11),
]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(u, g, float(a), float(b), float(c), n) for u, g, a, b, c, n in SIX], "user string, grp string, A double, B double, C double, seq long")


@pytest.fixture(scope="module")
def twelve(spark):
    return spark.createDataFrame(TWELVE, "name string, day int, act int, c1 int, c2 int, c3 int, seq long")


def test_window_rows(six):
    for weight, f in (("product", lambda x: x), ("sqrt", math.sqrt), ("log1p", math.log1p), (F.sqrt, math.sqrt)):
        got = rows_of(A.accumulate(six, ["user"], ["grp"], ["A", "B", "C"], ["seq"], back=3, weight=weight))
        assert np.allclose(got[0], 0) and np.allclose(got[2], [f(1), f(2), 0]) and np.allclose(got[5], [f(6), f(15), f(2)])


def test_forward_windows(twelve):
    for back, forward, want in ((0, math.inf, [4, 6, 4]), (5, 5, [5, 6, 6])):
        acc = A.accumulate(twelve, ["name"], ["day"], ["c1", "c2", "c3"], ["seq"], back=back, forward=forward)
        assert table(acc.counts, acc.names)["J"] == want


def test_weights_of_a_unit(spark):
    df = spark.createDataFrame([("x", "1", 2.0, 0.0, 1.0, 0), ("x", "1", 1.0, 3.0, 0.0, 1), ("x", "1", 0.0, 1.0, 2.0, 2)], "u string, conv string, A double, B double, C double, seq long")
    want = {"binary": [2, 3, 2], "product": [12, 9, 12], "sqrt": [4.73205080756888, 4.86370330515627, 4.73205080756888], "log": [3.68887945411394, 3.73766961828337, 3.68887945411394]}
    for weight, values in want.items():
        acc = A.accumulate(df, ["u"], ["conv"], ["A", "B", "C"], ["seq"], back=3, weight=weight)
        assert np.allclose(table(acc.counts, acc.names)["x"], values)


def test_trajectories(twelve):
    one = A.accumulate(twelve, ["name"], ["day", "act"], ["c1", "c2", "c3"], ["seq"], model="SeparateTrajectory")
    run = A.accumulate(twelve, ["name"], ["day", "act"], ["c1", "c2", "c3"], ["seq"], model="AccumulatedTrajectory")
    lines = A.accumulate(twelve, ["name"], ["day", "act"], ["c1", "c2", "c3"], ["seq"])
    last = {r.ENA_UNIT: r["c1 & c2"] for r in run.counts.orderBy("ENA_STEP").collect()}
    whole = table(lines.counts, lines.names)
    assert last == {u: v[0] for u, v in whole.items()}
    assert one.counts.count() == run.counts.count() == 8


def test_bad_input(twelve, six):
    ok = dict(units=["name"], conversation=["day"], codes=["c1", "c2"], order_by=["seq"])
    for change, error in (
        ({"codes": []}, ValueError), ({"codes": ["c1", "c1"]}, ValueError), ({"units": ["nope"]}, KeyError), ({"codes": ["c1", "name"]}, ValueError),
        ({"back": -1}, ValueError), ({"back": 2.5}, ValueError), ({"weight": "cube"}, ValueError), ({"order_by": ["day"]}, ValueError),
        ({"ordered": True, "forward": 1}, ValueError), ({"model": "x"}, ValueError), ({"window": "x"}, ValueError),
    ):
        with pytest.raises(error):
            A.accumulate(twelve, **(ok | change))
    for df in (twelve.withColumn("c1", F.when(F.col("seq") > 3, F.col("c1"))), twelve.withColumn("name", F.when(F.col("seq") > 3, F.col("name"))), six.withColumn("A", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            A.accumulate(df, **(ok if "c1" in df.columns else dict(units=["user"], conversation=["grp"], codes=["A", "B"], order_by=["seq"])))
    with pytest.raises(ValueError):
        A.check_keys(twelve.sparkSession.createDataFrame([("a__b", "c"), ("a", "b__c")], "x string, y string"), ["x", "y"])


def test_layouts():
    assert L.triangle_indices(3) == ([0, 0, 1], [1, 2, 2])
    assert L.pair_names(["A", "B"], "self") == ["A & A", "A & B", "B & B"]
    assert L.pair_names(["A", "B"], "ordered") == ["A & A", "B & A", "A & B", "B & B"]
    assert [L.infer_layout(n, 3) for n in (3, 6, 9)] == list(L.LAYOUTS)
    assert L.vector_to_ut([1, 2, 3]) == [2, 3, 6]
    assert L.masked(["A", "B", "C"], "unordered", [[1, 1, 1], [0, 1, 1], [1, 1, 1]]) == {0} and L.masked(["A", "B", "C"], "unordered", [[1, 1, 1], [0, 1, 1], [1, 1, 1]], upper_only=True) == set()


def test_empty_network_stays_at_the_origin(spark):
    df = spark.createDataFrame([("a", "1", 1.0, 1.0, 0.0, 0), ("b", "2", 1.0, 0.0, 1.0, 1), ("c", "3", 0.0, 1.0, 1.0, 2), ("zero", "4", 1.0, 0.0, 0.0, 3), ("d", "5", 1.0, 1.0, 1.0, 4)], "u string, conv string, x double, y double, z double, seq long")
    m = M.fit(A.accumulate(df, ["u"], ["conv"], ["x", "y", "z"], ["seq"]))
    assert np.allclose(m.point("zero"), 0) and np.allclose(m.centroid("zero"), 0)
    text = report.methods_report(m)
    assert "5 units" in text and len(list(report.report_stream(m))) == 2
    with pytest.raises(KeyError):
        m.point("nobody")
    edges, nodes = P.network(m, P.mean_network(m))
    assert edges[0]["width"] == 1.0 and len(nodes) == 3


def test_constant_tensor_is_a_window(twelve):
    args = (["name"], ["day"], ["c1", "c2", "c3"], ["seq"])
    plain = A.accumulate(twelve, *args, back=3)
    tensor = T.Tensor([("name", "sender")], {("J",): (1.0, 3), ("Z",): (1.0, 3)}, (1.0, 3))
    assert tensor.constant
    forced = T.Tensor([("name", "receiver")], {("J",): (1.0, 3), ("Z",): (1.0, 3)}, (1.0, 9))
    want = table(plain.counts, plain.names)
    for t in (tensor, forced):
        got = T.accumulate_tensor(twelve, *args, t)
        assert table(got.counts, got.names) == want


def test_horizon_pieces(spark):
    df = spark.createDataFrame([("a", "1", "x", 0), ("a", "1", "y", 1), ("b", "1", "y", 2), ("a", "2", "y", 3)], "m string, g string, u string, seq long")
    got = {}
    for r in T.horizon_lines(df, ["u"], "m", {"a": ["g"]}).orderBy("seq").collect():
        got.setdefault((r.ENA_UNIT, r.ENA_CONV), []).append(r.seq)
    assert got == {("x", "1"): [0, 1], ("y", "1"): [0, 1], ("y", "2"): [3]}
    with pytest.raises(ValueError):
        T.horizon_lines(df, ["u"], "m", {"a": []})


def test_times(spark):
    want = {"01:30": 90, "1:02:03": 3723, "2025-01-23 12:37:13": 1737635833, "23/01/2025": 1737590400, "01/02/2025": 1738368000, "9/17/2013": 1379376000, "31/02/2020": None, "next tuesday": None, "9/17/13 09:43": 1379410980, "1/1/70 00:00": 0, "1/1/68 00:00": 3092601600}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.s for r in df.select("t", times.parse_seconds(F.col("t")).alias("s")).collect()}
    assert got == want
    assert [times.seconds_per_unit(u) for u in ("lines", "'mins'", "hour", "weeks")] == [None, 60, 3600, 604800]
    with pytest.raises(ValueError):
        times.seconds_per_unit("fortnights")


def test_ground_types(spark):
    a, b = [0, 1, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0], [1, 0, 0, 1, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0]
    df = spark.createDataFrame([(f"C{1 + k // 7}", a[k], b[k], k) for k in range(14)], "conv string, A int, B int, seq long")
    got = W.ground_types(df, ["A", "B"], ["conv"], ["seq"], 4).collect()
    for w in range(1, 5):
        want = {}
        for k in range(14):
            low = max(7 * (k // 7), k - w + 1)
            key = (f"C{1 + k // 7}", max(a[low : k + 1]) + 2 * max(b[low : k + 1]))
            want[key] = want.get(key, 0) + 1
        assert {(r.conversation, r.ground_type): r.n for r in got if r.window == w} == want


def test_lagged_codes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(2):
        a = rng.integers(0, 2, 40)
        rows += [(f"c{c}", float(a[k]), float(a[k - 1]) if k else 0.0, float(rng.integers(0, 2)), k) for k in range(40)]
    df = spark.createDataFrame(rows, "conv string, A double, B double, C double, seq long")
    assert W.lag_window(df, ["A", "B", "C"], ["conv"], ["seq"], 5, 10).peak_lag == 1


def test_distributions():
    assert abs(D.t_quantile(0.975, 10) - 2.2281388519649385) < 1e-9
    assert abs(D.t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(D.normal_quantile(0.975) - 1.959963984540054) < 1e-9


def test_roles(spark):
    df = spark.createDataFrame([(f"u{k % 5}", f"s{k % 3}", k % 2, (k // 2) % 2, (k // 3) % 2, f"text number {k} " * (k + 1)) for k in range(60)], "user string, session string, a int, b int, c int, text string")
    d = roles.define(df, ["text"], ["a", "b"], ["session"], ["user"])
    assert roles.find_codes(d) == ["a", "b"] and roles.find_metadata(d) == ["text"] and roles.remove_metadata(d).columns == ["a", "b", "c"]
    assert roles.find_binary(df) == ["a", "b", "c"]
    found = roles.detect(df)
    assert found["codes"] == ["a", "b", "c"] and found["units"][0]["column"] == "user" and found["conversations"][0]["column"] == "session" and found["roles"]["text"] == "metadata" and found["confidence"] == "medium"


def test_lines_behind_a_connection(twelve):
    found = X.connection_lines(twelve, ["J"], ["name"], ["c1", "c3"], ["day"], ["seq"], 2)
    assert sorted(r.seq for r in found.matched.collect()) == [2, 4]
    assert sorted(r.seq for r in found.windows.collect()) == [1, 2, 3, 4]
    assert found.unit_lines.count() == found.matched.count() + found.removed.count()


def test_stream_is_the_batch(spark, tmp_path, twelve):
    from codeweave.streaming.lines import stream_lines

    twelve.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(twelve.schema).parquet(f"{tmp_path}/in")
    out = stream_lines(source, ["name"], ["day"], ["c1", "c2", "c3"], "seq", back=3)
    q = out.writeStream.format("memory").queryName("stream_lines").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    acc = A.accumulate(twelve, ["name"], ["day"], ["c1", "c2", "c3"], ["seq"], back=3)
    got = {r.seq: [r[n] for n in acc.names] for r in spark.sql("select * from stream_lines").collect()}
    assert got == {r.ENA_FIRST.o0: [r[n] for n in acc.names] for r in acc.lines.collect()}


# ---------------------------------------------------- keys, levels, units as tables
def test_keys_never_collide(spark):
    rows = [("u", "a::b", "c", 1, 0, 0), ("u", "a", "b::c", 0, 1, 1), ("u", None, "x", 1, 0, 2), ("u", "%00", "x", 0, 1, 3), ("u", "y:", ":z", 1, 0, 4), ("u", "y", "::z", 0, 1, 5)]
    df = spark.createDataFrame(rows, "u string, k1 string, k2 string, A int, B int, seq long")
    assert df.select(A.composite(["k1", "k2"]).alias("k")).distinct().count() == 6
    acc = A.accumulate(df, ["u"], ["k1", "k2"], ["A", "B"], ["seq"], back=4, check_rows=False)
    assert acc.counts.first()["A & B"] == 0
    with pytest.raises(ValueError, match="join"):
        A.check_keys(df.where("seq < 2"), ["k1", "k2"], "::")
    assert df.limit(1).select(A.composite(["u", "A"]).alias("k")).first().k == "u::1"


def test_unknown_levels_are_errors(twelve):
    args = twelve, ["name"], ["day"], ["c1", "c2", "c3"], ["seq"]
    half = T.Tensor([("name", "sender")], {("J",): (1.0, 2)}, (1.0, 4))
    with pytest.raises(ValueError, match="does not know"):
        T.accumulate_tensor(*args, half)
    assert T.accumulate_tensor(*args, half, levels={"name": ["J", "Z"]}).counts.count() == 2


def test_units_as_a_table_and_options_of_trajectories(spark, twelve):
    args = ["name"], ["day"], ["c1", "c2", "c3"], ["seq"]
    wanted = spark.createDataFrame([("J",)], "who string")
    mask = np.ones((3, 3), int)
    mask[0, 1] = 0
    one = A.accumulate(twelve, *args, units_used=wanted, mask=mask, misses=True, metadata=["act"])
    two = A.accumulate(twelve, *args, units_used=["J"], mask=mask, misses=True, metadata=["act"])
    assert table(one.counts, one.names) == table(two.counts, two.names) and set(table(one.counts, one.names)) == {"J"}
    steps = A.as_trajectory(twelve, one, ["act"], ["seq"])
    assert steps.misses is not None and steps.metadata is not None and {r["ENA_UNIT"] for r in steps.counts.collect()} == {"J"}
    assert all(r["c1 & c2"] == 0 for r in steps.counts.collect())
    tensor = T.Tensor([("name", "sender")], {("J",): (1.0, 2), ("Z",): (1.0, 3)}, (1.0, 4))
    assert A.as_trajectory(twelve, T.accumulate_tensor(twelve, *args, tensor), ["act"], ["seq"]).counts.count() == 6


def test_exact_u():
    assert abs(D.u_two_sided(0, 3, 4) - 2 / 35) < 1e-12 and D.u_two_sided(6, 3, 4) == 1.0 and abs(D.u_two_sided(2, 5, 5) - 2 * 4 / 252) < 1e-12
