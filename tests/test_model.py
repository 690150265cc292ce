"""The toy model whose numbers were worked out once and for all."""

import numpy as np
import pytest

from codeweave.functions import layout as L
from codeweave.operators import accumulate as A
from codeweave.operators import fit as M
from codeweave.operators import nodes as N
from codeweave.operators import rotate as R
from codeweave.operators import stats as S

# Rows (unit, conversation, codes A, B, C, place) and the numbers of their model.
ROWS = [
    ("x", "1", 2, 0, 1, 0),
    ("x", "1", 1, 3, 0, 1),
    ("x", "1", 0, 1, 2, 2),
    ("y", "2", 1, 1, 0, 3),
    ("y", "2", 1, 0, 1, 4),
    ("z", "3", 1, 1, 0, 5),
    ("w", "4", 0, 1, 1, 6),
    ("w", "4", 1, 1, 0, 7),
    ("v", "5", 1, 0, 1, 8),
    ("v", "5", 0, 1, 1, 9),
    ("v", "5", 1, 1, 0, 10),
]
ORDERED = [[2, 1.5, 2, 10.5, 3, 5, 7, 7, 2], [1, 1.5, 0.5, 0.5, 0, 0, 1.5, 1, 0], [0, 0.5, 0, 0.5, 0, 0, 0, 0, 0], [0, 1.5, 1, 0.5, 1, 1.5, 0, 0.5, 0], [1, 1.5, 2.5, 2.5, 1, 3.5, 1.5, 0.5, 1]]
POINTS = [[-0.0198167962873098, -0.342333571996956], [0.356850738095506, -0.350556385497795], [0.447386401038135, 0.464959175048637], [-0.393143559416237, 0.278575634087865], [-0.391276783430095, -0.0506448516417511]]
NODES = [[1.8571194903539, -0.683406305961015], [-0.93090817324194, 1.60659524495341], [-1.48168191522659, -1.61509053060306]]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(u, c, float(a), float(b), float(d), s) for u, c, a, b, d, s in ROWS], "u string, conv string, A double, B double, C double, seq long")


def accumulate(df, **options):
    return A.accumulate(df, ["u"], ["conv"], ["A", "B", "C"], ["seq"], back=3, weight="product", **options)


def table(df, names):
    return np.array([[r[n] for n in names] for r in df.orderBy("ENA_FIRST").collect()])


def up_to_sign(got, want):
    for k in range(want.shape[1]):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-9


def test_ordered_model(toy):
    acc = accumulate(toy, ordered=True)
    assert np.allclose(table(acc.counts, acc.names), ORDERED)
    assert acc.names[1] == "B & A"
    m = M.fit(acc)
    up_to_sign(table(m.points, m.dimensions), np.array(POINTS))
    up_to_sign(m.rotation.nodes, np.array(NODES))


def test_folds(toy):
    o = np.array(ORDERED).reshape(5, 3, 3)
    plain = accumulate(toy)
    assert np.allclose(table(plain.counts, plain.names), [[o[u, i, j] + o[u, j, i] for i, j in L.index_pairs(3)] for u in range(5)])
    own = accumulate(toy, self_connections=True)
    assert np.allclose(table(own.counts, own.names), [[o[u, i, i] if i == j else o[u, i, j] + o[u, j, i] for i, j in L.index_pairs(3, "self")] for u in range(5)])


def test_moved_nodes_keep_centroids_in_step(toy):
    m = M.fit(accumulate(toy))
    for mode in ("radial", "equal"):
        moved = M.move_nodes(m, mode=mode)
        size = np.linalg.norm(moved.rotation.nodes, axis=1)
        assert np.allclose(size, np.linalg.norm(m.rotation.nodes, axis=1).max())
        assert moved.centroids.count() == 5
    with pytest.raises(ValueError):
        N.unit_circle(m.rotation.nodes, 0, 0)


def test_rotations_are_orthonormal(toy):
    acc = accumulate(toy, ordered=True)
    m = M.fit(acc)
    space = R.Space.of(m.centered.withColumn("x", m.centered.ENA_UNIT.isin("x", "w").cast("double")).withColumn("g", m.centered.ENA_UNIT), acc.names)
    pair = R.group_pair("x", 1.0, 0.0)
    for r in (R.svd(space), R.means_rotation(space, [pair]), R.generalized_rotation(space, "x"), R.generalized_rotation(space, "g", categorical="scatter"), R.regression_rotation(space, "x"), R.regression_rotation_2(space, "x"), R.hierarchical_rotation(space, "x")):
        assert np.allclose(r.matrix.T @ r.matrix, np.eye(r.matrix.shape[1]), atol=1e-8)
    n1, m1 = space.mean(pair[0])
    n2, m2 = space.mean(pair[1])
    mr = R.means_rotation(space, [pair])
    assert mr.labels[:2] == ["MR1", "SVD2"]
    assert abs((m1 - m2) @ mr.matrix[:, 1]) < 1e-9
    with pytest.raises(ValueError):
        R.means_rotation(space, [(pair[0], pair[0])])


def test_rotation_set_round_trip(toy, tmp_path):
    from codeweave.model import RotationSet

    acc = accumulate(toy)
    m = M.fit(acc)
    m.rotation.save(str(tmp_path / "set.json"))
    again = M.fit(acc, rotation_set=RotationSet.load(str(tmp_path / "set.json")))
    assert np.allclose(table(again.points, again.dimensions), table(m.points, m.dimensions))
    other = A.accumulate(toy, ["u"], ["conv"], ["C", "A", "B"], ["seq"], back=3, weight="product")
    assert np.allclose(table(M.fit(other, rotation_set=m.rotation).points, m.dimensions), table(m.points, m.dimensions))


def test_fit_correlation_is_that_of_all_pairs(toy):
    m = M.fit(accumulate(toy))
    p, c = table(m.points, m.dimensions), table(m.centroids, m.dimensions)
    got = S.fit_correlation(m.points, m.centroids, m.dimensions, ["ENA_UNIT"], "ENA_FIRST")
    both = S.pair_correlations(m.points, m.centroids, m.dimensions, ["ENA_UNIT"], "ENA_FIRST")
    for k, d in enumerate(m.dimensions):
        x = [p[i, k] - p[j, k] for i in range(5) for j in range(i + 1, 5)]
        y = [c[i, k] - c[j, k] for i in range(5) for j in range(i + 1, 5)]
        assert abs(got[d][0] - np.corrcoef(x, y)[0, 1]) < 1e-9
        assert abs(both[d][0] - got[d][0]) < 1e-9 and -1 <= both[d][1] <= 1
