import math
import random

from codeweave.llm import knn


def slow(rows, k, every):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # a common vector: ties by id
    rows += [(2000, None), (2010, []), (2020, [None] + [1.0] * 7), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (None, [1.0] * 8), (2050, [1.0] * 5), (-10, [-1e-20] * 8)]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, score long, key string")
    got = sorted(map(tuple, knn.top_k(df, k=5, every=10, pivots=6, chunk=50).collect()))
    assert got == slow(rows, 5, 10)


def test_repeated_rows_of_a_query(spark):
    """Each row of a query's id is a query of its own, and none is its candidate."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-3.0, 1.0])] + [(i, [float(i), 8.0 - i]) for i in range(1, 8)] + [(7, [7.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for i, v in rows:
        if i == 0:
            scores = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), j) for j, w in rows if j)
            want += [(0, r + 1, j, -s) for r, (s, j) in enumerate(scores[:3])]
    assert sorted(map(tuple, knn.top_k(df, k=3, chunk=2).collect())) == sorted(want)


def test_copies_stay_few_for_clustered_vectors(spark):
    """Queries go to a small part of the rings that hold clusters, and no candidate is copied."""
    rng = random.Random(5)
    centers = [[rng.gauss(0, 8) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centers[rng.randrange(20)]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = knn.sound_vectors(df)
    rings, data, width, n = knn.plan(own, 5, None, 100)
    queries = own.where("vec_id % 50 = 0").select("vec_id", "v", "vec_id")
    sent = knn.routed(queries.toDF("vec_id", "v", "row"), rings, width).count()
    assert data.count() == n == 3000 and sent <= 0.2 * 60 * rings.pieces.sum()
    assert sorted(map(tuple, knn.top_k(df, chunk=100).collect())) == slow(rows, 5, 50)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, knn.top_k(few, every=2).collect())) == slow([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [3.0, 4.0])], 5, 2)
    for part in (few.limit(0), few.limit(1)):
        assert knn.top_k(part).count() == 0


def test_large_components(spark):
    rows = [(0, [2.0**60, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in knn.top_k(df).orderBy("rank").collect()] == [1, 2]
