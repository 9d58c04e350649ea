"""Delta Lloyd against plain Lloyd in Python integers, and odd inputs."""

import hashlib
import math
import random

import numpy as np
import pytest

from sparkgrade.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v string, owner string"


def rows_of(vectors):
    return [(i, v, 0, "r", "v", "o") for i, v in vectors]


def plain(vectors, clusters, rounds, dimensions):
    """Lloyd's rule as it is stated, on (id, integers)."""
    key = lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest(), p[1])
    centroids = [list(v) for _, v in sorted(vectors, key=key)[:clusters]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((apart(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in vectors]
        for k in range(len(centroids)):
            own = [v for (_, v), o in zip(vectors, owners, strict=True) if o == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, *reversed(nearest(v))) for i, v in vectors], centroids


@pytest.mark.parametrize("rounds", [0, 1, 4, 10])
def test_equals_plain_lloyd(spark, rounds):
    draw = random.Random(5)
    vectors = [(i, [draw.choice((-0.25, 0.1, 0.5)) + draw.gauss(0, 0.2) for _ in range(6)]) for i in range(300)]
    vectors += [(7, vectors[7][1])] * 3 + [(None, vectors[9][1]), (400, vectors[11][1])]  # repeated rows, a null id, one vector under two ids
    got = clustering.cluster(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5), clusters=5, rounds=rounds, dimensions=6).collect()
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors]
    want, centroids = plain(whole, 5, rounds, 6)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    assert order((r.vec_id, r.cluster, r.distance) for r in got) == order(want)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    for r in got:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_odd_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, 0.25]), (2, None), (3, []), (4, [0.5]), (5, [0.5, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [0.0, -inf]), (9, [0.5, 0.25, 0.0]), (10, [-0.5, 0.0])]
    got = clustering.cluster(spark.createDataFrame(rows_of(vectors), SCHEMA), dimensions=2).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(1, 0), (10, 0)]  # two vectors: two clusters of eight
    assert len({r.cluster for r in got}) == 2


def test_no_vectors(spark):
    assert clustering.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert clustering.cluster(spark.createDataFrame(rows_of([(1, None)]), SCHEMA)).collect() == []


def test_large_components_are_exact_or_refused(spark):
    far = [(1, [100_000.0, 0.0]), (2, [-100_000.0, 1.0]), (3, [99_000.0, 0.0])]
    got = {r.vec_id: r for r in clustering.cluster(spark.createDataFrame(rows_of(far), SCHEMA), clusters=1, rounds=1, dimensions=2).collect()}
    want, _ = plain([(i, [math.floor(1024 * x) for x in v]) for i, v in far], 1, 1, 2)
    assert [(i, got[i].cluster, got[i].distance) for i in (1, 2, 3)] == want
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(spark.createDataFrame(rows_of([(1, [1e30, 0.0])]), SCHEMA), dimensions=2).collect()


def test_a_vector_whose_owner_stays_meets_changed_centroids_alone():
    centroids = np.array([[0, 0], [10, 0], [3, 0]])
    owner, held = clustering._nearest(np.array([[1, 0], [9, 0], [2, 0]]), np.array([0, 1, 0]), np.array([1, 1, 4]), centroids, np.array([False, False, True]))
    assert owner.tolist() == [0, 1, 2] and held.tolist() == [1, 1, 1]
