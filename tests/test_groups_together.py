"""Small groups go through Python by the batch: the same results as one by one, and no call a group."""

import random

import numpy as np
import pytest

from sparkgrade.operators import metrics, packing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_of_groups_of_one_size(spark):
    r = random.Random(2)
    groups = {g: [float(r.randrange(20)) for _ in range(1 + g % 5)] for g in range(40)} | {40: [1.0, None, 3.0]}
    rows = [(g, i, x) for g, own in groups.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g int, i int, x double")
    got = metrics.bootstrap(df, ["g"], "x", 3, "i", draws=20)
    assert "FlatMapGroupsInPandas" not in plan(got)
    got = {x.g: x for x in got.collect()}
    assert set(got) == set(groups) and got[40].n == 3 and got[40].best is None
    for g in range(40):
        np.random.seed(42)
        drawn = np.array(groups[g])[np.random.choice(len(groups[g]), size=(20, 3), replace=True)]
        top, low = drawn.max(1), drawn.min(1)
        assert tuple(got[g])[1:] == pytest.approx((len(groups[g]), top.mean(), top.std(), low.mean(), low.std()), abs=1e-12)


def test_resampled_majorities_and_null_votes(spark):
    r = random.Random(3)
    groups = {u: [(r.choice(("a", "b", None)), float(r.randrange(9))) for _ in range(1 + u % 7)] for u in range(60)} | {60: [(None, 1.0), (None, 2.0)]}
    rows = [("s", u, i, v, x) for u, own in groups.items() for i, (v, x) in enumerate(own)]
    got = metrics.resampled_tree(spark.createDataFrame(r.sample(rows, len(rows)), "s string, u int, i int, v string, x double"), "s", "u", ["x"], "i", "v", draws=30)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = {}
    for own in groups.values():
        n = len(own)
        for k in {2, 4, n} if n > 4 else {2, n} if n > 1 else ():
            np.random.seed(42)
            told = {"best": [], "worst": [], "maj": []}
            for draw in np.random.choice(n, size=(30, k), replace=True):
                votes, x = [own[i][0] for i in draw], [own[i][1] for i in draw]
                told["best"].append(max(x))
                told["worst"].append(min(x))
                told["maj"].append(x[max(range(k), key=lambda j: (votes.count(votes[j]), -j))])
            for kind, some in told.items():
                want.setdefault(f"{kind}@{k}/mean", []).append(np.mean(some))
                want.setdefault(f"{kind}@{k}/std", []).append(np.std(some))
    got = {x.metric: x.value for x in got.collect() if "/" in x.metric}
    assert set(got) == set(want)
    for metric, some in want.items():
        assert got[metric] == pytest.approx(np.mean(some), abs=1e-12), metric


def test_chances_are_shared_by_groups_of_equal_counts(spark):
    rows = [(g, v, float(g * v)) for g in range(300) for v in (0, 1, 1, 2)]
    metrics.majority_chances.cache_clear()
    assert metrics.majority_moments([1, 2, 1], [0.0, 1.0, 2.0], [0.0, 0.0, 0.0], [2, 4]) == metrics.majority_moments([2, 1, 1], [1.0, 0.0, 2.0], [0.0, 0.0, 0.0], [2, 4])
    assert metrics.majority_chances.cache_info().misses == 2 and sum(metrics.majority_chances((1, 1, 2), 4)) == pytest.approx(1)
    got = metrics.resampling_ladder(spark.createDataFrame(rows, "g int, v int, x double"), ["g"], "x", "v").where("what = 'maj' AND k = 4").collect()
    assert len(got) == 300 and all(x.mean == pytest.approx(x.g) for x in got)


@pytest.mark.parametrize("rows_a_batch", [1, 3, 10_000])
def test_several_ways_in_one_pass_over_batch_borders(spark, rows_a_batch):
    r = random.Random(4)
    groups = {g: [r.randrange(1, 50) for _ in range(r.randrange(1, 9))] for g in [*range(30), None]}
    rows = [(g, i, x, {"a": 1}) for g, own in groups.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g int, i int, load long, more map<string, int>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = packing.partition(df, ["g"], "i", "load", {"one": lambda x: packing.greedy(x, 3), "two": lambda x: packing.differencing(x, 2)})
        assert "FlatMapGroupsInPandas" not in plan(got)
        found = sorted((x.g is None, x.g or 0, x.i, x.load, x.one, x.two, x.more["a"]) for x in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(g is None, g or 0, i, x, a, b, 1) for g, own in groups.items() for i, (x, a, b) in enumerate(zip(own, packing.greedy(own, 3), packing.differencing(own, 2)))]
    assert found == sorted(want)
