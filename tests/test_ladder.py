"""The exact ladder against all draws of small groups, and against the seeded resamples."""

import itertools
import random

import numpy as np
import pytest

from sparkgrade.operators import metrics


def all_draws(rows, k):
    """rows: (vote, value). (mean, deviation) of best, worst and majority over every sequence of k rows."""
    got = {"best": [], "worst": [], "maj": []}
    for draw in itertools.product(rows, repeat=k):
        votes = [v for v, _ in draw]
        got["best"].append(max(x for _, x in draw))
        got["worst"].append(min(x for _, x in draw))
        got["maj"].append(draw[max(range(k), key=lambda i: (votes.count(votes[i]), -i))][1])
    return {what: (np.mean(x), np.std(x)) for what, x in got.items()}


def test_every_draw_of_small_groups(spark):
    r = random.Random(5)
    groups = {g: [(r.choice("abc" if g % 2 else "ab"), float(r.randrange(5))) for _ in range(n)] for g, n in enumerate((1, 2, 3, 4, 5, 5))}
    groups[6] = [(None, 1.0), (None, 3.0), ("a", 1.0), ("a", 1.0)]
    rows = [(g, v, x) for g, own in groups.items() for v, x in own] + [(0, "a", None), (9, "a", None)]
    got = metrics.resampling_ladder(spark.createDataFrame(rows, "g int, vote string, x double"), ["g"], "x", "vote").collect()
    want = {(g, k, what): m for g, own in groups.items() if len(own) > 1 for k in {2, len(own)} | ({4} if len(own) > 4 else set()) for what, m in all_draws(own, k).items()}
    assert {(x.g, x.k, x.what) for x in got} == set(want) and len(got) == len(want)
    for x in got:
        assert (x.mean, x.std) == pytest.approx(want[x.g, x.k, x.what], abs=1e-9), x


def test_resamples_come_near_the_moments_of_a_larger_group(spark):
    r = random.Random(9)
    rows = [("s", "u", i, r.randrange(4), r.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, u string, i int, vote int, v double")
    drawn = {x.metric: x.value for x in metrics.resampled_tree(df, "s", "u", ["v"], "i", "vote", draws=4000).collect()}
    for x in metrics.resampling_ladder(df, ["s", "u"], "v", "vote").collect():
        assert drawn[f"{x.what}@{x.k}/mean"] == pytest.approx(x.mean, abs=0.03) and drawn[f"{x.what}@{x.k}/std"] == pytest.approx(x.std, abs=0.03)
