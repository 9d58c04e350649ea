"""Estimators, folds and registries against direct formulas."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrade.functions.registry import ADVANTAGES, Registry
from sparkgrade.operators import advantages as adv
from sparkgrade.operators import sequences

ROWS = [("a", 1, 1.0, 2), ("a", 2, 3.0, 4), ("a", 3, 3.0, 1), ("b", 4, 5.0, 3), ("c", 5, 2.0, 1), ("c", 6, 2.0, 2)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, i int, s double, len int")


def by_i(df):
    return {r.i: r.advantage for r in df.collect()}


def test_grpo_keeps_a_single_score_and_zeroes_a_constant_group(rows):
    got = by_i(adv.grpo(rows, "g", "s"))
    a = [1.0, 3.0, 3.0]
    assert got[1] == pytest.approx((1 - statistics.mean(a)) / (statistics.stdev(a) + 1e-6))
    assert got[4] == pytest.approx(5 / (1 + 1e-6)) and got[5] == got[6] == 0


def test_rloo_variants_differ_on_single_rows(rows):
    assert by_i(adv.rloo(rows, "g", "s"))[4] == 5 and by_i(adv.rloo_vectorized(rows, "g", "s"))[4] == 0
    assert by_i(adv.rloo(rows, "g", "s"))[1] == pytest.approx(1 - 3)


def test_opo_and_gpg(rows):
    assert by_i(adv.opo(rows, "g", "s", "len"))[1] == pytest.approx(1 - (2 + 12 + 3) / 7)
    assert by_i(adv.gpg(rows, "g", "s"))[1] == pytest.approx(1 - 7 / 3)


def test_passk_needs_two_rows(rows):
    with pytest.raises(Exception, match="two rows"):
        adv.passk(rows, "g", "s", ["i"]).collect()
    got = by_i(adv.passk(rows.where("g <> 'b'"), "g", "s", ["i"]))
    assert got[2] == 0 and got[1] == 0  # the best two are equal


def test_whitening(rows):
    x = np.array([r[2] for r in ROWS])
    got = [r.s for r in adv.whiten(rows, "s").orderBy("i").collect()]
    assert np.allclose(got, (x - x.mean()) / np.sqrt(x.var(ddof=1) + 1e-8))


def test_results_do_not_depend_on_partitions(rows):
    for name in ("grpo", "rloo", "reinforce_pp_baseline"):
        one, many = (by_i(ADVANTAGES[name](rows.repartition(n), "g", "s")) for n in (1, 5))
        assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_registry_refuses_a_second_function():
    r = Registry()
    r.register("x")(len)
    with pytest.raises(ValueError):
        r.register("x")(sum)
    with pytest.raises(KeyError):
        r.resolve("y")


def test_kl_controller():
    assert adv.kl_controller(0.1, 10, 1, 10, 100) == pytest.approx(0.1 * 1.02)


def loop_gae(r, v, m, gamma, lam):
    nxt = total = 0.0
    out = []
    for t in reversed(range(len(r))):
        now = r[t] + gamma * nxt - v[t] + gamma * lam * total
        total = now * m[t] + (1 - m[t]) * total
        nxt = v[t] * m[t] + (1 - m[t]) * nxt
        out.append(total)
    return out[::-1]


@pytest.mark.parametrize("mask", [[1, 1, 1, 1], [1, 0, 1, 0], [0, 0, 0, 0]])
def test_folds_with_a_hole_in_the_mask(spark, mask):
    r, v = [1.0, 2.0, -1.0, 0.5], [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([(r, v, mask)], "r array<double>, v array<double>, m array<int>")
    got = df.select(sequences.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("a"), sequences.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("d")).first()
    assert np.allclose(got.a, loop_gae(r, v, mask, 0.9, 0.8))
    run, want = 0.0, []
    for x, m in zip(r[::-1], mask[::-1], strict=True):
        run = x + 0.9 * run
        want.append(run)
        run *= m
    assert np.allclose(got.d, want[::-1])


def test_masks_and_softmax(spark):
    df = spark.createDataFrame([([5, 7, 2, 7, 2],)], "ids array<int>")
    got = df.select(sequences.response_mask(F.col("ids"), 2).alias("m"), sequences.response_mask(F.col("ids"), 9).alias("n"), sequences.softmax_of(F.array(F.lit(0.0), F.lit(math.log(3)))).alias("p"), sequences.first_argmax(F.col("ids")).alias("k")).first()
    assert got.m == [1, 1, 1, 0, 0] and got.n == [1] * 5 and np.allclose(got.p, [0.25, 0.75]) and got.k == 1


def test_null_groups_keep_their_rows(spark):
    rows = [(None, "r1", 0, 1.0, 1, -0.1, 0.5), (None, "r2", 0, 0.0, 1, -0.2, 0.5), ("a", "r3", 0, 1.0, 1, -0.1, 0.5), ("a", "r4", 0, 0.0, 1, -0.2, 0.5)]
    df = spark.createDataFrame(rows, "g string, r string, t int, reward double, m int, logp double, p2 double")
    got = adv.optimal_token_baseline(df, "g", "r", "t", "reward", "m", "logp", "p2").collect()
    by = {x.r: x.advantage for x in got}
    assert len(got) == 4 and by["r1"] == by["r3"] and by["r2"] == by["r4"]
    ids = {(x.g, x.group_id) for x in adv.dense_group_ids(df.select("g", "r"), "g").collect()}
    assert len(ids) == 2 and {i for _, i in ids} == {0, 1}
