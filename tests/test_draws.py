"""Weighted draws against a search in the running sums."""

import bisect
import itertools

import pytest
from pyspark.sql import functions as F

from sparkgrade.operators import filters


@pytest.mark.parametrize("weights", [[1.0] * 300, [0.0, 3.0, 0.0, 1.0, None, 2.0], [1e-3] * 200 + [1e6] + [1e-3] * 200, [5.0]])
def test_draws_find_the_row_whose_interval_holds_them(spark, weights):
    rows = [(i, {"w": i}, w) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "id int, m map<string, int>, w double").repartition(3)
    got = {r.draw: (r.id, r.m["w"]) for r in filters.draw_with_replacement(df, F.col("w"), 700, 11, ["id"]).collect()}
    sums = list(itertools.accumulate(w or 0.0 for w in weights))
    places = spark.range(700).select("id", filters.seeded(11, "id").alias("u")).collect()
    want = {r.id: bisect.bisect_right(sums, r.u * sums[-1]) for r in places}
    assert got == {d: (i, i) for d, i in want.items()}
