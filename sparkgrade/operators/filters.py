"""Filters, samplers and selections over groups and versions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import ranged, with_position


def varied_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows of groups of one row, or with at least two values. A null value of a group is an error."""
    w = Window.partitionBy(group)
    keep = (F.count(F.lit(1)).over(w) == 1) | (F.min(value).over(w) != F.max(value).over(w))
    missing = F.count(value).over(w) < F.count(F.lit(1)).over(w)
    marked = df.select("*", F.when(missing, F.raise_error(F.lit("a finished group lacks its metric")).cast("boolean")).otherwise(keep).alias("_keep"))
    return marked.where("_keep").drop("_keep")


def constant_group_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """value, groups: how many groups of two rows or more have one value alone."""
    own = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    return own.where("n > 1 AND lo = hi").groupBy(F.col("lo").alias(value)).agg(F.count(F.lit(1)).alias("groups"))


def refill(dropped: int) -> int:
    """Prompts to ask for in place of dropped ones."""
    return 2 * dropped


def passing_first(df: DataFrame, group: str, passes: Column, order: str, keep_one_in: int) -> DataFrame:
    """One in k of the groups: those that pass first, then by order. Their places come from ranges, not from one sorted list."""
    own = df.groupBy(group).agg(F.max(passes.cast("int")).alias("ok"), F.min(order).alias("at"))
    n = own.count() // keep_one_in
    placed = with_position(own.withColumn("fails", 1 - F.col("ok")), ["fails", "at"], "_place")
    return df.join(placed.where(F.col("_place") < n).select(group), group, "left_semi")


def oldest(df: DataFrame, version: str, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(version, *order).limit(n)


def seeded(seed: int, *keys) -> Column:
    """A number from 0 to 1 that the seed and the keys (as text) decide: the first 52 bits of an MD5 digest."""
    told = F.concat_ws("_", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def hash_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows that a seeded hash of the key chooses; the same ones however the rows are dealt."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def draw_with_replacement(df: DataFrame, weight: Column, draws: int, seed: int, order: list[str]) -> DataFrame:
    """`draws` rows, each with probability as its weight: uniform draws meet the running sums of weights.

    Running sums come from those of ranges; a row's interval begins where the one before it
    ends, so no draw falls between. Where the intervals begin and the draws are merged in one
    order, cut in ranges of about one size: a draw takes the last row that begins at or before
    it, in its own range or the last one that has any. However heavy a row is, it is there once.
    """
    parts = ranged(df.withColumn("_w", F.coalesce(weight.cast("double"), F.lit(0.0))), order)
    w = Window.partitionBy("_range").orderBy("_key")
    inside = parts.withColumn("_hi", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("_low", F.coalesce(F.lag("_hi").over(w), F.lit(0.0)))
    sums = inside.groupBy("_range").agg(F.max("_hi").alias("_sum"))
    before = Window.orderBy("_range")
    starts = sums.select("_range", F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"))
    starts = starts.select("_range", F.coalesce(F.lag("_end").over(before), F.lit(0.0)).alias("_start"), "_end", F.max("_end").over(Window.partitionBy()).alias("_total"))
    top = F.max("_hi").over(Window.partitionBy("_range"))
    # The last row of a range ends where the next range begins, to the bit.
    up = F.when(F.col("_hi") == top, F.col("_end")).otherwise(F.col("_start") + F.col("_hi")) / F.col("_total")
    low = F.when(F.col("_low") == top, F.col("_end")).otherwise(F.col("_start") + F.col("_low")) / F.col("_total")
    ranged_rows = inside.join(F.broadcast(starts), "_range").select("*", low.alias("_lo"), up.alias("_up"))
    begins = ranged_rows.where("_up > _lo").select(*df.columns, F.lit(0).alias("_drawn"), F.col("_lo").alias("_at"), F.lit(None).cast("long").alias("draw"))
    asked = df.sparkSession.range(draws).select(F.lit(1).alias("_drawn"), F.col("id").alias("draw")).withColumn("_at", seeded(seed, "draw"))
    merged = ranged(begins.unionByName(asked, allowMissingColumns=True), ["_at", "_drawn"], "_cut")
    row = F.when(F.col("_drawn") == 0, F.struct(*df.columns))
    held = merged.withColumn("_row", F.last(row, ignorenulls=True).over(Window.partitionBy("_cut").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)))
    # A row for each range: their number is fixed.
    lasts = merged.groupBy("_cut").agg(F.max_by(row, F.when(F.col("_drawn") == 0, F.col("_key"))).alias("_tail"))
    carried = lasts.select("_cut", F.last("_tail", ignorenulls=True).over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = held.where("_drawn = 1").join(F.broadcast(carried), "_cut").select("draw", F.coalesce("_row", "_before").alias("_row"))
    return found.where("_row IS NOT NULL").select("_row.*", "draw")


def score_weights(score: Column, kind: str, power: float = 2.0, extremes: tuple[Column, Column] | None = None, coin: Column | None = None) -> Column:
    """pow: |score|^power; max_min: 1 for the highest and lowest scores, 0 else; max_random: 1 for the highest, 0.4 for others."""
    if kind == "pow":
        return F.pow(F.abs(score), power)
    low, high = extremes
    if kind == "max_min":
        return ((score == high) | (score == low)).cast("double")
    if kind == "max_random":
        return F.when(score == high, 1.0).otherwise(0.4)
    raise ValueError(kind)


def by_version(df: DataFrame, version: str, n: int, newest: bool, order: list[str], group: str | None = None) -> DataFrame:
    """n rows of the newest or oldest versions; a group counts by its extreme version."""
    v = F.col(version)
    if group:
        v = (F.max if newest else F.min)(version).over(Window.partitionBy(group))
    ranked = df.select("*", v.alias("_v"))
    return ranked.orderBy(F.col("_v").desc() if newest else F.col("_v"), *order).limit(n).drop("_v")


def same_version(df: DataFrame, version: str, n: int, which: str | int = "max") -> DataFrame:
    """All rows of one version (highest, lowest or a number) if there are n of them, else none."""
    own = df.groupBy(version).agg(F.count(F.lit(1)).alias("_n"))
    one = own.where(F.col(version) == which) if isinstance(which, int) else own.orderBy(F.col(version).desc() if which == "max" else F.col(version)).limit(1)
    return df.join(F.broadcast(one.where(F.col("_n") >= n).select(version)), version, "left_semi")


def selected_indices(total: int, count: int, how: str, seed: int = 0, start: int = 0) -> list[int]:
    """Row numbers: a sorted sample in Python's random stream, or the first ones from start."""
    if how == "random":
        return sorted(random.Random(seed).sample(range(total), min(count, total)))
    return list(range(start, min(total, start + count)))


def ready(columns: list[DataFrame], consumed: DataFrame, fresh: DataFrame, key: str, n: int) -> DataFrame:
    """n keys that every column has, that aren't consumed and are fresh; none if there are fewer."""
    got = columns[0].select(key)
    for c in columns[1:]:
        got = got.join(c.select(key), key, "left_semi")
    got = got.distinct().join(consumed.select(key), key, "left_anti").join(fresh.select(key), key, "left_semi").orderBy(key).limit(n)
    return got.crossJoin(F.broadcast(got.agg(F.count(F.lit(1)).alias("_n")))).where(F.col("_n") == n).drop("_n")


def ready_groups(rows: DataFrame, group: str, size: int, n: int) -> DataFrame:
    """Rows of the first n groups that are whole (size rows); none if there are fewer."""
    whole = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == size).orderBy(group).limit(n)
    enough = whole.crossJoin(F.broadcast(whole.agg(F.count(F.lit(1)).alias("_n")))).where(F.col("_n") == n)
    return rows.join(enough.select(group), group, "left_semi")


def stale(df: DataFrame, born: str, now: Column, threshold: int) -> Column:
    """Whether a group's age in versions is over the threshold."""
    return now - F.col(born) + 1 > threshold


def top_conflicts(df: DataFrame, conflict: str, confidence: str, n: int, order: list[str]) -> DataFrame:
    """The n conflicts of the highest confidence."""
    return df.where(F.col(conflict)).orderBy(F.col(confidence).desc(), *order).limit(n)


def kept_with_counts(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows that keep is true of, a row with before, after and dropped)."""
    counts = df.agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after")).withColumn("dropped", F.col("before") - F.col("after"))
    return df.where(keep), counts
