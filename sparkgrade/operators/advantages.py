"""Group-relative advantages as windows: one row is one response with a score, one group one prompt.

Each function adds the column `advantage`. Nothing is collected: a group is a window
partition, and moments of the whole batch are one-row frames joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import ADVANTAGES
from .shapes import with_position

EPSILON = 1e-6
WHITEN_EPSILON = 1e-8


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _group(group) -> Window:
    return Window.partitionBy(*([group] if isinstance(group, str) else group))


def group_mean_std(df: DataFrame, group, score: str, floor: float = 0.0) -> DataFrame:
    """Adds n, mean and std (sample) of each group; a group of one has mean 0 and std 1. floor bounds std below."""
    w, s = _group(group), F.col(score)
    n = F.count(s).over(w)
    return df.select("*", n.alias("n"), F.when(n > 1, F.avg(s).over(w)).otherwise(0.0).alias("mean"), F.when(n > 1, F.greatest(F.stddev_samp(s).over(w), F.lit(floor))).otherwise(1.0).alias("std"))


def dense_group_ids(df: DataFrame, group: str) -> DataFrame:
    """Adds group_id, the place of the label among the distinct labels from 0. The labels are numbered by ranges, not the rows."""
    numbered = with_position(df.select(group).distinct(), [group], "group_id").withColumnRenamed(group, "_group")
    return df.join(numbered, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")  # null is a label of its own


def whiten(df: DataFrame, value: str, shift_mean: bool = True, weight: Column | None = None) -> DataFrame:
    """Replaces value by (x - mean) / sqrt(var + 1e-8) over all rows (weight: 0/1 mask), or without the mean's shift."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    x = F.col(value)
    sums = df.agg(F.sum(w).alias("wn"), F.sum(w * x).alias("ws"), F.sum(w * x * x).alias("wq"))
    moments = sums.select((F.col("ws") / F.col("wn")).alias("wm"), F.try_divide(F.col("wq") - F.col("ws") * F.col("ws") / F.col("wn"), F.col("wn") - 1).alias("wv"))
    out = (x - F.col("wm")) / F.sqrt(F.greatest(F.col("wv"), F.lit(0.0)) + WHITEN_EPSILON)
    if not shift_mean:
        out = out + F.col("wm")
    return df.crossJoin(F.broadcast(moments)).withColumn(value, out).drop("wm", "wv")


@ADVANTAGES.register("grpo")
def grpo(df: DataFrame, group, score: str, by_std: bool = True) -> DataFrame:
    """(score - mean) / (std + 1e-6); without by_std only the difference."""
    got = group_mean_std(df, group, score)
    out = F.col(score) - F.col("mean")
    return got.withColumn("advantage", out / (F.col("std") + EPSILON) if by_std else out).drop("n", "mean", "std")


@ADVANTAGES.register("rloo")
def rloo(df: DataFrame, group, score: str) -> DataFrame:
    """Score minus the mean of the others; a group of one keeps its score."""
    w, s = _group(group), F.col(score)
    n = F.count(s).over(w)
    return df.withColumn("advantage", F.when(n > 1, s - (F.sum(s).over(w) - s) / (n - 1)).otherwise(s))


@ADVANTAGES.register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, group, score: str) -> DataFrame:
    """As rloo, but a group of one gets 0."""
    w, s = _group(group), F.col(score)
    n = F.count(s).over(w)
    return df.withColumn("advantage", F.when(n > 1, s - (F.sum(s).over(w) - s) / (n - 1)).otherwise(0.0))


@ADVANTAGES.register("opo")
def opo(df: DataFrame, group, score: str, length: str) -> DataFrame:
    """Score minus the length-weighted mean of the group; a group of one has baseline 0."""
    w = _group(group)
    n = F.count(score).over(w)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(n > 1, base).otherwise(0.0))


@ADVANTAGES.register("gpg")
def gpg(df: DataFrame, group, score: str, f_norm: float = 1.0) -> DataFrame:
    """(rows / rows with a score that isn't 0) * (score - mean) / f_norm; a group of one has mean 0."""
    scale = df.agg((F.count(F.lit(1)) / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("gpg_scale"))
    got = group_mean_std(df, group, score).crossJoin(F.broadcast(scale))
    return got.withColumn("advantage", F.col("gpg_scale") * (F.col(score) - F.col("mean")) / f_norm).drop("n", "mean", "std", "gpg_scale")


@ADVANTAGES.register("passk")
def passk(df: DataFrame, group, score: str, order: list[str], by_std: bool = True) -> DataFrame:
    """Only a group's best row has an advantage: best minus second best (over std + 1e-6). order breaks ties.

    A group of one is an error, as a second best is needed.
    """
    w = _group(group)
    ranked = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(F.col(score).desc(), *order)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.col(score) - F.nth_value(score, 2).over(whole)
    gap = gap / (F.stddev_samp(score).over(w) + EPSILON) if by_std else gap
    n = F.count(F.lit(1)).over(w)
    return df.select("*", F.when(n < 2, F.raise_error(F.lit("a group needs two rows")).cast("double")).when(F.row_number().over(ranked) == 1, gap).otherwise(0.0).alias("advantage"))


@ADVANTAGES.register("reinforce_pp_baseline")
def reinforce_pp_baseline(df: DataFrame, group, score: str) -> DataFrame:
    """Score minus the group's mean (0 for a group of one), then whitened over all rows."""
    got = group_mean_std(df, group, score).withColumn("advantage", F.col(score) - F.col("mean")).drop("n", "mean", "std")
    return whiten(got, "advantage")


@ADVANTAGES.register("gdpo")
def gdpo(df: DataFrame, group, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """GRPO of each score by itself, their weighted sum, whitened over all rows."""
    w = _group(group)
    total = F.lit(0.0)
    for name, weight in zip(scores, weights or [1.0] * len(scores), strict=True):
        s, n = F.col(name), F.count(name).over(w)
        part = F.when(n > 1, (s - F.avg(s).over(w)) / (F.stddev_samp(s).over(w) + EPSILON)).otherwise(s / (1 + EPSILON))
        total = total + F.lit(weight) * part
    return whiten(df.select("*", total.alias("advantage")), "advantage")


@ADVANTAGES.register("positional")
def positional(df: DataFrame, position: str, size: int, score: str) -> DataFrame:
    """Groups are `size` rows in a row by position; (score - mean) / max(std of the population, 1e-8)."""
    got = df.withColumn("slot", F.floor(F.col(position) / size))
    w = Window.partitionBy("slot")
    return got.withColumn("advantage", (F.col(score) - F.avg(score).over(w)) / F.greatest(F.stddev_pop(score).over(w), F.lit(1e-8))).drop("slot")


@ADVANTAGES.register("soft_mean")
def soft_mean(df: DataFrame, score: str, beta: float = 1.0) -> DataFrame:
    """Score minus log(mean(exp(beta * score))) / beta over all rows, computed from the maximum."""
    top = df.agg(F.max(score).alias("top"))
    base = df.crossJoin(F.broadcast(top)).agg((F.max("top") + F.log(F.avg(F.exp(beta * (F.col(score) - F.col("top"))))) / beta).alias("soft"))
    return df.crossJoin(F.broadcast(base)).withColumn("advantage", F.col(score) - F.col("soft")).drop("soft")


@ADVANTAGES.register("remax")
def remax(df: DataFrame, row, t: str, reward: str, baseline: str) -> DataFrame:
    """Long form: the sum of rewards from a token on, minus the row's baseline."""
    w = Window.partitionBy(*([row] if isinstance(row, str) else row)).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("advantage", F.sum(reward).over(w) - F.col(baseline))


@ADVANTAGES.register("process_rloo")
def process_rloo(df: DataFrame, group, row: str, t: str, reward: str) -> DataFrame:
    """Long form: the return of token rewards, each less the mean reward of the group's other responses."""
    of_row = df.groupBy(*([group] if isinstance(group, str) else group), row).agg(F.avg(reward).alias("own_mean"))
    w = _group(group)
    n = F.count(F.lit(1)).over(w)
    base = of_row.select("*", F.when(n > 1, (F.sum("own_mean").over(w) - F.col("own_mean")) / (n - 1)).otherwise(0.0).alias("base"))
    keys = [*([group] if isinstance(group, str) else group), row]
    back = Window.partitionBy(*keys).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(base.drop("own_mean"), keys).withColumn("advantage", F.sum(F.col(reward) - F.col("base")).over(back)).drop("base")


@ADVANTAGES.register("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame, group, row: str, t: str, reward: str, mask: str, logp: str, sum_pi2: str, compact: bool = False) -> DataFrame:
    """Long form: return from t on minus the group's baseline at t, the returns weighted by accumulated
    path variance (1 - 2 p + sum of squared probabilities). compact: t counts masked-in tokens only."""
    keys = [*([group] if isinstance(group, str) else group)]
    m = F.col(mask).cast("double")
    order = Window.partitionBy(*keys, row).orderBy(t)
    got = df
    slot = t
    if compact:
        got, slot = got.withColumn("slot", F.when(m > 0, F.sum(m).over(order.rowsBetween(Window.unboundedPreceding, 0)))), "slot"
    back = Window.partitionBy(*keys, row).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("ret", F.sum(F.col(reward) * m).over(back))
    got = got.withColumn("path", F.sum((1 - 2 * F.exp(logp) + F.col(sum_pi2)) * m).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = Window.partitionBy(*keys, slot)
    # The number of a group's responses is counted once and joined, not gathered on each row.
    counted = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count_distinct(row).alias("_responses"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]  # a null group is a group
    got = got.join(counted, same).drop(*(f"_k{i}" for i in range(len(keys))))
    rows = F.col("_responses")
    base = F.sum(F.col("ret") * F.col("path") * m).over(at) / (F.sum(F.col("path") * m).over(at) + 1e-8)
    # The part of the longest response beyond the second longest has no peers: one row there, baseline 0.
    alone = F.sum(m).over(at) <= 1
    return got.select("*", ((F.col("ret") - F.when((rows > 1) & ~alone, base).otherwise(0.0)) * m).alias("advantage")).drop("ret", "path", "slot", "_responses")


def final_of_session(df: DataFrame, session, index: str, order: list[str] = ()) -> DataFrame:
    """The row with the largest index of each session."""
    keys = [session] if isinstance(session, str) else session
    w = Window.partitionBy(*keys).orderBy(F.col(index).desc(), *order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def session_broadcast(df: DataFrame, group, session: str, index: str, score: str, estimator: str = "grpo") -> DataFrame:
    """Scores the last row of every session within its group; all rows of the session get its advantage."""
    keys = [group] if isinstance(group, str) else group
    last = ADVANTAGES.resolve(estimator)(final_of_session(df, [*keys, session], index), keys, score)
    return df.join(last.select(*keys, session, "advantage"), [*keys, session])


def kl_controller(value: float, current_kl: float, target: float, n_steps: int, horizon: int) -> float:
    """The next KL weight: proportional to the relative error, clipped to 0.2."""
    return value * (1 + max(-0.2, min(0.2, current_kl / target - 1)) * n_steps / horizon)


def kl_in_reward(score: str | Column, kl: str | Column, beta: float) -> Column:
    return _c(score) - beta * _c(kl)


def kl_estimate(logp: str | Column, ref: str | Column, kind: str = "k1") -> Column:
    """k1: difference; abs; mse (k2): half its square; low_var_kl (k3): exp(-d) + d - 1, both clamped."""
    d = _c(logp) - _c(ref)
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        e = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(e) - e - 1, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(kind)


def compute_advantage(df: DataFrame, estimator: str, **columns) -> DataFrame:
    """Looks the estimator up by name."""
    return ADVANTAGES.resolve(estimator)(df, **columns)


def beta_baseline(df: DataFrame, group, score: str, rho: str | float, alpha: str, beta: str) -> DataFrame:
    """Score minus a prompt's smoothed success rate: alpha and beta are the prompt's counts so far, decayed by rho; adds the counts to keep.

    The rate is alpha / (alpha + beta) before this batch; a prompt's scores (0 to 1) then add to the decayed counts.
    """
    w = _group(group)
    r = F.col(rho) if isinstance(rho, str) else F.lit(float(rho))
    a, b = F.col(alpha), F.col(beta)
    return df.select("*", (F.col(score) - a / (a + b)).alias("advantage"), (r * a + F.sum(score).over(w)).alias("next_alpha"), (r * b + F.sum(1 - F.col(score)).over(w)).alias("next_beta"))


def decay_by_divergence(divergence: Column, half: float, least: float, most: float) -> Column:
    """rho: halves for every `half` of divergence between the policy then and now, within bounds."""
    return F.least(F.greatest(F.pow(F.lit(2.0), -divergence / half), F.lit(float(least))), F.lit(float(most)))
