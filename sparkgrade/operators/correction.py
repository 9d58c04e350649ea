"""Off-policy correction of token rows (long form: seq, t, old_logp, rollout_logp, mask): weights, rejection, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .losses import clamp

#: Log-ratios are clamped to this before exp.
BOUND = 20.0


def log_ratio(old: str, rollout: str) -> Column:
    return F.col(old) - F.col(rollout)


def _m(mask: str) -> Column:
    return F.col(mask).cast("double")


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, mode: str = "truncate", normalise: bool = False, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask", seq: str = "seq") -> DataFrame:
    """Adds weight and raw_weight. level: token, or sequence (product of a sequence's ratios). truncate: at the
    threshold; zero: nothing beyond it. normalise: divided by the batch's mean."""
    d, m, w = log_ratio(old, rollout), _m(mask), Window.partitionBy(seq)
    lr = d if level == "token" else F.sum(d * m).over(w)
    raw = F.exp(clamp(lr, -BOUND, BOUND)) * m
    got = df.select("*", raw.alias("raw_weight"))
    r = F.col("raw_weight")
    out = F.least(r, F.lit(float(threshold))) if mode == "truncate" else F.when(r > threshold, 0.0).otherwise(r)
    got = got.withColumn("weight", out)
    if normalise:
        mean = got.agg((F.sum(F.col("weight") * m) / (F.sum(m) + 1e-8)).alias("mean_weight"))
        got = got.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.greatest("mean_weight", F.lit(1e-8))).drop("mean_weight")
    return got


#: Divergences of a log-ratio d.
DIVERGENCES = {"k1": lambda d: d, "k2": lambda d: 0.5 * d * d, "k3": lambda d: F.exp(clamp(d, -BOUND, BOUND)) - 1 - d}


def rejection_mask(df: DataFrame, options: dict[str, float | tuple[float, float]], old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask", seq: str = "seq") -> DataFrame:
    """Adds kept: the mask, but 0 for what an option rejects; all must pass.

    Options: {token|seq_sum|seq_mean|seq_max}_{k1|k2|k3} with an upper bound or (lower, upper)
    bounds. k1 bounds are those of the ratio, compared in its logarithm.
    """
    w, m = Window.partitionBy(seq), _m(mask)
    d = log_ratio(old, rollout)
    passed = F.lit(True)
    for name, bound in options.items():
        level, _, kind = name.rpartition("_")
        value = DIVERGENCES[kind](d)
        n = F.greatest(F.sum(m).over(w), F.lit(1.0))
        at = {"token": value, "seq_sum": F.sum(value * m).over(w), "seq_mean": F.sum(value * m).over(w) / n, "seq_max": F.max(F.when(m != 0, value)).over(w)}[level]
        low, high = bound if isinstance(bound, tuple) else (None, bound)
        if kind == "k1":
            high = F.log(F.lit(float(high)))
            low = F.log(F.lit(float(low))) if low is not None else -high  # 1 / high is rounded
        passed = passed & (at <= high)
        if low is not None:
            passed = passed & (at >= low)
    return df.select("*", F.when(passed, F.col(mask)).otherwise(0).alias("kept"))


def importance_metrics(df: DataFrame, raw: str = "raw_weight", mask: str = "mask", threshold: float = 2.0) -> DataFrame:
    """One row: mean, std, min, max, effective sample share and shares beyond the bounds, of the masked-in weights."""
    own = df.where(F.col(mask) != 0)
    r = F.col(raw)
    return own.agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"), (F.sum(r) * F.sum(r) / (F.count(r) * F.sum(r * r))).alias("ess"), F.avg((r > threshold).cast("double")).alias("share_high"), F.avg((r < 1 / threshold).cast("double")).alias("share_low"))


def rejection_metrics(df: DataFrame, kept: str = "kept", mask: str = "mask", seq: str = "seq") -> DataFrame:
    """One row: the share of masked-in tokens that are rejected, and of sequences with any, and with all of them."""
    own = df.where(F.col(mask) != 0).groupBy(seq).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kept) == 0).alias("gone"))
    return own.agg((F.sum("gone") / F.sum("n")).alias("token_share"), F.avg((F.col("gone") > 0).cast("double")).alias("seq_any_share"), F.avg((F.col("gone") == F.col("n")).cast("double")).alias("seq_all_share"))


def off_policy_metrics(df: DataFrame, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask", seq: str = "seq") -> DataFrame:
    """One row: kl, k3_kl, both perplexities, their ratio, chi squared of tokens and of sequences."""
    own = df.where(F.col(mask) != 0)
    d = log_ratio(old, rollout)
    e = F.exp(clamp(d, -BOUND, BOUND))
    rows = own.groupBy(seq).agg(F.avg(old).alias("o"), F.avg(rollout).alias("r"), F.sum(d).alias("s"))
    of_rows = rows.agg(F.avg(F.exp(-F.col("o"))).alias("training_ppl"), F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(F.exp(F.col("r") - F.col("o"))).alias("ppl_ratio"), (F.avg(F.exp(2 * clamp(F.col("s"), -BOUND, BOUND))) - 1).alias("chi2_seq"))
    tokens = own.agg(F.avg(-d).alias("kl"), F.avg(e - d - 1).alias("k3_kl"), (F.avg(e * e) - 1).alias("chi2_token"))
    return tokens.crossJoin(of_rows)


def correct(df: DataFrame, weights: dict | None = None, rejection: dict | None = None, **names) -> DataFrame:
    """Weights and rejection in one pass over the same windows."""
    got = importance_weights(df, **(weights or {}), **names)
    return rejection_mask(got, rejection, **names) if rejection else got.withColumn("kept", F.col(names.get("mask", "mask")))
