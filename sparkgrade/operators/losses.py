"""Policy and value objectives of token rows: forward values and diagnostics, no gradients.

Rows are tokens (long form) with old_logp, logp, advantage, mask and a sequence key. Each
objective gives a loss column; aggregate() sums it by one of the reference modes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import LOSSES
from .filters import seeded
from .shapes import with_position


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def _ratio(c: dict) -> Column:
    return F.exp(clamp(F.col(c["logp"]) - F.col(c["old"]), -20, 20))


COLUMNS = {"logp": "logp", "old": "old_logp", "adv": "advantage", "mask": "mask", "seq": "seq"}


@LOSSES.register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, **names) -> DataFrame:
    """Clipped ratio; for negative advantages bounded by dual times the advantage. Adds loss, clipped, clipped_low, kl."""
    c = COLUMNS | names
    r, a = _ratio(c), F.col(c["adv"])
    plain, cut = -a * r, -a * clamp(r, 1 - low, 1 + high)
    one = F.greatest(plain, cut)
    two = F.least(-a * dual, one)
    return df.withColumns({"loss": F.when(a < 0, two).otherwise(one), "clipped": (cut > plain).cast("double"), "clipped_low": ((one > -a * dual) & (a < 0)).cast("double"), "kl": F.col(c["old"]) - F.col(c["logp"])})


@LOSSES.register("gspo")
def gspo(df: DataFrame, low: float = 3e-4, high: float = 4e-4, **names) -> DataFrame:
    """The ratio is of the sequence: the mean log-ratio of its masked-in tokens."""
    c = COLUMNS | names
    w = Window.partitionBy(c["seq"])
    m = F.col(c["mask"]).cast("double")
    mean = F.sum((F.col(c["logp"]) - F.col(c["old"])) * m).over(w) / F.greatest(F.sum(m).over(w), F.lit(1.0))
    r, a = F.exp(F.least(mean, F.lit(10.0))), F.col(c["adv"])
    plain, cut = -a * r, -a * clamp(r, 1 - low, 1 + high)
    return df.select("*", F.greatest(plain, cut).alias("loss"), (cut > plain).cast("double").alias("clipped"))


@LOSSES.register("sapo")
def sapo(df: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, **names) -> DataFrame:
    """A sigmoid gate of the ratio, with a temperature for each sign of the advantage."""
    c = COLUMNS | names
    r, a = _ratio(c), F.col(c["adv"])
    tau = F.when(a > 0, tau_pos).otherwise(tau_neg)
    return df.withColumn("loss", -(1 / (1 + F.exp(-tau * (r - 1)))) * (4 / tau) * a)


@LOSSES.register("gpg")
def gpg_loss(df: DataFrame, **names) -> DataFrame:
    c = COLUMNS | names
    return df.withColumn("loss", -F.col(c["logp"]) * F.col(c["adv"]))


@LOSSES.register("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.2, high: float = 0.2, **names) -> DataFrame:
    """Token log-ratios are clipped by the advantage's sign, then meaned to a sequence ratio."""
    c = COLUMNS | names
    w = Window.partitionBy(c["seq"])
    d, a, m = F.col(c["logp"]) - F.col(c["old"]), F.col(c["adv"]), F.col(c["mask"]).cast("double")
    sign = F.signum(a)
    kept = sign * F.least(sign * d, sign * clamp(d, -low, high))
    n = F.sum(m).over(w)
    ratio = F.exp(F.sum(kept * m).over(w) / (n + 1e-8))
    return df.select("*", (-(F.sum(a * m).over(w) / (n + 1e-8)) * ratio).alias("loss"))


@LOSSES.register("cispo")
def cispo(df: DataFrame, low: float = 10.0, high: float = 0.2, **names) -> DataFrame:
    """The clipped ratio weighs the log-probability."""
    c = COLUMNS | names
    return df.withColumn("loss", -clamp(_ratio(c), 1 - low, 1 + high) * F.col(c["adv"]) * F.col(c["logp"]))


@LOSSES.register("reinforce")
def reinforce(df: DataFrame, weight: str | None = None, **names) -> DataFrame:
    c = COLUMNS | names
    w = F.col(weight) if weight else F.lit(1.0)
    return df.withColumn("loss", -w * F.col(c["logp"]) * F.col(c["adv"]))


@LOSSES.register("dro")
def dro(df: DataFrame, beta: float = 1e-3, **names) -> DataFrame:
    """The objective with a quadratic penalty on the log-ratio."""
    c = COLUMNS | names
    d = F.col(c["logp"]) - F.col(c["old"])
    return df.withColumn("loss", -F.col(c["logp"]) * F.col(c["adv"]) + beta / 2 * d * d)


def _within(df: DataFrame, c: dict, outside: Column, bound: float) -> DataFrame:
    """The truncated ratio weighs the log-probability; tokens that are outside get no loss."""
    loss = -F.col(c["adv"]) * F.least(_ratio(c), F.lit(float(bound))) * F.col(c["logp"])
    return df.withColumns({"loss": F.when(outside, 0.0).otherwise(loss), "clipped": outside.cast("double")})


@LOSSES.register("dppo_tv")
def dppo_tv(df: DataFrame, low: float = 0.2, high: float = 0.2, bound: float = 20.0, **names) -> DataFrame:
    """Tokens whose probability moved too far in the advantage's direction are outside."""
    c = COLUMNS | names
    moved = F.exp(c["logp"]) - F.exp(c["old"])
    return _within(df, c, F.when(F.col(c["adv"]) > 0, moved > high).otherwise(moved < -low), bound)


@LOSSES.register("dppo_kl")
def dppo_kl(df: DataFrame, low: float = 0.2, high: float = 0.2, bound: float = 20.0, **names) -> DataFrame:
    """As dppo_tv, by the divergence of two coins with the old and the new probability."""
    c = COLUMNS | names
    q, p = F.exp(c["old"]), F.exp(c["logp"])
    kl = q * (F.col(c["old"]) - F.col(c["logp"])) + (1 - q) * F.log((1 - q + 1e-8) / (1 - p + 1e-8))
    return _within(df, c, F.when(F.col(c["adv"]) > 0, (kl > high) & (p > q)).otherwise((kl > low) & (p < q)), bound)


def _covariance(df: DataFrame, c: dict) -> DataFrame:
    m = F.col(c["mask"]).cast("double")
    means = df.agg((F.sum(F.col(c["adv"]) * m) / (F.sum(m) + 1e-8)).alias("mean_a"), (F.sum(F.col(c["logp"]) * m) / (F.sum(m) + 1e-8)).alias("mean_l"))
    return df.crossJoin(F.broadcast(means)).withColumn("cov", (F.col(c["adv"]) - F.col("mean_a")) * (F.col(c["logp"]) - F.col("mean_l"))).drop("mean_a", "mean_l")


def _first(df: DataFrame, eligible: Column, order: list[Column], keys: list[str], n: int) -> DataFrame:
    """Adds _picked: whether an eligible row is among the first n in the order. Places come from ranges, so no task sorts all rows."""
    names = [f"_o{i}" for i in range(len(order))]
    some = df.where(eligible).select(*keys, *(o.alias(c) for c, o in zip(names, order, strict=True)))
    picked = with_position(some, [*names, *keys], "_place").where(F.col("_place") < n).select(*keys).withColumn("_picked", F.lit(True))
    return df.join(picked, keys, "left").withColumn("_picked", F.coalesce("_picked", F.lit(False)))


@LOSSES.register("clip_cov")
def clip_cov(df: DataFrame, ratio: float = 2e-4, low: float = 1.0, high: float = 5.0, clip: float = 0.2, order: list[str] = (), seed: int = 0, **names) -> DataFrame:
    """Of the unclipped tokens with a covariance in the band, max(1, int(ratio * masked-in tokens)) get no loss: those that a seeded hash of the key `order` puts first."""
    c = COLUMNS | names
    got = _covariance(vanilla(df, clip, clip, 1e9, **names), c)
    eligible = F.col("cov").between(low, high) & (F.col("clipped") == 0) & (F.col(c["mask"]) != 0)
    quota = max(1, int(ratio * (df.agg(F.sum(c["mask"])).first()[0] or 0)))
    picked = _first(got, eligible, [seeded(seed, *order)], list(order), quota)
    return picked.withColumn("loss", F.when(F.col("_picked"), 0.0).otherwise(F.col("loss"))).drop("_picked")


@LOSSES.register("kl_cov")
def kl_cov(df: DataFrame, ratio: float = 2e-4, weight: float = 1.0, order: list[str] = (), **names) -> DataFrame:
    """The max(1, int(ratio * n)) of n masked-in tokens that have the highest covariance (then first by the key `order`) get a penalty on the log-ratio's size."""
    c = COLUMNS | names
    got = _covariance(df, c)
    inside = F.col(c["mask"]) != 0
    n = df.where(inside).count()
    picked = _first(got, inside, [-F.col("cov")], list(order), max(1, int(n * ratio)))
    plain = -F.col(c["adv"]) * _ratio(c)
    d = F.abs(F.col(c["logp"]) - F.col(c["old"]))
    return picked.withColumn("loss", F.when(F.col("_picked"), plain + weight * d).otherwise(plain)).drop("_picked")


@LOSSES.register("group_centred")
def group_centred(df: DataFrame, group: str, beta: float = 0.1, **names) -> DataFrame:
    """Sequence rows: half the squared difference of the centred log-ratio (times beta) and the advantage, over n - 1."""
    c = COLUMNS | names
    w = Window.partitionBy(group)
    theta = beta * (F.col(c["logp"]) - F.col(c["old"]))
    n = F.count(F.lit(1)).over(w)
    gap = theta - F.avg(theta).over(w) - F.col(c["adv"])
    return df.select("*", (0.5 * gap * gap / F.greatest(n - 1, F.lit(1))).alias("loss"))


@LOSSES.register("squared_log_ratio")
def squared_log_ratio(df: DataFrame, eta: float, reward: str, **names) -> DataFrame:
    """Sequence rows: (log-ratio - eta * reward) squared."""
    c = COLUMNS | names
    gap = F.col(c["logp"]) - F.col(c["old"]) - eta * F.col(reward)
    return df.withColumn("loss", gap * gap)


def bypass(df: DataFrame, kind: str, weight: str | None = None, **names) -> DataFrame:
    """Looks an objective up by name, and weighs its loss by a correction column."""
    got = LOSSES.resolve(kind)(df, **names)
    return got.withColumn("loss", F.col("loss") * F.col(weight)) if weight else got


def value_loss(predicted: Column, values: Column, returns: Column, clip: float) -> Column:
    """Half the larger squared error of the prediction and of its clipped form."""
    cut = F.least(F.greatest(predicted, values - clip), values + clip)
    return 0.5 * F.greatest((predicted - returns) * (predicted - returns), (cut - returns) * (cut - returns))


def shaped_reward(score: Column, logp: Column, ref: Column, ratio: float) -> Column:
    return score - ratio * (logp - ref)


def aggregate(df: DataFrame, mode: str = "token-mean", loss: str = "loss", mask: str = "mask", seq: str = "seq", scale: float | None = None) -> DataFrame:
    """One row `loss`: token-mean, token-sum, seq-mean-token-sum (-norm: over scale), seq-mean-token-mean."""
    m = F.col(mask).cast("double")
    x = F.when(m != 0, F.col(loss) * m).otherwise(0.0)
    if mode == "token-mean":
        return df.agg(F.try_divide(F.sum(x), F.sum(m)).alias("loss"))
    if mode == "token-sum":
        return df.agg(F.sum(x).alias("loss"))
    rows = df.groupBy(seq).agg(F.sum(x).alias("s"), F.sum(m).alias("n")).where("n > 0")
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return rows.agg((F.sum("s") / F.lit(float(scale or 1))).alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(F.col("s") / F.col("n")).alias("loss"))
    raise ValueError(mode)


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, kind: str = "sigmoid", smoothing: float = 0.0, reference_free: bool = False) -> Column:
    """Of a pair's log-probabilities: the log-sigmoid of the margin (computed stably), or the squared distance to 1 / (2 beta)."""
    margin = (chosen - rejected) - (F.lit(0.0) if reference_free else ref_chosen - ref_rejected)
    log_sigmoid = lambda x: F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    if kind == "sigmoid":
        return -(1 - smoothing) * log_sigmoid(beta * margin) - smoothing * log_sigmoid(-beta * margin)
    if kind == "ipo":
        return (margin - 1 / (2 * beta)) * (margin - 1 / (2 * beta))
    raise ValueError(kind)


def cross_entropy_preference(total: Column, correct: Column, beta: float) -> Column:
    """Binary cross entropy of sigmoid(beta * sum of token scores) against the outcome."""
    x = beta * total
    return F.greatest(x, F.lit(0.0)) - x * correct + F.log1p(F.exp(-F.abs(x)))


def detached_preference(df: DataFrame, group: str, total: str, correct: str, beta: float, weight: str = "none") -> DataFrame:
    """Sequence rows: adds loss, -log sigmoid of the distance (by outcome's sign) between beta * total and the mean of the group's other side.

    The other side of a row with a positive outcome are rows of lower outcome, else those of
    higher; without any its mean is 0. weight: none; bon_rm or bon_acc, which weigh a row by
    n * (share of the group at or under it in total or outcome) ** (n - 1).
    """
    w = Window.partitionBy(group)
    by = w.orderBy(correct)
    below, at, above = by.rangeBetween(Window.unboundedPreceding, Window.currentRow), by.rangeBetween(Window.currentRow, Window.currentRow), by.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    t = F.col(total)
    side = lambda span: ((F.sum(t).over(span) - F.sum(t).over(at)), (F.count(t).over(span) - F.count(t).over(at)))
    (ls, ln), (hs, hn) = side(below), side(above)
    good = F.col(correct) > 0
    other = F.coalesce(F.when(good, F.try_divide(ls, ln)).otherwise(F.try_divide(hs, hn)), F.lit(0.0)) * beta
    x = (t * beta - other) * F.when(good, 1.0).otherwise(-1.0)
    loss = F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    if weight == "none":
        return df.select("*", loss.alias("loss"))
    if weight not in ("bon_rm", "bon_acc"):
        raise ValueError(weight)
    n = F.count(F.lit(1)).over(w)
    under = F.count(F.lit(1)).over(w.orderBy(total if weight == "bon_rm" else correct).rangeBetween(Window.unboundedPreceding, Window.currentRow)) / n
    return df.select("*", (loss * n * F.pow(under, n - 1)).alias("loss"))


def pairwise_accuracy(df: DataFrame, group: str, score: str, correct: str) -> DataFrame:
    """One row `accuracy` over groups: pairs of a group with unlike outcomes, ordered by score as by outcome,
    weighted by the difference of outcomes; 0.5 where a group has none.

    A group's pairs are counted from its distinct (score, correct) values, never from all pairs of rows.
    """
    cells = df.groupBy(group, correct, score).agg(F.count(F.lit(1)).alias("c"))
    if dict(df.dtypes)[correct] in ("int", "boolean", "bigint", "double"):
        by = Window.partitionBy(group).orderBy(score)
        ok = F.col(correct).cast("double")
        below = by.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = by.rangeBetween(Window.currentRow, Window.currentRow)
        zeros = F.when(ok == 0, F.col("c")).otherwise(0)
        cells = cells.select(group, "c", ok.alias("ok"), (F.sum(zeros).over(below) - F.sum(zeros).over(same)).alias("lower"))
        pairs = cells.groupBy(group).agg(F.sum(F.when(F.col("ok") == 1, F.col("c") * F.col("lower")).otherwise(0)).alias("right"), (F.sum(F.when(F.col("ok") == 1, F.col("c")).otherwise(0)) * F.sum(F.when(F.col("ok") == 0, F.col("c")).otherwise(0))).alias("all"))
        return pairs.agg(F.avg(F.when(F.col("all") > 0, F.col("right") / F.col("all")).otherwise(0.5)).alias("accuracy"))
    raise TypeError(f"{correct} must be 0 or 1")


def absolute_accuracy(df: DataFrame, score: str, correct: str) -> DataFrame:
    """One row `accuracy`: how often a score's sign agrees with the outcome."""
    return df.agg(F.avg(((F.col(score) > 0) == (F.col(correct) > 0)).cast("double")).alias("accuracy"))
