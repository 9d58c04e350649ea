"""Aggregations: validation metrics, data and timing metrics, histograms, percentiles, reductions by name."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .shapes import with_position


def ladder(n: Column) -> Column:
    """2, 4, 8, ... below n, and n at the end."""
    return F.array_distinct(F.concat(F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda x: x < n), F.array(n.cast("int"))))


def expected_extremes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, k, best, worst: the exact mean of the best and worst of k draws with replacement, for k of the ladder.

    From order statistics: the i-th smallest of n is the maximum with probability (i/n)^k - ((i-1)/n)^k.
    """
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), F.row_number().over(w.orderBy(value)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    rungs = ranked.where("n > 1").withColumn("k", F.explode(ladder(F.col("n"))))
    up = F.pow(F.col("i") / F.col("n"), F.col("k")) - F.pow((F.col("i") - 1) / F.col("n"), F.col("k"))
    down = F.pow((F.col("n") - F.col("i") + 1) / F.col("n"), F.col("k")) - F.pow((F.col("n") - F.col("i")) / F.col("n"), F.col("k"))
    return rungs.groupBy(*keys, "n", "k").agg(F.sum(F.col("x") * up).alias("best"), F.sum(F.col("x") * down).alias("worst"))


@functools.lru_cache(maxsize=1 << 14)
def majority_chances(counts: tuple[int, ...], k: int) -> tuple[float, ...]:
    """The chance of each vote, of these counts, to be the majority of k draws with replacement.

    The majority of a draw is its most common vote, the first drawn of equal ones. Given how often
    each vote is drawn, every order is as likely, so equal votes share the draw evenly. Summed over
    the highest count: a convolution over the votes by (draws so far, votes that reach the highest
    count), with Poisson weights, whose total is k with a known probability.
    """
    share = np.array(counts, float) / sum(counts)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, k + 1)))))
    weights = np.exp(np.arange(k + 1) * np.log(k * share)[:, None] - k * share[:, None] - logs)
    behind = np.subtract.outer(np.arange(k + 1), np.arange(k + 1))
    shifted = [np.where(behind >= 0, w[np.maximum(behind, 0)], 0.0) for w in weights]
    total = np.zeros(len(share))
    for high in range(-(-k // len(share)), k + 1):
        # For each number of draws and of votes at the highest count: the weight, and that of the draws of which each vote is one.
        held = np.zeros((k + 1, min(len(share), k // high) + 1, len(share) + 1))
        held[0, 0, 0] = 1
        for v, (w, below) in enumerate(zip(weights, shifted, strict=True)):
            new = (np.triu(below, 1 - high) @ held.reshape(k + 1, -1)).reshape(held.shape)
            up = held[: k + 1 - high, :-1] * w[high]
            new[high:, 1:] += up
            new[high:, 1:, v + 1] += up[..., 0]
            held = new
        total += (held[k, 1:, 1:] / np.arange(1, held.shape[1])[:, None]).sum(0)
    return tuple((total / np.exp(k * np.log(k) - k - logs[k])).tolist())


def majority_moments(counts: list[int], means: list[float], variances: list[float], ks: list[int]) -> list[tuple[float, float]]:
    """(mean, deviation) of the majority's value over k draws, for each k, from votes with these counts, and means and variances of their values.

    Its value is that of its first drawn row, which is any of its vote. The chances depend on the
    counts alone, in any order: groups of equal counts share them.
    """
    order = sorted(range(len(counts)), key=counts.__getitem__)
    key = tuple(counts[i] for i in order)
    n = sum(key)
    centre = sum(c * m for c, m in zip(counts, means, strict=True)) / n
    first = [means[i] - centre for i in order]
    second = [variances[i] + x * x for i, x in zip(order, first, strict=True)]
    out = []
    for k in ks:
        chances = majority_chances(key, k)
        mean = sum(map(operator.mul, chances, first))
        out.append((centre + mean, math.sqrt(max(sum(map(operator.mul, chances, second)) - mean * mean, 0.0))))
    return out


def resampling_ladder(df: DataFrame, keys: list[str], value: str, vote: str | None = None) -> DataFrame:
    """keys, n, k, what (best, worst and, with a vote, maj), mean, std: the exact moments of what bootstrap() and resampled_tree() estimate by draws.

    k runs over the ladder of groups of two rows or more. Null values don't count; null votes are
    a vote. Best and worst come from order statistics on the JVM. For the majority a group is
    reduced to its votes' counts, means and variances first; the work grows with the cube of k,
    so groups are meant to be a prompt's responses.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, "_v", F.row_number().over(w.orderBy("_v")).alias("_i"), F.count(F.lit(1)).over(w).alias("n"), F.avg("_v").over(w).alias("_c"))
    rungs = ranked.where("n > 1").withColumn("k", F.explode(ladder(F.col("n")))).withColumn("_x", F.col("_v") - F.col("_c"))
    power = lambda part: F.pow(part / F.col("n"), F.col("k"))
    chance = {"best": power(F.col("_i")) - power(F.col("_i") - 1), "worst": power(F.col("n") - F.col("_i") + 1) - power(F.col("n") - F.col("_i"))}
    sums = rungs.groupBy(*keys, "n", "k").agg(F.first("_c").alias("_c"), *(f.alias(f"_{what}{d}") for what, p in chance.items() for d, f in ((1, F.sum(F.col("_x") * p)), (2, F.sum(F.col("_x") ** 2 * p)))))
    told = lambda what: F.struct(F.lit(what).alias("what"), (F.col("_c") + F.col(f"_{what}1")).alias("mean"), F.sqrt(F.greatest(F.col(f"_{what}2") - F.col(f"_{what}1") ** 2, F.lit(0.0))).alias("std"))
    out = sums.select(*keys, "n", "k", F.explode(F.array(*map(told, chance))).alias("_m")).select(*keys, "n", "k", "_m.*")
    if vote is None:
        return out

    votes = rows.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_a"), F.var_pop("_v").alias("_s"))
    own = votes.groupBy(*keys).agg(F.sum("_n").alias("n"), F.collect_list(F.struct("_n", "_a", "_s")).alias("_g")).where("n > 1").withColumn("_k", ladder(F.col("n")))
    names = out.columns
    flat = own.select(*keys, "n", "_g._n", "_g._a", "_g._s", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch["_k"].to_pylist()
            got = [m for c, a, s, k in zip(batch["_n"].to_pylist(), batch["_a"].to_pylist(), batch["_s"].to_pylist(), ks, strict=True) for m in majority_moments(c, a, s, k)]
            at = pa.array(np.repeat(np.arange(len(ks)), [len(k) for k in ks]))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in (*keys, "n")), batch["_k"].flatten(), pa.array(["maj"] * len(got), pa.string()), *(pa.array([m[i] for m in got], pa.float64()) for i in (0, 1))], names=names)

    return out.unionByName(flat.mapInArrow(run, out.schema))


def majority(df: DataFrame, keys: list[str], vote: str, value: str, position: str) -> DataFrame:
    """keys, majority: the value of the first row with the most common vote; of equal ones, the first seen."""
    votes = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct(F.col(value).alias("v")), position).alias("first"), F.min(position).alias("at"))
    return votes.groupBy(*keys).agg(F.max_by(F.col("first.v"), F.struct(F.col("c"), (-F.col("at")).alias("early"))).alias("majority"))


def validation_metrics(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """source, metric, value: mean, std (population) and best/worst of k by prompt, then meaned over prompts, each weighing 1."""
    keys = [source, uid]
    base = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    flat = base.select(source, F.explode(F.array(F.struct(F.concat(F.lit("mean@"), "n").alias("metric"), F.col("mean").alias("value")), F.struct(F.concat(F.lit("std@"), "n").alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("value")))).alias("m"))
    rungs = expected_extremes(df, keys, value)
    more = rungs.select(source, F.explode(F.array(F.struct(F.concat(F.lit("best@"), "k").alias("metric"), F.col("best").alias("value")), F.struct(F.concat(F.lit("worst@"), "k").alias("metric"), F.col("worst").alias("value")))).alias("m"))
    return flat.unionByName(more).select(source, "m.*").where("value IS NOT NULL").groupBy(source, "metric").agg(F.avg("value").alias("value"))


def _gathered(df: DataFrame, keys: list[str], position: str, values: list[str], vote: str | None = None) -> DataFrame:
    """keys, an array of doubles for each of values (_x0, _x1, ...) and, with a vote, _codes: each group's rows in the order of position, votes as their places among the group's different ones."""
    votes = [F.col(vote).alias("_vote")] if vote else []
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).isNull().alias("_last"), F.col(position).alias("_at"), *(F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(values)), *votes)))
    out = df.groupBy(*keys).agg(rows.alias("_g")).select(*keys, *(f"_g._x{i}" for i in range(len(values))), *(["_g._vote"] if vote else []))
    if not vote:
        return out
    # A null vote is one of the votes.
    return out.withColumn("_kinds", F.array_distinct("_vote")).withColumn("_codes", F.transform("_vote", lambda v: F.coalesce(F.array_position("_kinds", v), F.lit(0)).cast("int"))).drop("_vote", "_kinds")


def _by_size(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(places in the batch, a matrix of each column) of the groups of each size."""
    lists = [batch[c] for c in columns]
    starts = [x.offsets.to_numpy()[:-1] - x.offsets[0].as_py() for x in lists]
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    sizes = np.diff(lists[0].offsets.to_numpy())
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, [v[s[at][:, None] + np.arange(n)] for v, s in zip(flat, starts, strict=True)]


def _drawn(n: int, draws: int, k: int, seed: int) -> np.ndarray:
    """Places of the rows drawn, a row for each draw, in NumPy's random stream: the same in all groups of n rows."""
    np.random.seed(seed)
    return np.random.choice(n, size=(draws, k), replace=True)


def _extremes(x: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest and the lowest value of each draw, a row for each group."""
    top = low = x[:, drawn[:, 0]]
    for j in range(1, drawn.shape[1]):
        own = x[:, drawn[:, j]]
        top, low = np.maximum(top, own), np.minimum(low, own)
    return top, low


def _most_common(x: np.ndarray, codes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Of each draw the first drawn row's value of the most common vote, the first drawn of equal ones."""
    groups, draws, kinds = len(x), len(drawn), int(codes.max()) + 1
    told = codes[:, drawn] + kinds * np.arange(groups * draws).reshape(groups, draws, 1)
    counts = np.bincount(told.ravel(), minlength=groups * draws * kinds)[told]
    return np.take_along_axis(x, drawn[np.arange(draws), counts.argmax(2)], 1)


def _parts(n: int, cells: int) -> list[slice]:
    """Slices of n groups, so that a slice's draws are some hundred thousand cells."""
    step = max(1, 500_000 // max(cells, 1))
    return [slice(i, i + step) for i in range(0, n, step)]


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, float), from_pandas=True)


def bootstrap(df: DataFrame, keys: list[str], value: str, size: int, position: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """keys, n, best, best_std, worst, worst_std of seeded resamples of a (small) group in the order of position, in NumPy's random stream.

    Groups of one size have the same draws, so they are resampled together.
    """
    schema = StructType([*df.select(*keys).schema.fields, StructField("n", LongType()), *(StructField(c, DoubleType()) for c in ("best", "best_std", "worst", "worst_std"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (x,) in _by_size(batch, ["_x0"]):
                n = x.shape[1]
                drawn = _drawn(n, draws, size, seed)
                got = []
                for part in _parts(len(x), draws):
                    top, low = _extremes(x[part], drawn)
                    got.append(np.stack([top.mean(1), top.std(1), low.mean(1), low.std(1)]))
                told = np.concatenate(got, 1)
                places = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch[k].take(places) for k in keys), pa.array(np.full(len(at), n)), *map(_doubles, told)], names=schema.names)

    return _gathered(df, keys, position, [value]).mapInArrow(run, schema)


def resampled_tree(df: DataFrame, source: str, uid: str, values: list[str], position: str, vote: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """source, variable, metric, value: mean@n, std@n, and for k of the ladder best@k, worst@k and (with a vote) maj@k, each /mean and /std over seeded resamples.

    A prompt's responses are one small group, resampled in the order of position in NumPy's
    random stream; prompts then weigh 1 each. Null values make a prompt's metric null. Groups of
    one size have the same draws, so they are resampled together.
    """
    schema = StructType([*df.select(source).schema.fields, *(StructField(c, StringType()) for c in ("variable", "metric")), StructField("value", DoubleType())])

    def rungs(n: int) -> list[int]:
        return [*(1 << k for k in range(1, n.bit_length()) if 1 << k < n), *([n] if n > 1 else [])]

    def told(x: np.ndarray, codes: np.ndarray | None) -> Iterator[tuple[str, np.ndarray]]:
        n = x.shape[1]
        yield f"mean@{n}", x.mean(1)
        if n > 1:
            yield f"std@{n}", x.std(1)
        for k in rungs(n):
            drawn = _drawn(n, draws, k, seed)
            got: dict[str, list[np.ndarray]] = {}
            for part in _parts(len(x), draws * k):
                own = dict(zip(("best", "worst"), _extremes(x[part], drawn), strict=True))
                if codes is not None:
                    own["maj"] = _most_common(x[part], codes[part], drawn)
                for kind, v in own.items():
                    got.setdefault(kind, []).append(np.stack([v.mean(1), v.std(1)]))
            for kind, some in got.items():
                mean, std = np.concatenate(some, 1)
                yield f"{kind}@{k}/mean", mean
                yield f"{kind}@{k}/std", std

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [f"_x{i}" for i in range(len(values))] + (["_codes"] if vote else [])
        for batch in batches:
            for at, matrices in _by_size(batch, columns):
                sources = batch[source].take(pa.array(at))
                for name, x in zip(values, matrices, strict=False):
                    for metric, v in told(x, matrices[-1] if vote else None):
                        yield pa.RecordBatch.from_arrays([sources, pa.array([name] * len(at), pa.string()), pa.array([metric] * len(at), pa.string()), _doubles(v)], names=schema.names)

    each = _gathered(df, [source, uid], position, values, vote).mapInArrow(run, schema)
    return each.groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def reduce_by_name(metrics: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, value: the maximum of keys with "max" in the name, the minimum with "min", else the mean."""
    k = F.col(key)
    return metrics.groupBy(key).agg(F.when(k.contains("max"), F.max(value)).when(k.contains("min"), F.min(value)).otherwise(F.avg(value)).alias("value"))


def aggregate_typed(metrics: DataFrame, key: str = "key", kind: str = "kind", rank: str = "rank", value: str = "value") -> DataFrame:
    """key, value: kinds sum and mean are summed or meaned within a rank and then meaned; max and min are flat."""
    of_rank = metrics.groupBy(key, kind, rank).agg(F.sum(value).alias("s"), F.avg(value).alias("a"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    t = F.col(kind)
    return of_rank.groupBy(key, kind).agg(F.when(t == "sum", F.avg("s")).when(t == "mean", F.avg("a")).when(t == "max", F.max("hi")).otherwise(F.min("lo")).alias("value")).drop(kind)


def aggregate_steps(metrics: DataFrame, key: str = "key", step: str = "step", value: str = "value", weight: str = "weight") -> DataFrame:
    """key, value over steps: a rule by name: last for step and version counters, the sum, maximum or minimum where the name says so, the time total of timings, else the mean weighted by rows."""
    k = F.lower(F.col(key))
    return metrics.groupBy(key).agg(
        F.when(k.rlike("global_steps|epoch|param_version"), F.max_by(value, step)).when(k.rlike("/max$|_max$"), F.max(value)).when(k.rlike("/min$|_min$"), F.min(value)).when(k.rlike("^timing_s/|total_|count"), F.sum(value)).otherwise(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))).alias("value")
    )


def data_metrics(df: DataFrame, score: str, reward: str, advantage: str, returns: str, prompt_len: str, response_len: str, max_prompt: int, max_response: int, values: str | None = None) -> DataFrame:
    """One row of mean, max and min of scores, rewards, advantages, returns and lengths, clip and aborted ratios, and explained variance."""
    live = F.col(response_len) > 0
    out = []
    for name, c in (("score", score), ("reward", reward), ("advantage", advantage), ("returns", returns)):
        x = F.when(live, F.col(c))
        out += [F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max"), F.min(x).alias(f"{name}_min")]
    for name, c, most in (("prompt_length", prompt_len, max_prompt), ("response_length", response_len, max_response)):
        out += [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min"), F.avg((F.col(c) == most).cast("double")).alias(f"{name}_clip_ratio")]
    out += [F.avg((~live).cast("double")).alias("aborted_ratio")]
    if values:
        out += [(1 - F.try_divide(F.var_samp(F.col(returns) - F.col(values)), F.var_samp(returns) + 1e-5)).alias("explained_variance")]
    return df.agg(*out)


def timing_metrics(timings: DataFrame, tokens: DataFrame, section: str = "section", seconds: str = "seconds") -> DataFrame:
    """section, seconds, ms_per_token; tokens: one row with prompt_tokens and response_tokens. Generation counts responses alone."""
    n = F.when(F.col(section) == "gen", F.col("response_tokens")).otherwise(F.col("prompt_tokens") + F.col("response_tokens"))
    return timings.crossJoin(F.broadcast(tokens)).select(section, seconds, (F.col(seconds) * 1000 / n).alias("ms_per_token"))


def throughput(tokens: Column, seconds: Column, workers: int) -> Column:
    return tokens / (seconds * workers)


def variance_proxies(df: DataFrame, advantage: str, weight: str, seq: str, mask: str, gradient_norm: float | None = None) -> DataFrame:
    """One row: mean of A^2 W over sequences, W being a sequence's summed path variance; and the signal left of a gradient's square."""
    rows = df.where(F.col(mask) != 0).groupBy(seq).agg(F.avg(advantage).alias("a"), F.sum(weight).alias("w"))
    out = rows.agg(F.avg(F.col("a") * F.col("a") * F.col("w")).alias("proxy"), F.avg("w").alias("expected_w"), F.avg(F.col("a") * F.col("a")).alias("expected_a2"))
    return out.withColumn("signal", F.greatest(F.lit((gradient_norm or 0.0) ** 2) - F.col("proxy"), F.lit(0.0)))


def zero_filled_histogram(df: DataFrame, key: str, bucket: Column, buckets: int) -> DataFrame:
    """key, bucket, c for every bucket from 0, also empty ones. The zero rows are as many as keys times buckets."""
    counted = df.select(key, bucket.cast("int").alias("bucket")).groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("c"))
    grid = df.select(key).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return grid.join(counted, [key, "bucket"], "left").select(key, "bucket", F.coalesce("c", F.lit(0).cast("long")).alias("c"))


def expert_loads(df: DataFrame, layers: str, mask: str, experts: int) -> DataFrame:
    """layer, bucket (expert), c: from arrays [token][layer][choice] of expert ids, without each row's last masked-in token."""
    last = F.array_max(F.transform(F.col(mask), lambda m, i: F.when(m != 0, i)))
    kept = F.filter(F.col(layers), lambda x, i: (F.get(F.col(mask), i) != 0) & (i != last))
    tokens = df.select(F.explode(kept).alias("token")).select(F.posexplode("token").alias("layer", "chosen"))
    return zero_filled_histogram(tokens.select("layer", F.explode("chosen").alias("expert")), "layer", F.col("expert"), experts)


def load_violation(loads: DataFrame, experts: int) -> DataFrame:
    """One row: maximum, minimum and mean over layers of the largest load over the mean load, less 1."""
    per = loads.groupBy("layer").agg((F.max("c") * experts / F.sum("c") - 1).alias("v"))
    return per.agg(F.max("v").alias("max"), F.min("v").alias("min"), F.avg("v").alias("avg"))


def ratio_means(df: DataFrame, drafts: str, accepts: str, verifies: str) -> DataFrame:
    """One row: means over rows of accepted over drafted and of accepted over verified, 0 where there was none."""
    each = lambda a, b: F.avg(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0))
    return df.agg(each(accepts, drafts).alias("accept_rate"), each(accepts, verifies).alias("accept_length"))


def _placed(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, value, i (the place of the value within its key, from 0), n; null values are left out. A key of many rows is spread over ranges."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    placed = with_position(rows, [*keys, value], "_at")
    own = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n")) if keys else placed.agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    if not keys:
        return placed.crossJoin(F.broadcast(own)).withColumn("i", F.col("_at") - F.col("_first")).drop("_at", "_first")
    renamed = own.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_first", "n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(renamed, same).withColumn("i", F.col("_at") - F.col("_first")).select(*keys, value, "i", "n")


def percentiles_linear(df: DataFrame, value: str, fractions: list[float], keys: list[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, a column p50, p95, ... each: from the two values beside each place."""
    placed = _placed(df, value, list(keys))
    out = []
    for f in fractions:
        at = f * (F.col("n") - 1)
        share = F.when(F.col("i") == F.floor(at), 1 - (at - F.floor(at))).when(F.col("i") == F.floor(at) + 1, at - F.floor(at))
        out.append(F.sum(F.col(value) * share).alias(f"p{round(f * 100)}"))
    return placed.groupBy(*keys).agg(*out)


def percentile_nearest(df: DataFrame, value: str, fraction: float, keys: list[str] = ()) -> DataFrame:
    """The value at the rank round(fraction * (n - 1)), half to even."""
    placed = _placed(df, value, list(keys))
    return placed.where(F.col("i") == F.bround(fraction * (F.col("n") - 1))).select(*keys, F.col(value).alias("percentile"))


def result_summary(df: DataFrame, conflict: str, confidence: str, thresholds: list[float], keys: list[str] = ()) -> DataFrame:
    """Counts, the rate of conflicts, and conflicts at each confidence threshold."""
    at = [F.count_if(F.col(conflict) & (F.col(confidence) >= t)).alias(f"at_{round(t * 100)}") for t in thresholds]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(conflict)).alias("conflicts"), F.avg(F.col(conflict).cast("double")).alias("rate"), F.avg(confidence).alias("confidence"), *at)


def trend(df: DataFrame, source: str, step: str, metrics: list[str]) -> DataFrame:
    """source, step, metric, mean, n of each metric column, from one aggregation."""
    wide = df.groupBy(source, step).agg(*(F.struct(F.avg(m).alias("mean"), F.count(m).alias("n")).alias(m) for m in metrics))
    return wide.select(source, step, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}.mean").alias("mean"), F.col(f"{m}.n").alias("n")) for m in metrics))).alias("x")).select(source, step, "x.*")


def imbalance_change(df: DataFrame, before: str, after: str, load: str) -> DataFrame:
    """One row: imbalance() of two ways of dealing the rows, with `before_` and `after_` in front, and both means of the largest difference."""
    a, b = (imbalance(df, p, load).select(*(F.col(c).alias(f"{n}_{c}") for c in ("max", "min", "mean", "spread"))) for n, p in (("before", before), ("after", after)))
    return a.crossJoin(F.broadcast(b))


def file_counts(rows: DataFrame, file: str, flags: dict[str, Column]) -> DataFrame:
    """file, rows and a count for each flag, and a row of all files (file is null there): counters that add."""
    counted = rows.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    return counted.unionByName(counted.agg(F.lit(None).cast("string").alias(file), F.sum("rows").alias("rows"), *(F.sum(n).alias(n) for n in flags)).select(*counted.columns))


def imbalance(df: DataFrame, part: str, load: str) -> DataFrame:
    """One row: the largest, smallest and mean load of the parts, and the spread."""
    sums = df.groupBy(part).agg(F.sum(load).alias("load"))
    return sums.agg(F.max("load").alias("max"), F.min("load").alias("min"), F.avg("load").alias("mean"), (F.max("load") - F.min("load")).alias("spread"))


def mean_of_means(df: DataFrame, source: str, scores: str) -> DataFrame:
    """source, score: the mean over rows of the mean of each row's array."""
    own = F.aggregate(F.col(scores), F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return df.groupBy(source).agg(F.avg(own).alias("score"))


def merge_scores(df: DataFrame, prompt: str, score: str, most: int, order: str) -> DataFrame:
    """prompt, scores, n: at most `most` scores of a prompt, chosen by a hash of `order`; others never leave the window."""
    w = Window.partitionBy(prompt)
    ranked = df.select(prompt, score, F.row_number().over(w.orderBy(F.xxhash64(order), order)).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.where(F.col("k") <= most).groupBy(prompt).agg(F.sort_array(F.collect_list(score)).alias("scores"), F.max("n").alias("n"))


def preference_metrics(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """One row: means, extremes and accuracy of a pair's rewards and their margin."""
    margin = F.col(chosen) - F.col(rejected)
    return df.agg(F.avg(chosen).alias("chosen_mean"), F.avg(rejected).alias("rejected_mean"), F.avg(margin).alias("margin_mean"), F.max(margin).alias("margin_max"), F.min(margin).alias("margin_min"), F.avg((margin > 0).cast("double")).alias("accuracy"))
