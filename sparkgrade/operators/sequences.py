"""Folds over token arrays, and masks: recurrences that a window frame can't express, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zip(*columns: Column) -> Column:
    return F.arrays_zip(*(c.alias(f"x{i}") for i, c in enumerate(columns)))


def _struct_zip(names: list[str], columns: list[Column]) -> Column:
    """Array of structs with the given names; the first array's length counts."""
    return F.transform(columns[0], lambda x, i: F.struct(x.alias(names[0]), *(F.get(c, i).alias(n) for n, c in zip(names[1:], columns[1:], strict=True))))


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum where the mask is not 0; what isn't a number counts only within the mask."""
    return F.aggregate(_struct_zip(["v", "m"], [values, mask]), F.lit(0.0), lambda a, x: a + F.when(x["m"] != 0, x["v"] * x["m"]).otherwise(0.0))


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (F.aggregate(mask, F.lit(0.0), lambda a, x: a + x) + 1e-8)


def masked_var(values: Column, mask: Column) -> Column:
    """With Bessel's correction; an error if the mask has one element or none. The mean is evaluated once for each row."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, x: a + x)
    centred = lambda mean: F.transform(values, lambda x: (x - mean) * (x - mean))
    spread = F.transform(F.array(masked_mean(values, mask)), lambda mean: masked_mean(centred(mean), mask))[0]
    return F.when(n <= 1, F.raise_error(F.lit("a variance needs two elements")).cast("double")).otherwise(spread * n / (n - 1))


def response_mask(ids: Column, eos) -> Column:
    """1 up to the first end token and on it, 0 after. eos: one id or several."""
    ends = list(eos) if isinstance(eos, (list, tuple)) else [eos]
    first = F.aggregate(F.transform(ids, lambda x, i: F.when(x.isin(ends), i)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, x))
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i <= first), 1).otherwise(0))


#: Values that a scan appends to one array before it sets it aside.
BLOCK = 256


def scanned(rows: Column, start: dict[str, Column], step) -> Column:
    """Array of doubles, one for each of rows: step(state, row) gives (the next state, the value).

    Values are gathered in blocks, so a long array doesn't cost the square of its length.
    """
    none = F.expr("CAST(array() AS array<double>)")
    names = list(start)
    first = F.struct(*(v.cast("double").alias(n) for n, v in start.items()), none.alias("_own"), F.expr("CAST(array() AS array<array<double>>)").alias("_full"))

    def fold(a: Column, x: Column) -> Column:
        state, value = step(a, x)
        one, full = F.array(value.cast("double")), F.size(a["_own"]) >= BLOCK
        own = F.when(full, one).otherwise(F.concat(a["_own"], one))
        return F.struct(*(state[n].cast("double").alias(n) for n in names), own.alias("_own"), F.when(full, F.concat(a["_full"], F.array(a["_own"]))).otherwise(a["_full"]).alias("_full"))

    return F.aggregate(rows, first, fold, lambda a: F.concat(F.flatten(a["_full"]), a["_own"]))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sums; the running sum starts anew after a masked token."""

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
        now = x["r"] + gamma * a["run"]
        return {"run": now * x["m"]}, now

    return F.reverse(scanned(F.reverse(_struct_zip(["r", "m"], [rewards, mask])), {"run": F.lit(0.0)}, step))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Array of advantages: the reverse recurrence; masked tokens carry the next value and sum through."""

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
        m = x["m"].cast("double")
        now = x["r"] + gamma * a["next"] - x["v"] + gamma * lam * a["sum"]
        kept = now * m + (1 - m) * a["sum"]
        return {"next": x["v"] * m + (1 - m) * a["next"], "sum": kept}, kept

    return F.reverse(scanned(F.reverse(_struct_zip(["r", "v", "m"], [rewards, values, mask])), {"next": F.lit(0.0), "sum": F.lit(0.0)}, step))


def gae_whitened(df: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Adds advantages, whitened over all masked-in tokens, and returns (advantages before that, plus values)."""
    got = df.withColumn("_a", gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam))
    tokens = got.select(F.explode(F.arrays_zip(F.col("_a").alias("a"), F.col(mask).alias("m"))).alias("t")).where("t.m <> 0")
    moments = tokens.agg(F.avg("t.a").alias("_mean"), F.var_samp("t.a").alias("_var"))
    whole = got.crossJoin(F.broadcast(moments))
    out = F.transform("_a", lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8))
    return whole.select(*df.columns, out.alias("advantages"), F.zip_with("_a", values, lambda a, v: a + v).alias("returns"))


def softmax_of(logprobs: Column) -> Column:
    """Array of probabilities of selected labels' log-probabilities."""
    top = F.array_max(logprobs)
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logprobs, lambda x: F.exp(x - top) / total)


def first_argmax(values: Column) -> Column:
    """Place from 0 of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
