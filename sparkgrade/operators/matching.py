"""Joins and look-ups: tracing prompts back, resuming, alignment, last record wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shortest source key that may be found inside a longer one.
SHORTEST = 24
#: Leading bits of a hash that are marked for the heads: a table of fixed size.
BITS = 22


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _places(text: str) -> np.ndarray:
    """A hash of the SHORTEST (24) characters from each place of a text on; the hashes of 1, 2, 4, ... characters make up those of more."""
    own, power, n = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while n < 16:
        if n == 8:
            short, eight = own, np.uint64(power)
        own = own[:-n] * np.uint64(power) + own[n:]
        power, n = power * power % (1 << 64), 2 * n
    return own[: len(text) - SHORTEST + 1] * eight + short[16:]


def heads(sources: DataFrame, source_key: str) -> DataFrame:
    """The index of sources that can be found inside a key: _sk, _head (a hash of its first SHORTEST characters); each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_places(t.as_py()[:SHORTEST])[0] for t in batch["_sk"]]
            yield pa.RecordBatch.from_arrays([batch["_sk"], pa.array(np.array(own, np.uint64).view(np.int64))], names=["_sk", "_head"])

    own = sources.select(F.col(source_key).alias("_sk")).where(F.char_length("_sk") >= SHORTEST).distinct()
    return own.mapInArrow(run, "_sk string, _head bigint")


def _asked(keys: DataFrame, index: DataFrame) -> DataFrame:
    """_id, _head of the places of keys (_id, _k) whose hash begins with the bits of some head; the others can't be one."""
    marked = np.zeros(1 << BITS, bool)
    marked[index.select(F.shiftrightunsigned("_head", 64 - BITS).cast("int").alias("m")).distinct().toArrow()["m"].to_numpy()] = True
    sent = keys.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            found = []
            for text in batch["_k"]:
                own = _places(text.as_py())
                found.append(np.unique(own[marks[own >> np.uint64(64 - BITS)]]).view(np.int64))
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch["_id"].take(pa.array(at)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["_id", "_head"])

    return keys.select("_id", "_k").mapInArrow(run, "_id bigint, _head bigint")


def trace_back(records: DataFrame, sources: DataFrame, record_id: str, key: str, source_key: str, ordinal: str, truth: str | None = None, source_truth: str | None = None, override: dict[str, str] | None = None) -> DataFrame:
    """record_id, ordinal (null if none): the source with the record's key; else the longest source key of SHORTEST
    characters or more inside it. Equal truth narrows the choice if any has it; then the first source.
    override: further columns of sources (by name) that the result takes over under new names.

    Only keys without an equal one, each once, go to the containment step. A source key inside a
    key shares its first SHORTEST characters with some place of it: the hashes of those places
    meet the hashes of the sources' heads, rows of two numbers, and only the pairs that agree
    take their texts back for the exact test.
    """
    more = override or {}
    src = sources.where(F.col(source_key) != "").select(F.col(source_key).alias("_sk"), F.col(ordinal).alias("_o"), (F.col(source_truth) if source_truth else F.lit(None)).cast("string").alias("_st"), F.struct(F.lit(0).alias("_"), *(F.col(c).alias(n) for c, n in more.items())).alias("_more"))
    rec = records.select(F.col(record_id).alias("_r"), F.col(key).alias("_k"), (F.col(truth) if truth else F.lit(None)).cast("string").alias("_t"))
    exact = rec.join(src, F.col("_k") == F.col("_sk"))
    rest = rec.join(src.select("_sk").distinct(), F.col("_k") == F.col("_sk"), "left_anti")
    keys = rest.where(F.char_length("_k") >= SHORTEST).select("_k").distinct().withColumn("_id", F.xxhash64("_k"))
    index = heads(src, "_sk")
    asked = _asked(keys, index)
    met = asked.join(index.select("_head").distinct(), "_head", "left_semi").distinct()
    inside = met.join(keys, "_id").join(index, "_head").where(F.contains("_k", "_sk")).groupBy("_k").agg(F.max_by("_sk", F.struct(F.char_length("_sk"), "_sk")).alias("_sk"))
    loose = rest.join(inside, "_k").join(src, "_sk")
    columns = ("_r", "_o", "_t", "_st", "_more")
    found = F.struct(F.col("_o"), F.col("_more"))
    best = exact.select(*columns).unionByName(loose.select(*columns)).groupBy("_r").agg(F.min_by(found, F.struct(F.when(F.col("_t") == F.col("_st"), 0).otherwise(1).alias("x"), F.col("_o").alias("y"))).alias("_b"))
    return rec.select("_r").join(best, "_r", "left").select(F.col("_r").alias(record_id), F.col("_b._o").alias(ordinal), *(F.col(f"_b._more.{n}").alias(n) for n in more.values()))


def match_counts(traced: DataFrame, ordinal: str, keys: list[str] = ()) -> DataFrame:
    """matched and unmatched records."""
    return traced.groupBy(*keys).agg(F.count(ordinal).alias("matched"), F.count_if(F.col(ordinal).isNull()).alias("unmatched"))


def remaining(rows: DataFrame, done: DataFrame, key: str, retry_errors: bool = False, error: str = "error") -> DataFrame:
    """Rows without a record, and if wanted those whose record is an error."""
    finished = done.where(F.col(error).isNull()) if retry_errors else done
    return rows.join(finished.select(key), key, "left_anti")


def alignment_faults(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> DataFrame:
    """key, fault: rows that one side lacks, or whose columns differ. Empty if the runs are aligned."""
    a = left.select(F.col(key).alias("_a"), F.struct(*same).alias("_l"))
    b = right.select(F.col(key).alias("_b"), F.struct(*same).alias("_r"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    fault = F.when(F.col("_b").isNull(), "missing right").when(F.col("_a").isNull(), "missing left").when(~F.col("_l").eqNullSafe(F.col("_r")), "differs")
    return both.select(F.coalesce("_a", "_b").alias(key), fault.alias("fault")).where("fault IS NOT NULL")


def aligned(runs: dict[str, DataFrame], key: str, same: list[str], order: str | None = None) -> DataFrame:
    """key, run, fault of any number of runs: keys that a run lacks, has more than once, or holds with other columns than the first run has. Empty if all are aligned.

    order: a column that must be each run's place of the key, as it is in the first.
    """
    names = list(runs)
    columns = [*same, *([order] if order else [])]
    rows = None
    for i, name in enumerate(names):
        own = runs[name].select(F.col(key).alias("_k"), F.lit(i).alias("_run"), F.struct(*columns).alias("_v"))
        rows = own if rows is None else rows.unionByName(own)
    by_key = rows.groupBy("_k").agg(F.collect_list(F.struct("_run", "_v")).alias("_all"))
    first = F.get(F.filter("_all", lambda x: x["_run"] == 0), F.lit(0))

    def judged(run: Column) -> Column:
        own = F.filter("_all", lambda x: x["_run"] == run)
        value = F.get(own, F.lit(0))["_v"]
        fault = F.when(F.size(own) == 0, "missing").when(F.size(own) > 1, "repeated").when(first.isNotNull() & ~value.eqNullSafe(first["_v"]), "differs")
        return F.struct(run.alias("run"), fault.alias("fault"))

    each = by_key.select(F.col("_k").alias(key), F.explode(F.transform(F.array(*(F.lit(i) for i in range(len(names)))), judged)).alias("_f"))
    return each.where("_f.fault IS NOT NULL").select(key, F.element_at(F.array(*map(F.lit, names)), F.col("_f.run") + 1).alias("run"), F.col("_f.fault").alias("fault"))


def completeness(df: DataFrame, order: str, expected: int, constant: list[str]) -> DataFrame:
    """One row `complete`: the expected count, orders exactly 0 to n - 1, and constants that are."""
    same = [F.count_distinct(c) <= 1 for c in constant]
    ok = (F.count(F.lit(1)) == expected) & (F.count_distinct(order) == expected) & (F.min(order) == 0) & (F.max(order) == expected - 1)
    for s in same:
        ok = ok & s
    return df.agg(ok.alias("complete"))


def compatible(done: DataFrame, selected: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Records that can't be resumed: not selected any more, or with other parameters (null-safe)."""
    s = selected.select(F.col(key).alias("_k"), F.struct(*same).alias("_s"))
    return done.join(s, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | ~F.struct(*same).eqNullSafe(F.col("_s"))).drop("_k", "_s")


def results_map(scores: DataFrame, row: str, model: str, columns: list[str]) -> DataFrame:
    """row, models: a map of each model's scores."""
    own = scores.groupBy(row, model).agg(F.first(F.struct(*columns)).alias("s"))
    return own.groupBy(row).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(model).alias("key"), F.col("s").alias("value"))))).alias("models"))
