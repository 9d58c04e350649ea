"""Set and shape operators on rows with a position: chunk, repeat, pad, fold, unite, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the hash sample that a range's bound stands for, and bounds that one step of the search passes.
SAMPLED, STRIDE = 20, 32


def ranged(df: DataFrame, order: list[str], name: str = "_range", ranges: int | None = None) -> DataFrame:
    """Adds the number of the row's range in the given order; ranges are of about one size.

    The bounds are a sorted sample that a hash of the order chooses, so every plan that
    evaluates this frame puts a row in the same range, whatever is pruned or coalesced. Rows
    that are equal in the order are split by a hash of all columns. The sample and its bounds
    are as many as the ranges need, and a row finds its range in two steps.
    """
    n = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    types = dict(df.dtypes)
    whole = F.xxhash64(*(F.to_json(F.struct(c)) if types[c].startswith("map") else F.col(c) for c in df.columns))
    keyed = df.select("*", F.struct(*(F.col(c) for c in order), whole.alias("_tie")).alias("_key"))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(n * SAMPLED)
    at = F.sort_array(F.collect_list("_key"))
    picked = sample.agg(at.alias("_s")).select(F.filter("_s", lambda x, i: i % SAMPLED == SAMPLED - 1).alias("_fine"))
    picked = picked.select("_fine", F.filter("_fine", lambda x, i: i % STRIDE == STRIDE - 1).alias("_coarse"))
    jump = F.size(F.filter("_coarse", lambda x: x < F.col("_key"))) * STRIDE
    found = jump + F.size(F.filter(F.slice("_fine", jump + 1, F.lit(STRIDE)), lambda x: x < F.col("_key")))
    return keyed.crossJoin(F.broadcast(picked)).withColumn(name, found).drop("_fine", "_coarse")


def with_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Adds positions from 0 without gaps in the given order (nulls first; equal rows in any), without one sorted partition: ranges, their sizes, a sum."""
    parts = ranged(df, order)
    local = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1)
    # A row for each range: their number is fixed.
    sizes = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_i")).drop("_range", "_key", "_i", "_start")


def select_rows(df: DataFrame, positions: DataFrame, position: str = "pos") -> DataFrame:
    """The rows at given positions (a frame with that column), each as often as it is named."""
    return df.join(positions.select(position), position)


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, step: int = 1, position: str = "pos") -> DataFrame:
    p = F.col(position)
    out = df.where((p >= start) & (F.lit(True) if end is None else p < end))
    return out.where((p - start) % step == 0)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """ValueError for a column that isn't there or a name that is taken."""
    if missing := names.keys() - set(df.columns):
        raise ValueError(f"no such column: {sorted(missing)}")
    if taken := set(names.values()) & (set(df.columns) - names.keys()):
        raise ValueError(f"taken: {sorted(taken)}")
    return df.withColumnsRenamed(names)


def pop(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(key and the columns, the frame without them)."""
    return df.select(key, *columns), df.drop(*columns)


def concat(frames: list[DataFrame], meta: list[dict] | None = None) -> tuple[DataFrame, dict] | DataFrame:
    """All rows, by column names. With meta, each frame's notes: (the rows, the notes together); ValueError where two notes differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if meta is None:
        return out
    notes: dict = {}
    for own in meta:
        for k, v in own.items():
            if notes.setdefault(k, v) != v:
                raise ValueError(f"{k} is {notes[k]!r} and {v!r}")
    return out, notes


def concat_ragged(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns differ in places: a column that a frame lacks is null there; arrays keep their own lengths."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unite(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All columns of both by key; a column that both have must be equal row by row, and no key may lack: else an error when run."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.withColumnsRenamed({c: f"_other_{c}" for c in shared}).withColumn("_in_right", F.lit(True))
    both = left.withColumn("_in_left", F.lit(True)).join(r, key, "full_outer")
    bad = F.col("_in_left").isNull() | F.col("_in_right").isNull()
    for c in shared:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    checked = both.withColumn(key, F.when(bad, F.raise_error(F.lit("the frames differ")).cast(dict(left.dtypes)[key])).otherwise(F.col(key)))
    return checked.drop("_in_left", "_in_right", *(f"_other_{c}" for c in shared))


def chunk(df: DataFrame, n: int, total: Column, position: str = "pos") -> DataFrame:
    """Adds chunk: n pieces in order, the first ones a row longer if the rows don't divide."""
    p, small = F.col(position), F.floor(total / n)
    longer = total % n
    return df.withColumn("chunk", F.when(p < longer * (small + 1), F.floor(p / (small + 1))).otherwise(longer + F.floor(F.try_divide(p - longer * (small + 1), small))).cast("int"))


def split(df: DataFrame, size: int, position: str = "pos") -> DataFrame:
    return df.withColumn("split", F.floor(F.col(position) / size).cast("int"))


def repeat(df: DataFrame, times: int, total: Column, interleave: bool = True, position: str = "pos") -> DataFrame:
    """Every row `times` times; new positions keep copies together (interleave), or the whole frame (tile)."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn("new_pos", F.col(position) * times + F.col("copy") if interleave else F.col("copy") * total + F.col(position))


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Every row as often as the column says; 0 drops it."""
    return df.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))


def unfold_chunks(df: DataFrame, column: str, n: int) -> DataFrame:
    """Each row's array in n equal parts, a row each, with the part's number; an array that doesn't divide is an error when run."""
    size = F.size(column)
    each = F.when(size % n != 0, F.raise_error(F.lit(f"an array doesn't divide into {n} parts")).cast("int")).otherwise((size / n).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(F.col(column), k * each + 1, each))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(parts).alias("part", column))


def fold(df: DataFrame, columns: list[str], size: int, position: str = "pos") -> DataFrame:
    """Arrays of `size` rows in a row, by position."""
    group = F.floor(F.col(position) / size).cast("long").alias("slot")
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(position, *columns))).alias("_rows"))
    return rows.select("slot", *(F.col(f"_rows.{c}").alias(c) for c in columns))


def unfold(df: DataFrame, columns: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("i", "_x")).select(*rest, "i", *(F.col(f"_x.{c}").alias(c) for c in columns))


def pad_to_divisor(df: DataFrame, divisor: int, total: int, position: str = "pos") -> DataFrame:
    """Rows from the head again, in cycles, until the count divides; they are flagged is_padding."""
    lacking = -total % divisor if total else 0
    head = df.where(F.col(position) < min(lacking, total))
    cycles = head.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-lacking // max(total, 1)) - 1)))))
    more = cycles.where(F.col("_c") * total + F.col(position) < lacking).withColumn(position, F.lit(total) + F.col("_c") * total + F.col(position)).drop("_c")
    return df.withColumn("is_padding", F.lit(False)).unionByName(more.withColumn("is_padding", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_padding")).drop("is_padding")


def pad_with_empty(df: DataFrame, divisor: int, total: int, end_id: int, prompt: str = "prompt_ids", response: str = "response_ids", uid: str = "uid", session: str = "session", zero: tuple[str, ...] = (), pad_uid: str = "pad") -> DataFrame:
    """Made-up rows until the count divides: one prompt token, one response token (the end), one group of its own, ascending sessions.

    Columns in `zero` are 0, or arrays of one 0, so that the rows add to no loss and no reward;
    any other column is that of the first row by uid and session. They are flagged is_padding.
    """
    lacking = -total % divisor
    types = {f.name: f.dataType for f in df.schema.fields}
    first = df.orderBy(uid, session).limit(1)
    pads = first.withColumn("_p", F.explode(F.sequence(F.lit(1), F.lit(max(lacking, 1))))).where(F.col("_p") <= lacking)
    one = lambda c, v: F.array(F.lit(v)).cast(types[c]) if types[c].typeName() == "array" else F.lit(v).cast(types[c])
    made = {prompt: one(prompt, end_id), response: one(response, end_id), uid: F.lit(pad_uid), session: (F.col("_p") - 1).cast(types[session])} | {c: one(c, 0) for c in zero}
    pads = pads.select(*(made.get(c, F.col(c)).alias(c) for c in df.columns))
    return df.withColumn("is_padding", F.lit(False)).unionByName(pads.withColumn("is_padding", F.lit(True)))


def minibatches(df: DataFrame, size: int, epochs: int, seed: int, key: str) -> DataFrame:
    """epoch, batch of each row: every epoch orders the rows anew by a seeded hash and cuts batches of exactly `size` (the last may be smaller)."""
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    dealt = with_position(each.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", key)), ["epoch", "_h"], "_at")
    first = dealt.groupBy("epoch").agg(F.min("_at").alias("_first"))
    return dealt.join(F.broadcast(first), "epoch").withColumn("batch", F.floor((F.col("_at") - F.col("_first")) / size).cast("int")).drop("_h", "_at", "_first")


def collated(df: DataFrame, dense: list[str], ragged: list[str], size: int, position: str = "pos", pad: float = 0.0) -> DataFrame:
    """A row for each batch of `size` rows in a row: dense columns as arrays; ragged array columns padded to the batch's longest, with their lengths."""
    rows = fold(df, [*dense, *ragged], size, position)

    def padded(c: str, most: Column) -> Column:
        item = df.schema[c].dataType.elementType
        return F.transform(c, lambda x: F.concat(x, F.array_repeat(F.lit(pad).cast(item), (most - F.size(x)).cast("int"))))

    out = [F.col(c) for c in dense]
    for c in ragged:
        lengths = F.transform(c, lambda x: F.size(x))
        out += [padded(c, F.array_max(lengths)).alias(c), lengths.alias(f"{c}_lengths")]
    return rows.select("slot", *out)


def dealt_by_rank(df: DataFrame, ranks: list[int], n: int, total: Column, position: str = "pos") -> DataFrame:
    """A row for each worker that is to have it: the rows in n chunks, worker w (its place in ranks) getting chunk ranks[w]."""
    chunks = chunk(df, n, total, position)
    to = F.filter(F.transform(F.array(*map(F.lit, ranks)), lambda r, w: F.when(r == F.col("chunk"), w)), lambda w: w.isNotNull())
    return chunks.select("*", F.explode(to).alias("worker"))


def collected_by_rank(df: DataFrame, ranks: list[int], leaders: list[int], worker: str = "worker") -> DataFrame:
    """The rows of the leading worker of each rank alone, so that copies of a chunk count once."""
    return df.where(F.col(worker).isin([w for w in range(len(ranks)) if w in leaders]))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one frame has more often than the other, with the side; empty if they are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def batches(df: DataFrame, size: int, position: str = "pos") -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def reorder(df: DataFrame, permutation: DataFrame, position: str = "pos") -> DataFrame:
    """permutation: position and new_pos; inverse_permutation() gives the way back."""
    return df.join(permutation, position)


def inverse_permutation(permutation: DataFrame, position: str = "pos") -> DataFrame:
    return permutation.select(F.col("new_pos").alias(position), F.col(position).alias("new_pos"))
