"""Ranked lexical search: TPUT over term-partitioned postings.

Rows with one text are one class. The postings of the items' terms have each class's exact
contribution to a score; they are partitioned by ranges of (term, contribution), so a hot term
spans several partitions. Three phases, for all items at once:

1. The heads of every list give partial sums; an item's k-th highest is a lower bound of its
   k-th best score.
2. That bound over the item's number of lists is its threshold for each of them. What reaches
   the lowest threshold of a term is dealt by class, where partial sums and upper bounds meet:
   a list that is silent on a class adds less than the threshold.
3. The exact contributions of the candidates, whose upper bound reaches the k-th highest
   partial sum, are looked up in the postings.

Sums are 64-bit integers, so nothing depends on how rows are dealt. Items are searched in
blocks of bounded text; only what belongs to a block's items and terms is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded_batches, remove, table, written
from .hashing import word_hashes

BEST = 50
#: Bytes of item texts that are searched at once; more items are searched in blocks, one after another.
BLOCK_BYTES = 2 << 20
#: Bytes of texts that are counted at once, and rows of postings that are summed at once.
SLICE_BYTES = 1 << 20
CHUNK_ROWS = 100_000
#: Partial sums (items times classes) that are held at once.
CELLS = 4_000_000
#: A contribution is below 2^40, so a term's place and a threshold fit one 64-bit key.
_BITS = 40
_FORWARD = "doc_id bigint, a bigint, b bigint, n bigint, terms array<int>, tfs array<int>"


class _Items:
    """A block's items by their distinct texts: their terms as places in the sorted array of all the block's terms."""

    def __init__(self, keys: list[int], texts: list[str]) -> None:
        hashes, bounds = word_hashes(pa.array(texts, pa.string()), alnum=True)
        own = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        used = [i for i, x in enumerate(own) if len(x)]
        self.keys = [keys[i] for i in used]
        self.vocabulary = np.unique(np.concatenate([own[i] for i in used])) if used else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocabulary, own[i]) for i in used]

    def pairs(self) -> list[tuple[int, int]]:
        """(item, term) of all lists."""
        return [(i, int(t)) for i, terms in enumerate(self.terms) for t in terms]


def _counted(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """doc_id, a digest of the text, its number of terms, and the counts of the vocabulary's terms."""
    known = vocabulary.value
    for batch in batches:
        for some in slices(batch, SLICE_BYTES):
            texts = some.column(1)
            hashes, bounds = word_hashes(texts, alnum=True)
            docs = np.repeat(np.arange(some.num_rows), np.diff(bounds))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            pairs, counts = np.unique(docs[hit] * len(known) + at[hit], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(some.num_rows + 1) * len(known)).astype(np.int32)
            digests = np.frombuffer(b"".join(hashlib.blake2b(t.as_buffer() if t.is_valid else b"", digest_size=16).digest() for t in texts.cast(pa.binary())), "<i8").reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pairs % len(known), counts)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(np.diff(bounds)), *lists], ["doc_id", "a", "b", "n", "terms", "tfs"])


def _limited(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark takes them in each partition before it shuffles."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= k)


def _kth(sums: DataFrame, k: int) -> dict[int, int]:
    """item -> its k-th highest partial sum, for the items that have k of them."""
    rows = _limited(sums, "item", [F.desc("partial")], k).where(F.col("_place") == k).select("item", "partial").collect()
    return {r.item: r.partial for r in rows}


class _Thresholds:
    """For each term, the thresholds of its items in ascending order, in one sorted array."""

    def __init__(self, items: _Items, lower: dict[int, int], k: int) -> None:
        self.k, self.lower = k, np.array([lower.get(i, 0) for i in range(len(items.terms))], np.int64)
        self.lists = np.array([len(t) for t in items.terms], np.int64)
        #: The least contribution that an item is sent.
        self.least = np.maximum(1, -(-self.lower // np.maximum(1, self.lists)))
        terms, owners = np.concatenate(items.terms).astype(np.int64), np.repeat(np.arange(len(items.terms)), self.lists)
        keys = (terms << _BITS) | self.least[owners]
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.starts = np.searchsorted(self.keys, np.arange(len(items.vocabulary) + 1) << _BITS)

    def lowest(self) -> list[tuple[int, int]]:
        return [(t, int(self.keys[s] & ((1 << _BITS) - 1))) for t, s in enumerate(self.starts[:-1])]

    def sums(self, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Partial sums and upper bounds, count x items; a class without a contribution has an upper bound of 0."""
        sent = np.searchsorted(self.keys, (terms << _BITS) | values, "right") - self.starts[terms]
        rows = np.repeat(np.arange(len(terms)), sent)
        owners = self.owners[np.repeat(self.starts[terms] - (np.cumsum(sent) - sent), sent) + np.arange(int(sent.sum()))]
        cells, n = docs[rows] * len(self.lists) + owners, count * len(self.lists)
        partial, seen = np.zeros(n, np.int64), np.bincount(cells, minlength=n)
        np.add.at(partial, cells, values[rows])
        partial, seen = partial.reshape(count, -1), seen.reshape(count, -1)
        return partial, np.where(seen > 0, partial + (self.lists - seen) * (self.least - 1), 0)


def _candidates(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """item, class, partial, upper of pairs whose upper bound reaches the item's bound so far; rows come sorted by class.

    The bound starts at the lower bound of phase 1 and rises to the k-th highest partial sum
    among the classes of this task: both are at most the k-th highest of all.
    """
    told = sent.value
    most = max(1, CELLS // len(told.lists))
    highest = np.zeros((told.k, len(told.lists)), np.int64)

    def summed(classes: np.ndarray, terms: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal highest
        names, docs = np.unique(classes, return_inverse=True)
        for start in range(0, len(names), most):
            some = slice(*np.searchsorted(docs, [start, start + most]))
            count = min(most, len(names) - start)
            partial, upper = told.sums(docs[some] - start, terms[some], values[some], count)
            highest = np.partition(np.concatenate([highest, partial]), count, axis=0)[count:]
            d, i = np.nonzero((upper > 0) & (upper >= np.maximum(told.lower, highest[0])))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(names[start + d]), pa.array(partial[d, i]), pa.array(upper[d, i])], ["item", "class", "partial", "upper"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(np.asarray(batch.column(c)).astype(np.int64) for c in ("class", "term", "v")))
        if sum(len(h[0]) for h in held) >= CHUNK_ROWS:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last class may go on
            yield from summed(*(x[:cut] for x in whole))
            held = [tuple(x[cut:] for x in whole)]
    if held:
        yield from summed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _postings(classes: DataFrame) -> DataFrame | None:
    """term, class, v: what each term adds to a class's score. None if no row has a term."""
    total = classes.agg(F.sum(F.when(F.col("n") > 0, F.col("copies"))).alias("N"), F.sum(F.col("n") * F.col("copies")).alias("L")).first()
    if not total.L:
        return None
    each = classes.select("class", "n", "copies", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
    weight = F.floor(1000 * F.log(F.lit(2 * total.N + 2).cast("double") / (2 * F.sum("copies") + 1)))
    # A row for each of the block's terms at most.
    weights = each.groupBy("term").agg(weight.alias("w"))
    size = f"(50 + (50 * n * {total.N}L) div {total.L}L)"
    return each.join(F.broadcast(weights), "term").select("term", "class", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 20L * {size}))").alias("v")).where("v > 0")


def _block(docs: DataFrame, items: _Items, k: int) -> DataFrame | None:
    """item, doc_id, score of the k best rows of each item of a block."""
    spark = docs.sparkSession
    if not items.keys:
        return None
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)
    forward = written(docs.mapInArrow(functools.partial(_counted, vocabulary=vocabulary), _FORWARD), "forward")
    once = forward.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("terms").alias("terms"), F.first("tfs").alias("tfs"), F.count(F.lit(1)).alias("copies"))
    classes = written(once.withColumn("class", F.monotonically_increasing_id()), "classes")
    postings = _postings(classes)
    if postings is None:
        return None
    postings = written(postings.repartitionByRange(F.col("term"), F.desc("v"), F.col("class")).sortWithinPartitions("term", F.desc("v")), "postings")

    # Phase 1. The item's lists: a row for each of the block's items and terms.
    lists = F.broadcast(spark.createDataFrame(items.pairs(), "item int, term int"))
    heads = _limited(postings, "term", [F.desc("v"), F.col("class")], k).select("term", "class", "v")
    partial = heads.join(lists, "term").groupBy("item", "class").agg(F.sum("v").alias("partial"))
    thresholds = _Thresholds(items, _kth(partial, k), k)

    # Phase 2.
    lowest = F.broadcast(spark.createDataFrame(thresholds.lowest(), "term int, least bigint"))
    sent = postings.join(lowest, "term").where("v >= least").select("class", "term", "v")
    told = spark.sparkContext.broadcast(thresholds)
    found = sent.repartition("class").sortWithinPartitions("class").mapInArrow(functools.partial(_candidates, sent=told), "item int, class bigint, partial bigint, upper bigint")
    found = written(found, "candidates")
    bounds = _kth(found, k)
    bound = F.broadcast(spark.createDataFrame([(i, max(int(thresholds.lower[i]), bounds.get(i, 0))) for i in range(len(items.keys))], "item int, bound bigint"))

    # Phase 3.
    wanted = found.join(bound, "item").where("upper >= bound").select("item", "class").join(lists, "item")
    exact = postings.join(wanted, ["term", "class"]).groupBy("item", "class").agg(F.sum("v").alias("score"))
    # Classes that tie with the k-th are kept: the ids of their rows decide.
    best = exact.withColumn("_place", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("_place") <= k).drop("_place")
    best = written(best.join(classes.select("class", "a", "b"), "class").select("item", "class", "a", "b", "score"), "best")
    few = best.select("class", "a", "b").distinct()
    rows = forward.select("doc_id", "a", "b").join(few, ["a", "b"])
    rows = _limited(rows, "class", [F.asc_nulls_last("doc_id")], k).select("class", "doc_id")
    out = written(_limited(best.join(rows, "class"), "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k).select("item", "doc_id", "score", F.col("_place").alias("rank")), "ranked")
    remove(forward, classes, postings, found, best)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the k rows of docs with the highest scores above 0 for each row of items.

    Equal scores are in ascending order of doc_id, null ids last. Null and empty texts, and
    texts without a term, have no score and find nothing. Repeated documents are documents of
    their own; repeated items each have their rows. No rows on either side: no rows. Other
    columns are left out, whatever their names. Items of one block of BLOCK_BYTES take one
    scan of the documents: made for benchmarks of some ten MB.
    """
    spark, out = docs.sparkSession, None
    bounded_batches(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select(F.col("item_id").alias("item_id"), "text").where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("text"))
    texts = asked.groupBy("key").agg(F.min("text").alias("text"))
    blocks = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    for j in range(blocks):
        rows = sorted(tuple(r) for r in texts.where(F.pmod("key", F.lit(blocks)) == j).collect())
        block = _Items([r[0] for r in rows], [r[1] for r in rows])
        found = _block(given, block, k)
        if found is not None:
            keys = F.broadcast(spark.createDataFrame(list(enumerate(block.keys)), "item int, key bigint"))
            found = found.join(keys, "item").select("key", "rank", "doc_id", "score")
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], "key bigint, rank int, doc_id bigint, score bigint")
    return asked.select("key", "item_id").join(out, "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS w, len(w) AS n FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_SQL_TERMS}) AS w FROM benchmark),
it AS (SELECT q, unnest(w) AS t FROM i),
dt AS (SELECT r, n, t, count(*) AS tf FROM (SELECT r, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY ALL),
c AS (SELECT count(*) FILTER (n > 0) AS cn, sum(n)::BIGINT AS cl FROM d),
wt AS (SELECT t, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM dt, c GROUP BY t, cn),
v AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * cn) // cl))) AS v FROM dt JOIN wt USING (t), c),
s AS (SELECT q, r, sum(v)::BIGINT AS score FROM it JOIN v USING (t) GROUP BY q, r HAVING sum(v) > 0),
p AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s JOIN d USING (r))
SELECT item_id, rank, doc_id, score FROM p JOIN i USING (q) WHERE rank <= {BEST}
"""
