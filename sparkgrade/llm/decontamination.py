"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by their number of five-word shingles. For each partition, windows
slide over the shingles of a document, a little wider than the partition's largest item, so
that an item within a document of any length fills a fixed part of some window. Windows and
items that agree in any of PERMUTATIONS minima are candidates: an item at the containment
threshold has a Jaccard similarity to its window of 0.38 at least, and is missed with a
probability under 1e-5 (whole items, 1e-7). The exact share of the item's distinct shingles
in the whole document decides. An item of under five words is one shingle of that many words
and is looked up as such, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded_batches, table
from .hashing import shingles, word_hashes

WORDS = 5
CONTAINMENT = 0.8
PERMUTATIONS = 24
#: Bytes of item texts that one index holds; more items are searched in blocks, one after another.
INDEX_BYTES = 8 << 20
#: Bytes of texts that are searched at once.
SLICE_BYTES = 1 << 20
_TABLE_BITS = 16
_RATIO = 1.5


def _permuted(hashes: np.ndarray, k: int) -> np.ndarray:
    a = np.uint32((0x9E3779B1 * (2 * k + 1)) & 0xFFFFFFFF | 1)
    b = np.uint32((0x85EBCA6B * (k + 1)) & 0xFFFFFFFF)
    x = (hashes ^ b) * a
    return x ^ (x >> np.uint32(15))


class ItemIndex:
    """The items of one block: their distinct shingles, and their minima by size partition and permutation; short items by their words."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        words, starts = word_hashes(pa.array(texts, pa.string()), alnum=True)
        got, bounds = shingles(words, starts, WORDS)
        size = np.diff(starts)
        self.items = [(ids[i], np.unique(got[bounds[i] : bounds[i + 1]])) for i in np.flatnonzero(size >= WORDS)]
        #: For each number of words under WORDS: the sorted shingles of such items, and their ids.
        self.short = {}
        for k in range(1, WORDS):
            if len(some := np.flatnonzero(size == k)):
                own, at = shingles(words, starts, k)
                order = np.argsort(own[at[some]], kind="stable")
                self.short[k] = own[at[some]][order], some[order], ids
        by_class: dict[int, list[int]] = {}
        for n, (_, own) in enumerate(self.items):
            by_class.setdefault(int(math.log(len(own)) / math.log(_RATIO)), []).append(n)
        #: For each partition: the step of its windows, and for each permutation its minima, their items and a bit table.
        self.classes = []
        for c, members in sorted(by_class.items()):
            largest = max(len(self.items[n][1]) for n in members)
            tables = []
            for k in range(PERMUTATIONS):
                minima = np.array([_permuted((self.items[n][1] >> np.uint64(32)).astype(np.uint32), k).min() for n in members], np.uint32)
                order = np.argsort(minima, kind="stable")
                bits = np.zeros(1 << _TABLE_BITS, bool)
                bits[minima & np.uint32((1 << _TABLE_BITS) - 1)] = True
                tables.append((minima[order], np.array(members)[order], bits))
            self.classes.append((max(1, -(-largest // 4)), tables))

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window shares a minimum. Windows may reach into the next text: that adds pairs only."""
        found: set[tuple[int, int]] = set()
        if not len(hashes) or not self.classes:
            return found
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        pads = {step: -len(short) % step for step, _ in self.classes}
        for k in range(PERMUTATIONS):
            mixed = _permuted(short, k)
            for step, tables in self.classes:
                blocks = np.concatenate([mixed, np.full(pads[step], 0xFFFFFFFF, np.uint32)]) if pads[step] else mixed
                blocks = blocks.reshape(-1, step)
                low = blocks[:, 0].copy()
                for j in range(1, step):
                    np.minimum(low, blocks[:, j], out=low)
                wide = low.copy()
                for j in range(1, 5):  # a window is five steps: the largest item, and one more
                    np.minimum(wide[:-j], low[j:], out=wide[:-j]) if j < len(low) else None
                minima, members, bits = tables[k]
                for w in np.flatnonzero(bits[wide & np.uint32((1 << _TABLE_BITS) - 1)]):
                    a, b = np.searchsorted(minima, wide[w], "left"), np.searchsorted(minima, wide[w], "right")
                    if a < b:
                        first, last = np.searchsorted(bounds, [w * step, min((w + 5) * step, len(hashes)) - 1], "right") - 1
                        found.update((t, int(n)) for t in range(first, last + 1) for n in members[a:b])
        return found

    def _short(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, object, int, int]]:
        """The pairs of items of under WORDS words: a text has their words in a row."""
        out = []
        for k, (wanted, members, ids) in self.short.items():
            own, at = shingles(words, starts, k)
            first, last = np.searchsorted(wanted, own, "left"), np.searchsorted(wanted, own, "right")
            hits = np.flatnonzero(last > first)
            texts = np.searchsorted(at, hits, "right") - 1
            found = {(int(t), int(m)) for t, h in zip(texts, hits, strict=True) if starts[t + 1] - starts[t] >= k for m in members[first[h] : last[h]]}
            out += [(t, ids[m], 1, 1) for t, m in sorted(found)]
        return out

    def search(self, texts: pa.Array) -> list[tuple[int, object, int, int]]:
        """(text, item id, shingles of the item, those in the text) of the pairs at the threshold."""
        words, starts = word_hashes(texts, alnum=True)
        hashes, bounds = shingles(words, starts, WORDS)
        out = self._short(words, starts)
        by_text: dict[int, list[int]] = {}
        for t, n in self.candidates(hashes, bounds):
            by_text.setdefault(t, []).append(n)
        for t, members in sorted(by_text.items()):
            own = np.unique(hashes[bounds[t] : bounds[t + 1]])
            for n in sorted(members):
                item, wanted = self.items[n]
                at = np.minimum(np.searchsorted(own, wanted), max(len(own) - 1, 0))
                shared = int((own[at] == wanted).sum()) if len(own) else 0
                if 100 * shared >= round(100 * CONTAINMENT) * len(wanted):
                    out.append((t, item, len(wanted), shared))
        return out


def _keyed(benchmark: DataFrame) -> DataFrame:
    """item_id, text, key of the items that have a text; items of one text have one key."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("text"))


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The different texts of the items in blocks of about INDEX_BYTES."""
    texts = items.groupBy("key").agg(F.min("text").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / INDEX_BYTES))
    return [texts.where(F.pmod("key", F.lit(n)) == k) if n > 1 else texts for k in range(n)]


def _index(spark: SparkSession, block: DataFrame):
    rows = sorted(tuple(r) for r in block.collect())
    return spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every pair in which the document has 0.8 or more of the item's distinct shingles.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z as a-z; an
    item of under five words is one shingle of those words in a row. Each text of an item is
    searched once, and its pairs are joined to all the items that have it.
    Null and empty texts on either side are in no pair. Repeated documents and items each
    have their pairs. Other columns are left out, whatever their names.
    """
    spark, out, items = docs.sparkSession, None, _keyed(benchmark)
    bounded_batches(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(items):
        index = _index(spark, block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, SLICE_BYTES):
                    ids, rows = some.column(0).to_pylist(), index.value.search(some.column(1))
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.int64())}
                        | {name: pa.array([r[k] for r in rows], pa.int64()) for name, k in (("n_item", 2), ("n_shared", 3))}
                    )

        pairs = given.mapInArrow(run, "doc_id bigint, key bigint, n_item bigint, n_shared bigint")
        out = pairs if out is None else out.unionAll(pairs)
    return out.join(items.select("key", "item_id"), "key").select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all their columns, without the rows that contain an item."""
    at, schema = docs.columns.index("text"), docs.schema
    bounded_batches(docs.sparkSession)
    for block in _blocks(_keyed(benchmark)):
        index = _index(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                start, keep = 0, np.ones(batch.num_rows, bool)
                for some in slices(pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["a", "b"]), SLICE_BYTES):
                    keep[[start + r[0] for r in index.value.search(some.column(1))]] = False
                    start += some.num_rows
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_SQL_SETS = f"SELECT DISTINCT {{key}}, n, unnest(list_transform(range(1, n - {WORDS - 2}), lambda k: array_to_string(w[k:k + {WORDS - 1}], ' '))) AS s FROM {{table}} WHERE n >= {WORDS}"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w, len(w) AS n FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_SQL_WORDS} AS w, len(w) AS n FROM benchmark),
ds AS ({_SQL_SETS.format(key="r", table="d")}),
its AS ({_SQL_SETS.format(key="q", table="i")}),
sizes AS (SELECT q, count(*) AS n_item FROM its GROUP BY q),
shared AS (SELECT r, q, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY r, q),
pairs AS (
  SELECT r, q, n_item, n_shared FROM shared JOIN sizes USING (q) WHERE 100 * n_shared >= {round(100 * CONTAINMENT)} * n_item
  UNION ALL
  SELECT r, q, 1, 1 FROM d JOIN i ON i.n BETWEEN 1 AND {WORDS - 1} AND d.n >= i.n
    AND list_contains(list_transform(range(1, d.n - i.n + 2), lambda k: array_to_string(d.w[k:k + i.n - 1], ' ')), array_to_string(i.w, ' ')))
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM pairs JOIN d USING (r) JOIN i USING (q)
"""
