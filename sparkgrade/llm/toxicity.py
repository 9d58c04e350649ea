"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary text, are fitted to a
bounded sample of labelled rows. A bigram's count is the number of a class's texts that have
it; the lower order counts distinct left contexts (continuation counts), and ends in one
distribution that both classes share: the distinct left contexts of both together. Counts are
discounted by the absolute discount; of the rest a class keeps the more, the more the
expression is its own, and what neither keeps goes to the shared counts, so that an
expression that is rare or common to both says little. A text's evidence is the difference of
its two log-likelihoods over its length; a logistic curve, fitted to labelled rows that the
models haven't seen, makes it a score from 0 to 1. Neither labels nor lang, source or doc_id
are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .calibration import calibrated
from .common import bounded_batches, return_memory, table
from .hashing import word_hashes

#: Bounds of the training sample: labelled rows of each class, and bytes of their texts; a longer text than a 64th isn't in it.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 24 << 20
#: Share of the sample that calibrates; the rest fits the models.
CALIBRATE = 0.3
#: Absolute discount of Kneser-Ney smoothing.
DISCOUNT = 0.75
#: Powers of a class's share that shrink its counts, of which the calibration rows choose one.
POWERS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
#: Words that are added to a text's length.
PRIOR_WORDS = 8.0
FOLDS = 5
#: Bytes of texts that are scored at once, and texts that the fit reads at once.
SLICE_BYTES = 1 << 18
FIT_TEXTS = 64


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased runs of letters and digits, and where each text's begin (one more at the end); null and empty texts have none."""
    return word_hashes(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " "))


class Vocabulary:
    """Numbers of words, by their hashes. Words that no fitted text has share number 0; the last number stands before a text's first word."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [np.unique(words_of(pa.array(texts[start : start + FIT_TEXTS], pa.string()))[0]) for start in range(0, len(texts), FIT_TEXTS)]
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
        self.size = len(self.hashes) + 2

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The keys (head * size + tail) of all pairs of neighbouring words, and where each text's begin (one more at the end)."""
        words, bounds = words_of(texts)
        at = np.minimum(np.searchsorted(self.hashes, words), max(0, len(self.hashes) - 1))
        codes = np.where(self.hashes[at] == words, at + 1, 0) if len(self.hashes) else np.zeros(len(words), np.int64)
        heads = np.concatenate([[self.size - 1], codes[:-1]]) if len(codes) else codes
        heads[bounds[:-1][bounds[:-1] < bounds[1:]]] = self.size - 1
        return heads * self.size + codes, bounds


def _share(own: np.ndarray, its: np.ndarray, totals: tuple[float, float], power: float) -> np.ndarray:
    """How much a count is a class's own: the excess of its rate over the other's, one count added to each, as a power."""
    kind = own.dtype.type
    a, b = own * kind(1 / totals[0]), its * kind(1 / totals[1])
    out = np.maximum(a - b, kind(0))
    out /= a + b + kind(1 / totals[0] + 1 / totals[1])
    return out ** kind(power)


class KneserNey:
    """The models of both classes over one numbered vocabulary. keys: pairs; counts: for each class, texts with the pair; texts: their numbers."""

    def __init__(self, size: int, keys: np.ndarray, counts: tuple[np.ndarray, np.ndarray], texts: tuple[int, int], power: float) -> None:
        self.size, self.keys = size, keys
        heads, tails = (keys // size).astype(np.int32), (keys % size).astype(np.int32)
        by = lambda of, w: np.bincount(of, weights=w, minlength=size)
        # Lower order: distinct left contexts of a word, in each class and in both together. A word never seen has one.
        contexts = [np.bincount(tails[c > 0], minlength=size).astype(float) for c in counts]
        shared = np.bincount(tails, minlength=size).astype(float)
        shared[0] += 1
        self.shared = shared / shared.sum()
        seen = tuple(max(1.0, c.sum()) for c in contexts)
        own = lambda c, totals, k: np.maximum(c[k] - c[k].dtype.type(DISCOUNT), c[k].dtype.type(0)) * _share(c[k], c[1 - k], (totals[k], totals[1 - k]), power)
        high, low = [own(counts, texts, k) for k in (0, 1)], [own(contexts, seen, k) for k in (0, 1)]
        # What neither class keeps backs off, by the same weight in both.
        back = 1 - by(heads, high[0] + high[1]) / np.maximum(1, by(heads, counts[0] + counts[1]))
        low_back = 1 - (low[0].sum() + low[1].sum()) / (seen[0] + seen[1])
        self.high, self.back, self.low = [], [], []
        for h, one in zip(high, low, strict=True):
            held = by(heads, h)
            share = (1 - back) / np.where(held > 0, held, 1.0)
            self.high.append(h * share.astype(np.float32)[heads])
            self.back.append(np.where(held > 0, back, 1.0))
            self.low.append((1 - low_back) * one / one.sum() + low_back * self.shared if one.any() else self.shared)

    def gain(self, pairs: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio (second class over first) of each pair."""
        heads, tails = pairs // self.size, pairs % self.size
        at = np.minimum(np.searchsorted(self.keys, pairs), max(0, len(self.keys) - 1))
        hit = self.keys[at] == pairs if len(self.keys) else np.zeros(len(pairs), bool)
        p = [np.where(hit, self.high[k][at], 0.0) if len(self.keys) else 0.0 for k in (0, 1)]
        return np.log(p[1] + self.back[1][heads] * self.low[1][tails]) - np.log(p[0] + self.back[0][heads] * self.low[0][tails])


class ToxicityModel:
    """Fitted to texts and marks (1: toxic); evidence() and score() take texts alone. Without texts of both classes no text is called toxic."""

    def __init__(self, texts: list[str | None], toxic: list[int]) -> None:
        marks: dict[str | None, int] = {}
        for text, mark in zip(texts, toxic, strict=True):  # copies count once, as toxic if any is
            marks[text] = max(mark, marks.get(text, 0))
        of = [[t for t, m in marks.items() if m == k] for k in (0, 1)]
        held = [own[: int(CALIBRATE * len(own))] for own in of]
        fitted = [own[int(CALIBRATE * len(own)) :] for own in of]
        self.vocabulary = Vocabulary(fitted[0] + fitted[1])
        found = [self._counts(own) for own in fitted]
        keys = np.union1d(found[0][0], found[1][0])
        counts = []
        for own, n in found:
            counts.append(np.zeros(len(keys), np.float32))
            counts[-1][np.searchsorted(keys, own)] = n
        judged, truth = pa.array(held[0] + held[1], pa.string()), np.repeat([False, True], [len(h) for h in held])
        best = None
        for power in POWERS:
            self.models = KneserNey(self.vocabulary.size, keys, tuple(counts), tuple(max(1, len(f)) for f in fitted), power)
            told = [self.evidence(judged.slice(start, FIT_TEXTS)) for start in range(0, len(judged), FIT_TEXTS)]
            loss, slope, shift = calibrated(np.concatenate([np.zeros(0), *told]), truth)
            if best is None or loss < best[0]:
                best = loss, slope, shift, power, self.models
        _, self.slope, self.shift, self.power, self.models = best

    def _counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, and how many of the texts have each."""
        parts = []
        for start in range(0, len(texts), FIT_TEXTS):
            keys, bounds = self.vocabulary.pairs(pa.array(texts[start : start + FIT_TEXTS], pa.string()))
            parts += [np.unique(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        keys, bounds = self.vocabulary.pairs(texts)
        distinct, where = np.unique(keys, return_inverse=True)
        sums = np.diff(np.concatenate([[0.0], np.cumsum(self.models.gain(distinct)[where])])[bounds])
        return sums / (np.diff(bounds) + PRIOR_WORDS)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.shift, -500, 500)))


def held_out(id_col) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text leaves no remainder. A null id is as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fits to at most `rows` labelled documents of each class, in the order of a hash of id and text, and `size` bytes of text.

    Null labels and held-out ids are left out; an id with more than one label counts as toxic
    if any says so. Labels without documents don't count. Without labelled documents of both
    classes no text is called toxic.
    """
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("doc_id", "text"))
    # The join carries no texts; of each class a bounded top list is taken.
    known = given.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).where(F.col("n") <= size // 64).join(told, "doc_id")
    tops = [known.where(F.col("toxic") == mark).select("h", "n").distinct().orderBy("h").limit(rows).select(F.lit(mark).alias("toxic"), "h", "n") for mark in (1, 0)]
    got = tops[0].unionAll(tops[1]).collect()
    kept = []
    for mark in (1, 0):
        used = 0
        for _, h, n in sorted(r for r in got if r[0] == mark):
            used += n
            if used <= size // 2:
                kept.append((h, mark))
    if not kept:
        return ToxicityModel([], [])
    few = F.broadcast(docs.sparkSession.createDataFrame(kept, "h bigint, toxic int").groupBy("h").agg(F.max("toxic").alias("toxic")))
    found = {(r[0], r[1], r[2]) for r in given.join(few, "h").select("h", "text", "toxic").toLocalIterator()}
    some = sorted(found, key=lambda r: (r[0], r[1] or ""))
    return ToxicityModel([r[1] for r in some], [r[2] for r in some])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts score by the calibration alone. Repeated rows are kept; null ids are
    held out. No rows: no rows. Other columns are left out, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                yield pa.RecordBatch.from_pydict({"doc_id": some.column(0), "held_out": some.column(2), "score": pa.array(sent.value.score(some.column(1)), pa.float64())})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), held_out(F.col("doc_id")).alias("held_out"))
    return given.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def reject(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs, with all their columns, without the rows that score 0.5 or more."""
    bounded_batches(docs.sparkSession)
    sent, at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([sent.value.score(s.column(1)) for s in slices(pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["a", "b"]), SLICE_BYTES)])
                yield batch.filter(pa.array(scores < 0.5))
        return_memory()

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
