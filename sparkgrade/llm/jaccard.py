"""N-gram Jaccard join by T-occurrence search with DivideSkip, in clusters of possible partners.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Texts with one set are
   one node, so copies are never compared.
2. Linked sets of about one size differ in a bounded number of shingles. Dealt by a hash to more
   parts than that, they agree in one part that isn't empty: each part is a signature (sizes
   are in bands, and a set is dealt in its own and in the next). Shingles that very many texts
   have are left out, by a sketch of fixed size over all texts; a set with too few others is
   dealt whole as well. So no link is lost, and passages that many texts share gather nobody.
   A pair with a common signature counts if the parities of its shingles' residues, a bit for
   each shingle or so, differ in few enough places: linked sets do. Texts that such pairs
   connect, directly or through others, form a cluster, so texts that share no more than a
   passage aren't gathered through each other. Texts of a signature that many have are held
   against the first of them; those that are in several groups then meet in one task, which
   gives on only what joins two groups, so its rows don't grow with the pairs.
3. In a cluster, each set is a query. An overlap of T shingles is required; the longest lists
   of the cluster's inverted index are set aside, the short ones are merged, and only sets that
   occur often enough there are probed by binary search in the long ones (DivideSkip). Sets
   that are connected already aren't probed again.
4. A cluster of over CLUSTER_SHINGLES or CLUSTER_SETS is never in one task: its sets are held
   against one leader first; those that aren't linked to it are the queries, against all of the
   cluster, in blocks.
5. The links' connected components are the groups.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import slices
from .common import bounded_batches, free_shuffles, remove, return_memory, table, written
from .components import components
from .hashing import mix, shingles, word_hashes

#: Shingle length and similarity (per cent) of op2's contract; elsewhere near-duplicates take 5 and 80.
WORDS, PERCENT = 3, 90
#: Buckets of the frequency sketch: its size is fixed, so it can be broadcast.
SKETCH = 1 << 17
#: Texts above the mean that a bucket of the sketch has for its shingles to be left out, at least.
COMMON = 8
#: Bits of the filter of ids that keeps other texts out of a join: its size is fixed; it only saves work.
FILTER_BITS = 1 << 24
#: Shingles of a cluster that one task holds at most, and how many times as many it asks for at most.
CLUSTER_SHINGLES, QUERY_BLOCK = 1_600_000, 8
#: Sets of a cluster from which it is dealt to blocks, and blocks that their number alone makes at most on a side.
CLUSTER_SETS, CLUSTER_BLOCKS = 400, 8
#: Bytes of texts that are hashed at once.
SLICE_BYTES = 1 << 18
#: Rows of a shuffle, signatures or shingles, that a partition holds about.
PARTITION_ROWS = 8_000_000
#: Nodes of a signature that are paired at once, and nodes of several groups that are paired at most; more are one cluster.
FEW_NODES, MANY_NODES = 8, 512
#: Bytes of the parities of a set that travel with each of its signatures that many nodes of several groups have; pairs of longer sets are made first, and tested after.
HELD_BITS = 512
#: Bytes of parities that are compared at once.
COMPARED = 1 << 22
#: Pairs that a task holds to drop repeated ones.
HELD_PAIRS = 250_000
#: Postings of a list that are merged at once, and long lists that are probed at once.
MERGE_BLOCK, PROBE_BLOCK = 4096, 16
_MU = 0.0085
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    got, bounds = shingles(*word_hashes(texts), words)
    if not len(got):
        return [got] * (len(bounds) - 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    first = np.ones(len(got), bool)
    first[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
    got, owner = got[first], owner[first]
    return np.split(got, np.searchsorted(owner, np.arange(1, len(bounds) - 1)))


def set_keys(own: np.ndarray, seed: int) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    a = mix((own ^ np.uint64(seed * 2 + 1)) * np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    b = mix(own + np.uint64(seed * 2 + 2)).sum(dtype=np.uint64)
    a, b = mix(np.array([a, b]) ^ np.uint64(len(own)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def _scan(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, n, node, check, bits (parities) of every text, and bucket, seen: the sketch of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                own = sets_of(some.column(1), words)
                for s in own:
                    counts += np.bincount(s & np.uint64(SKETCH - 1), minlength=SKETCH) if len(s) > SKETCH else 0
                short = [s for s in own if len(s) <= SKETCH]
                counts += np.bincount((np.concatenate([np.zeros(0, np.uint64), *short]) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                keys = [set_keys(s, seed) if len(s) else (None, None) for s in own]
                none = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": some.column(0), "n": pa.array([len(s) for s in own], pa.int64()), "node": pa.array([k[0] for k in keys], pa.int64()), "check": pa.array([k[1] for k in keys], pa.int64()), "bits": pa.array([parity(s) if len(s) else None for s in own], pa.binary()), "bucket": none, "seen": none})
        full = np.flatnonzero(counts)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "node": none, "check": none, "bits": pa.nulls(len(full), pa.binary()), "bucket": pa.array(full, pa.int64()), "seen": pa.array(counts[full], pa.int64())})

    return docs.mapInArrow(run, "doc_id bigint, n bigint, node bigint, check bigint, bits binary, bucket bigint, seen bigint")


@functools.cache
def bands(percent: int, most: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Lower bounds of size bands up to sets of `most`, and for each the differences of linked sets at most, and the parts.

    Sizes of linked sets are in one band or in neighbouring ones. There are some parts more
    than differences, as a few of them are empty.
    """
    low = [1]
    while low[-1] <= most:
        low.append(low[-1] * 100 // percent + 1)
    low.append(low[-1] * 100 // percent + 1)
    out = []
    for first in low[1:]:
        differ = (100 - percent) * 2 * (first - 1) // (100 + percent)
        each = (percent / 100) ** 2 * (first - 1) / (differ + 1)
        out.append((differ, differ + 1 + math.ceil((differ + 1) * math.exp(-each) * 1.2) + (differ > 0)))
    return np.array(low), out


def _parts(own: np.ndarray, band: int, parts: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the parts that have shingles, and their signatures."""
    salt = np.uint64(3 * band + family + 1)
    moved = np.uint64(int(salt) * int(_SALT) & 0xFFFFFFFFFFFFFFFF)
    part = ((mix(own + moved) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
    sums = np.add.reduceat(mix(own[order] ^ _SALT), first) if len(first) else np.zeros(0, np.uint64)
    return part[first], mix(sums ^ mix(part[first] * np.uint64(1 << 20) + salt))


def signatures(own: np.ndarray, rare: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set; rare: which of its shingles aren't left out. Linked sets share one."""
    low, shape = bands(percent, 1 << (max(len(own), 1 << 16) - 1).bit_length())
    band, out = int(np.searchsorted(low, len(own), "right")) - 1, []
    for k in (band, band + 1):
        differ, parts = shape[k]
        taken, got = _parts(own[rare], k, parts, 0)
        out.append(got)
        if len(taken) <= differ:
            taken, got = _parts(own, k, parts, 1)
            out.append(got)
            if len(taken) <= differ:  # two such sets may agree in empty parts alone
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), taken)
                out.append(mix(mix(empty * np.uint64(1 << 20) + np.uint64(3 * k + 3)) + np.uint64(7)))
    return np.concatenate(out)


def _signed(docs: DataFrame, words: int, percent: int, seed: int, common: np.ndarray) -> DataFrame:
    """signature, node: those of each set, each once in a slice of the input."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = sent.value
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                found, owners = [], []
                for own in sets_of(some.column(1), words):
                    if len(own):
                        found.append(signatures(own, ~left_out[(own & np.uint64(SKETCH - 1)).astype(np.int64)], percent))
                        owners.append(np.full(len(found[-1]), set_keys(own, seed)[0], np.int64))
                if not found:
                    continue
                token, node = _once(np.concatenate(found).view(np.int64), np.concatenate(owners))
                yield pa.RecordBatch.from_pydict({"signature": pa.array(token), "node": pa.array(node)})
        return_memory()

    return docs.mapInArrow(run, "signature bigint, node bigint")


def _partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of a shuffle of so many rows: a range of keys can't be split later, so their number grows with the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / PARTITION_ROWS))


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def parity(own: np.ndarray) -> bytes:
    """How often each residue of a set's shingles occurs, modulo 2: a bit for each of at least as many residues as shingles, a power of two."""
    size = max(64, 1 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """False only for sets that aren't linked: each shingle that one of two sets has alone changes one bit, so the bits differ in no more places than there are such shingles."""
    if percent * max(n_a, n_b) > 100 * min(n_a, n_b):
        return False
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    if len(a) != len(b):
        size = 8 * min(len(a), len(b))
        x, y = _folded(x, 8 * len(a), size), _folded(y, 8 * len(b), size)
    return (100 + percent) * (x ^ y).bit_count() <= (100 - percent) * (n_a + n_b)


def _folded(bits: int, size: int, to: int) -> int:
    """The parities modulo a smaller power of two."""
    while size > to:
        size //= 2
        bits = (bits >> size) ^ (bits & ((1 << size) - 1))
    return bits


class _Pairs:
    """Pairs of one task: repeated ones are dropped while they are few enough to be held."""

    def __init__(self) -> None:
        self.held, self.size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(a):
            return
        self.held.append((a, b))
        self.size += len(a)
        if self.size > 2 * HELD_PAIRS:
            got = _once(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            if len(got[0]) > HELD_PAIRS:
                yield got
                got = got[0][:0], got[1][:0]
            self.held, self.size = [got], len(got[0])

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        return _once(*(np.concatenate(c) for c in zip(*self.held, strict=True)))


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Runs of rows with one signature (the first column), the rows in order: whole ones of at most `most` rows, several at once, and (True, rows) for parts of longer ones, each part with the run's first row before it."""
    held, long = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if long is not None:  # the run goes on
            upto = int(np.searchsorted(rows[0], long[0][0], "right"))
            if upto:
                yield True, [np.concatenate([x, c[:upto]]) for x, c in zip(long, rows, strict=True)]
            if upto == len(rows[0]):
                continue
            long, rows = None, [c[upto:] for c in rows]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(rows[0])]]))
        for k in np.flatnonzero(lengths > most):
            yield True, [c[starts[k] : starts[k] + lengths[k]] for c in rows]
        whole = np.repeat(lengths <= most, lengths)
        whole[starts[-1] :] = False
        if whole.any():
            yield False, [c[whole] for c in rows]
        last = [c[starts[-1] :] for c in rows]
        held, long = (None, [c[:1] for c in last]) if lengths[-1] > most else (last, None)
    if held is not None:
        yield False, held


def _pairs(token: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows with one token."""
    at, step = np.arange(len(token)), 0
    while len(at):
        step += 1
        at = at[: np.searchsorted(at, len(token) - step)]
        at = at[token[at] == token[at + step]]
        yield node[at], node[at + step]


def _candidates(signed: DataFrame, partitions: int) -> DataFrame:
    """signature, a, b: pairs of nodes with a common signature; of signatures that over FEW_NODES nodes have, each node (a) with the first (b), and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray, signature: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"signature": pa.nulls(len(a), pa.int64()) if signature is None else pa.array(signature), "a": pa.array(a), "b": pa.array(b)})

        held, head = _Pairs(), (None, None)
        for long, (token, node) in _groups(batches, FEW_NODES):
            if long:
                fresh = np.concatenate([[head != (token[0], node[0])], node[1:] != node[:-1]])  # copies have one node
                head = token[0], node[0]
                yield rows(node[fresh], np.full(int(fresh.sum()), node[0]), token[fresh])
                continue
            for a, b in _pairs(*_once(token, node)):
                for full in held.add(a, b):
                    yield rows(*full)
        yield rows(*held.rest())

    return signed.repartition(partitions, "signature").sortWithinPartitions("signature", "node").mapInArrow(run, "signature bigint, a bigint, b bigint")


#: What a pair of _across() is: of one cluster untested, tested by its parities, or to be tested.
SURE, TESTED, OPEN = range(3)


class _Joined:
    """The groups of nodes that one task's near pairs have joined: whatever joins nothing new needn't be told."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x

    def near(self, node: np.ndarray, group: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
        """Of the nodes of one signature, pairs that may be linked (may_link) and join two groups."""
        order = np.argsort(n, kind="stable")
        node, n, bits = node[order], n[order], [bits[i] for i in order]
        own = np.array([self.root(g) for g in group[order].tolist()])
        ends = np.searchsorted(n, 100 * n // percent, "right")  # sizes beyond are too far apart
        sizes = np.array([len(b) for b in bits])  # they don't fall, as n doesn't
        words, start = None, 0
        for i in range(len(n) - 1):
            if words is None or sizes[i] != sizes[start]:
                start, upto = i, int(ends[sizes == sizes[i]].max())
                words = np.stack([_cut(b, int(sizes[i])) for b in bits[i:upto]])
            step = max(1, COMPARED // int(sizes[i]))
            for first in range(i + 1, int(ends[i]), step):
                other = first + np.flatnonzero(own[first : min(first + step, int(ends[i]))] != own[i])
                differ = np.bitwise_count(words[other - start] ^ words[i - start]).sum(1, dtype=np.int64)
                for j in other[(100 + percent) * differ <= (100 - percent) * (n[other] + n[i])].tolist():
                    if own[j] != own[i]:
                        self.up[int(own[j])] = int(own[i])
                        own[own == own[j]] = own[i]
                        yield int(node[j]), int(node[i])


def _cut(bits: bytes, size: int) -> np.ndarray:
    """Parities modulo a power of two of at most as many residues, of `size` bytes, as words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, "<u8").reshape(-1, size // 8), axis=0)


def _across(grouped: DataFrame, percent: int, partitions: int) -> DataFrame:
    """a, b, kind: what may join nodes of different groups with a common signature. Of signatures that over MANY_NODES nodes have, each node with the first (SURE); else pairs whose parities are near and that join groups which those of the same task haven't (TESTED), and all pairs with a set whose parities aren't given (OPEN).

    grouped: signature, node, root (the node's group), n, bits (its parities, or null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "kind": pa.array(np.full(len(a), kind, np.int32))})

        held, heads, joined = _Pairs(), _Pairs(), _Joined()
        for long, (token, root, node, n, bits) in _groups(batches, MANY_NODES):
            if long:
                apart = root != root[0]
                for full in heads.add(node[apart], np.full(int(apart.sum()), node[0])):
                    yield rows(*full, SURE)
                continue
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])).tolist()
            out = []
            for x, y in zip(starts, [*starts[1:], len(token)], strict=True):
                short = np.array([b is not None for b in bits[x:y]])
                at = x + np.flatnonzero(short)
                out += joined.near(node[at], root[at], n[at], bits[at].tolist(), percent)
                for k in x + np.flatnonzero(~short):
                    other = np.concatenate([at, np.arange(k + 1, y)[~short[k + 1 - x :]]])
                    other = other[(root[other] != root[k]) & (percent * np.maximum(n[other], n[k]) <= 100 * np.minimum(n[other], n[k]))]
                    for full in held.add(np.maximum(node[other], node[k]), np.minimum(node[other], node[k])):
                        yield rows(*full, OPEN)
            yield rows(*np.array(out, np.int64).reshape(-1, 2).T, TESTED)
        yield rows(*held.rest(), OPEN)
        yield rows(*heads.rest(), SURE)

    dealt = grouped.select("signature", "root", "node", "n", "bits").repartition(partitions, "signature").sortWithinPartitions("signature", "root", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, kind int")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs that may be linked by the parities of their sets (node, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [may_link(*row, percent) for row in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    alike = percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a bigint, b bigint")


def _clusters(signed: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """node, cluster of each set that may be linked with another: components of pairs that share a signature and whose parities are near.

    Nodes of a signature that many have are held against the first of them; those that are in
    one group by then needn't meet, all others do.
    """
    spark = signed.sparkSession
    met = written(_candidates(signed, _partitions(spark, rows)), "candidates")
    free_shuffles(spark)  # the signatures' rows are several times the texts
    near = written(_near(met.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sets, percent), "near")
    many = met.where("signature IS NOT NULL").select("signature", F.col("a").alias("node"))
    if many.isEmpty():
        found = components(near)
        remove(met, near)
        return found
    groups = components(near)
    of_node = written(many.join(groups, "node", "left").select("signature", "node", F.coalesce("root", "node").alias("root")), "grouped")
    remove(groups)
    # Signatures of one group alone join nothing; only the others' rows carry parities.
    mixed = of_node.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("signature")
    told = sets.select("node", "n", F.when(F.length("bits") <= HELD_BITS, F.col("bits")).alias("bits"))
    apart = written(_across(of_node.join(mixed, "signature", "left_semi").join(told, "node"), percent, _partitions(spark, rows)).distinct(), "across")
    more = _near(apart.where(F.col("kind") == OPEN).select("a", "b"), sets, percent)
    found = components(near.unionAll(more).unionAll(apart.where(F.col("kind") != OPEN).select("a", "b")))
    remove(met, near, of_node, apart)
    return found


class Cluster:
    """The inverted index of some sets, and a T-occurrence search in it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes, self.size = np.array([len(s) for s in sets], np.int64), len(sets)
        token = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(token, kind="stable")  # the owners of one shingle stay in order
        self.owners = np.repeat(np.arange(self.size, dtype=np.int32), self.sizes)[order]
        token = token[order]
        del order
        self.tokens, starts = np.unique(token, return_index=True)
        self.starts = np.concatenate([starts, [len(token)]])
        del token
        #: List number * sets + owner, sorted: one binary search probes many lists.
        self.keys = np.repeat(np.arange(len(self.tokens)), np.diff(self.starts)) * self.size + self.owners

    def _merged(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets that the lists hold, and in how many of them each is.

        A heap holds the last set of each list's next block; all lists are read up to the
        smallest of them, and what they hold is counted, so a set's count is whole.
        """
        at, ends = self.starts[lists].copy(), self.starts[lists + 1]
        last = lambda k: int(self.owners[min(at[k] + MERGE_BLOCK, ends[k]) - 1])
        heap = [(last(k), k) for k in range(len(lists))]
        heapq.heapify(heap)
        found, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while heap:
            bound, runs = heap[0][0], []
            for _, k in heap:
                own = self.owners[at[k] : min(at[k] + MERGE_BLOCK, ends[k])]
                runs.append(own if own[-1] <= bound else own[: np.searchsorted(own, bound, "right")])
                at[k] += len(runs[-1])
            sets, counts = np.unique(np.concatenate(runs), return_counts=True)
            found.append(sets)
            times.append(counts)
            if all(at[k] == ends[k] for _, k in heap):
                break
            heap = [(last(k), k) for _, k in heap if at[k] < ends[k]]
            heapq.heapify(heap)
        return np.concatenate(found), np.concatenate(times)

    def search(self, query: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Sets that are linked with the query, most common in the short lists first; skip(set) leaves one out."""
        at = np.minimum(np.searchsorted(self.tokens, query), max(len(self.tokens) - 1, 0))
        lists = at[self.tokens[at] == query] if len(self.tokens) else at[:0]
        t = needed(len(query), percent)
        if len(lists) < t:
            return
        lengths = self.starts[lists + 1] - self.starts[lists]
        order = np.argsort(lengths, kind="stable")
        long = min(t - 1, int(t / (_MU * np.log2(max(2, int(lengths.max()))) + 1)))
        short, aside = lists[order[: len(lists) - long]], lists[order[len(lists) - long :]]
        found, times = self._merged(short)
        # What a partner of its size must share: 100 * overlap >= percent * (sum of sizes - overlap).
        required = -(-percent * (len(query) + self.sizes[found]) // (100 + percent))
        likely = times + long >= required
        found, times, required = found[likely], times[likely], required[likely]
        fresh = np.array([not skip(x) for x in found.tolist()], bool)
        found, times = self._probed(aside, found[fresh], times[fresh], required[fresh])
        for k in np.argsort(-times, kind="stable"):
            yield int(found[k])

    def _probed(self, lists: np.ndarray, sets: np.ndarray, times: np.ndarray, required: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets that reach what is required with the lists' help, and their overlaps: binary search for each set, some lists at once; a set that can't reach it any more goes."""
        for start in range(0, len(lists), PROBE_BLOCK):
            if not len(sets):
                break
            some = lists[start : start + PROBE_BLOCK]
            wanted = (some[None, :] * self.size + sets[:, None]).ravel()
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            times = times + (self.keys[place] == wanted).reshape(len(sets), -1).sum(1)
            alive = times + (len(lists) - start - len(some)) >= required
            sets, times, required = sets[alive], times[alive], required[alive]
        enough = times >= required
        return sets[enough], times[enough]


#: What a row of a block is: in its index, a query against it, or both.
INDEXED, ASKED, BOTH = range(3)


class _Block:
    """A block's index, and the groups that its links have made so far."""

    def __init__(self, held: dict[int, tuple[np.ndarray, int | None]], percent: int) -> None:
        self.nodes, self.percent, self.up = list(held), percent, {}
        self.index = Cluster([own for own, _ in held.values()])
        for node, (_, group) in held.items():
            if group is not None:  # known to be linked with that node
                self.up[self.root(node)] = self.root(group)

    def root(self, x: int) -> int:
        while (above := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(above, above)
        return x

    def links(self, node: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """The node's links that join groups."""
        for k in self.index.search(own, self.percent, lambda k: self.root(self.nodes[k]) == self.root(node)):
            a, b = self.root(self.nodes[k]), self.root(node)
            if a != b:
                self.up[a] = b
                yield node, self.nodes[k]


def _links(members: DataFrame, words: int, percent: int, partitions: int) -> DataFrame:
    """a, b: links in blocks of clusters. members: key columns cluster, qb, ib, and slot, the key's partition, then node, known, role, text.

    A block's index is held; queries against it come after it and are searched one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, {}, None

        def both() -> list[tuple[int, int]]:
            """The links of a block that asks its own index."""
            if block is not None or len(held) < 2 or not asking:
                return []
            own = _Block(held, percent)
            return [x for n in held if n in asking for x in own.links(n, held[n][0])]

        asking: set[int] = set()
        for batch in batches:
            for some in slices(pa.RecordBatch.from_arrays([batch.column(0), batch.column("text"), *(batch.column(n) for n in ("qb", "ib", "node", "known", "role"))], ["cluster", "text", "qb", "ib", "node", "known", "role"]), SLICE_BYTES):
                own, out = sets_of(some.column(1), words), []
                for i, row in enumerate(zip(*(some.column(n).to_pylist() for n in ("cluster", "qb", "ib", "node", "known", "role")), strict=True)):
                    if row[:3] != key:
                        out += both()
                        key, held, block, asking = row[:3], {}, None, set()
                    node, known, role = row[3:]
                    if role == ASKED:
                        if block is None:
                            block, held = _Block(held, percent), {}
                        out += block.links(node, own[i])
                    else:  # copies of a row are one node
                        held[node] = own[i], known
                        if role == BOTH:
                            asking.add(node)
                yield pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})
        out, held, block = both(), {}, None
        yield pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})
        return_memory()

    # Blocks of one cluster have neighbouring slots, so they go to different partitions.
    dealt = members.repartitionById(partitions, "slot").sortWithinPartitions("cluster", "qb", "ib", "role", "node")
    return dealt.select("cluster", "qb", "ib", "node", "known", "role", "text").mapInArrow(run, "a bigint, b bigint")


def _led(members: DataFrame, words: int, percent: int) -> DataFrame:
    """cluster, leader, node, doc_id, n, linked: whether each set of a large cluster is linked with the leader's (leader_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: dict = {}
        for batch in batches:
            for some in slices(pa.RecordBatch.from_arrays([batch.column(0), batch.column("text"), *(batch.column(c) for c in ("leader", "node", "doc_id", "n", "leader_text"))], ["cluster", "text", "leader", "node", "doc_id", "n", "leader_text"]), SLICE_BYTES):
                out = []
                for own, leader in zip(sets_of(some.column(1), words), some.column("leader_text").to_pylist(), strict=True):
                    if leader not in leaders:
                        leaders = {leader: sets_of(pa.array([leader]), words)[0]}
                    its = leaders[leader]
                    overlap = len(np.intersect1d(own, its, assume_unique=True))
                    out.append(100 * overlap >= percent * (len(own) + len(its) - overlap))
                yield pa.RecordBatch.from_pydict({c: some.column(c) for c in ("cluster", "leader", "node", "doc_id", "n")} | {"linked": pa.array(out, pa.bool_())})

    got = members.select("cluster", "leader", "node", "doc_id", "n", "text", "leader_text").mapInArrow(run, "cluster bigint, leader bigint, node bigint, doc_id bigint, n bigint, linked boolean")
    return got.dropDuplicates(["cluster", "node"])


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, most: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, node of every row of docs.

    Words are runs of anything but white space, A-Z as a-z; fewer words than a shingle's are
    one shingle. Null texts and texts without words have no shingle, no node, and their own
    id as component. Rows with one set are one node. component_id is the smallest id that is
    not null among the rows reachable by links. Null ids and repeated rows are kept. No rows:
    no rows. Other columns are left out, whatever their names.
    """
    return _joined(docs, words, percent, most)[0].drop("root")


def _joined(docs: DataFrame, words: int, percent: int, most: int = CLUSTER_SHINGLES) -> tuple[DataFrame, int]:
    """join() with root, the group's least node, and the seed of the nodes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in range(4):  # another seed in the unlikely case that two sets share a hash
        told = written(_scan(given, words, seed), "sets")
        rows = told.where("bucket IS NULL").select("doc_id", "n", "node", "check")
        nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), (F.min("check") != F.max("check")).alias("clash"))
        nodes = written(nodes, "nodes")
        if nodes.where("clash").isEmpty():
            break
        remove(told, nodes)
    counts = np.zeros(SKETCH, np.int64)
    for bucket, seen in told.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen")).collect():
        counts[bucket] = seen
    # A shingle is common if its bucket holds clearly more than the mean; few others are left out by chance.
    common = counts > counts.mean() + 3 * np.sqrt(counts.mean()) + COMMON
    # A set has about half as many signatures as shingles, at most.
    total = nodes.agg(F.sum("n")).first()[0] or 0
    # Rows of one node have one set, so its parities are read from any of them.
    bits = told.where("node IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    sets = written(bits, "parities")
    clusters = _clusters(_signed(given, words, percent, seed, common), sets, percent, total // 2)
    members = written(clusters.select("node", F.col("root").alias("cluster")).join(nodes.select("node", "doc_id", "n"), "node"), "members")
    remove(clusters, sets)
    links, used = _all_links(given, members, words, percent, seed, most)
    groups = components(links)
    remove(members, *used)
    found = nodes.select("node", "doc_id").join(groups, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = found.join(smallest, "root").select("node", "component_id", "root")
    return rows.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "root"), seed


def _all_links(given: DataFrame, members: DataFrame, words: int, percent: int, seed: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """a, b: links that span every group; and the tables that they are read from."""
    spark = given.sparkSession
    none = F.lit(None).cast("long")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"), F.min("node").alias("leader"))
    texts = _wanted(given, members, words, seed)
    # The node finds the text; its row with the node's id is taken, so that copies stay behind.
    with_text = lambda m: m.join(texts, (F.col("node") == F.col("of_node")) & F.col("doc_id").eqNullSafe(F.col("id"))).drop("id", "of_node")
    partitions = _partitions(spark, members.agg(F.sum("n")).first()[0] or 0)
    large = written(sizes.where((F.col("total") > most) | (F.col("sets") > CLUSTER_SETS)), "large")
    if large.isEmpty():
        small = members
    else:
        small = members.join(large, "cluster", "left_anti")
    first_slot = F.pmod(F.xxhash64("cluster"), F.lit(1 << 30)).cast("int")
    block = small.select("cluster", F.lit(0).alias("qb"), F.lit(0).alias("ib"), first_slot.alias("slot"), "node", none.alias("known"), F.lit(BOTH).alias("role"), "doc_id")
    links = _links(with_text(block), words, percent, partitions)
    if large.isEmpty():
        return links, [large]
    held = members.join(large, "cluster")
    leaders = with_text(held.where("node = leader")).select("leader", F.col("text").alias("leader_text")).dropDuplicates(["leader"])
    # Large clusters are few, so a leader's row meets its sets by broadcast or is split as a skewed key.
    led = written(_led(with_text(held).join(leaders, "leader"), words, percent), "led")
    asked = led.where("NOT linked").groupBy("cluster").agg(F.sum("n").alias("asked"), F.count(F.lit(1)).alias("asking"))
    blocks_of = lambda shingles, sets: F.greatest(F.ceil(F.col(shingles) / most), F.least(F.lit(CLUSTER_BLOCKS), F.ceil(F.col(sets) / CLUSTER_SETS))).cast("int")
    # Queries aren't held, so more of them go to a block: an index is dealt once for each block of queries.
    nq = F.greatest(F.ceil(F.col("asked") / (QUERY_BLOCK * most)), F.lit(1)).cast("int")
    shape = written(large.join(asked, "cluster").select("cluster", nq.alias("nq"), blocks_of("total", "sets").alias("ni")), "shape")
    every = led.join(shape, "cluster")
    known = F.when(F.col("linked"), F.col("leader"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = every.select("cluster", "ni", "nq", "node", known.alias("known"), F.lit(INDEXED).alias("role"), "doc_id").withColumn("ib", own("ni")).withColumn("qb", upto("nq"))
    queries = every.where("NOT linked").select("cluster", "ni", "nq", "node", none.alias("known"), F.lit(ASKED).alias("role"), "doc_id").withColumn("qb", own("nq")).withColumn("ib", upto("ni"))
    columns = ("cluster", "qb", "ib", (first_slot + F.col("qb") * F.col("ni") + F.col("ib")).alias("slot"), "node", "known", "role", "doc_id")
    blocks = index.select(*columns).unionAll(queries.select(*columns))
    starred = led.where("linked AND node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    found = links.unionAll(starred)
    if not shape.isEmpty():
        found = found.unionAll(_links(with_text(blocks), words, percent, partitions))
    return found, [large, led, shape]


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _wanted(given: DataFrame, members: DataFrame, words: int, seed: int) -> DataFrame:
    """id, of_node, text of the rows of given whose id a member has, without most others, so that their texts needn't be shuffled.

    The filter is a bit table of fixed size, combined from those of tasks by the words that
    aren't zero; where it fills up, more rows stay, and the join still decides. Of rows of one
    slice that are one node with one id, one stays.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(np.array(batch.column(0).fill_null(0)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(slot >> 6), "bits": pa.array(np.left_shift(np.int64(1), slot & 63))})

    table = np.zeros(FILTER_BITS >> 6, np.int64)
    for word, value in members.select("doc_id").mapInArrow(bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits")).toLocalIterator():
        table[word] = value
    sent = given.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(np.array(batch.column(0).fill_null(0)))
            for some in slices(batch.filter(pa.array((sent.value[slot >> 6] >> (slot & 63)) & 1 == 1)), SLICE_BYTES):
                nodes = [set_keys(s, seed)[0] if len(s) else None for s in sets_of(some.column(1), words)]
                seen: set = set()
                fresh = [n is not None and not ((n, i) in seen or seen.add((n, i))) for n, i in zip(nodes, some.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(nodes, pa.int64()), some.column(1)], ["id", "of_node", "text"]).filter(pa.array(fresh, pa.bool_()))

    return given.mapInArrow(run, "id bigint, of_node bigint, text string")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all their columns, with one row of each group: one with the group's smallest id.

    Rows without words are no copies of each other and all stay.
    """
    groups, seed = _joined(docs, words, percent)
    found = written(groups, "groups").where("node IS NOT NULL")
    # Rows of one id that has several, or none, can't be told apart by id alone.
    many = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").select("doc_id"), "many")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    if many.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    own, kept = docs.columns, _fresh(docs.columns, "many_id")
    in_many = many.withColumnRenamed("doc_id", kept)
    simple = docs.join(in_many, docs["doc_id"].eqNullSafe(F.col(kept)), "left_anti").join(gone.join(many, "doc_id", "left_anti"), "doc_id", "left_anti").select(*own)
    odd = docs.join(in_many, docs["doc_id"].eqNullSafe(F.col(kept)), "left_semi")
    return simple.unionByName(_odd_rows(odd, found, words, seed))


def _fresh(columns: list[str], name: str) -> str:
    """A column name that isn't among the given ones, whatever their case."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _odd_rows(odd: DataFrame, found: DataFrame, words: int, seed: int) -> DataFrame:
    """Of rows whose ids are null or repeated: those without words, and one of each group whose smallest id is theirs or that has no id. seed: that of found's nodes."""
    own, schema = odd.columns, odd.schema
    at, keyed_by = own.index("text"), _fresh(own, "group_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_keys(s, seed)[0] if len(s) else None for s in sets_of(batch.column(at), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*own, keyed_by])

    # The row travels as one column, so its names clash with none.
    keyed = odd.mapInArrow(run, StructType([*schema.fields, StructField(keyed_by, LongType())])).select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(keyed_by).alias("node"))
    of_node = found.groupBy("node").agg(F.min("component_id").alias("component"), F.min("root").alias("root"))
    joined = keyed.join(of_node, "node", "left")
    # Groups are told apart by their roots: with repeated ids, two can have one smallest id.
    first = joined.where("node IS NOT NULL AND row.doc_id <=> component")
    one = first.groupBy("root").agg(F.min_by("row", "node").alias("row"))
    rows = joined.where("node IS NULL").select("row").unionByName(one.select("row"))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in own))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, which small tables allow; the smallest id is reached along the links.
OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w, len(w) AS n FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN n >= {WORDS} THEN list_transform(range(1, n - {WORDS - 2}), lambda k: array_to_string(w[k:k + {WORDS - 1}], ' ')) WHEN n > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
sets AS (SELECT r, count(*) AS n_shingles, bit_xor(hash(s)) AS x, sum(hash(s)::HUGEINT) AS y FROM s GROUP BY r),
nodes AS (SELECT n_shingles, x, y, min(r) AS node FROM sets GROUP BY ALL),
of_row AS (SELECT r, node, n_shingles FROM sets JOIN nodes USING (n_shingles, x, y)),
ns AS (SELECT node, n_shingles, s FROM s JOIN of_row ON s.r = of_row.node WHERE of_row.r = of_row.node),
links AS (SELECT a.node AS a, b.node AS b FROM ns a JOIN ns b ON a.s = b.s AND a.node <> b.node AND 100 * b.n_shingles >= {PERCENT} * a.n_shingles AND 100 * a.n_shingles >= {PERCENT} * b.n_shingles
  GROUP BY a.node, b.node, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= {PERCENT} * (a.n_shingles + b.n_shingles - count(*))),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS node, min(doc_id) AS component_id FROM reach JOIN of_row ON reach.b = of_row.node JOIN d ON d.r = of_row.r GROUP BY a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, CASE WHEN n_shingles IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN of_row USING (r) LEFT JOIN least USING (node)
"""
