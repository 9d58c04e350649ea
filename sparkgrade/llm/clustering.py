"""Centroid clustering of integer vectors by delta Lloyd, exactly.

The vectors are written once, bucketed by a row number; each round writes one row of
assignment a vector (its owner and their distance), bucketed alike, so a round joins both
without a shuffle. A round compares a vector only with the centroids that changed, or with
all if its own owner did: among unchanged centroids an unchanged owner stays nearest. Vectors
that go from one centroid to another add signed transfers to the global sums, beside the
first row of their batch; only those are summed and sent to the driver, a bounded number of
integers. Everything is integer arithmetic, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, remove, shared_path, table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components up to this bound have exact products and sums in doubles; up to LARGEST, in 64-bit integers.
SMALL, LARGEST = 1 << 22, (1 << 27) - 1
_TRANSFERS = pa.list_(pa.struct([("centroid", pa.int32()), ("gains", pa.list_(pa.int64()))]))


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers floor(scale * x)) of the vectors with exactly that many components, none null or non-finite."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    fits = F.coalesce((F.size(v) == dimensions) & F.forall(v, whole), F.lit(False))
    return vectors.where(fits).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _bounded(v: Column) -> Column:
    """v as 32-bit integers; a component beyond LARGEST, whose distances don't fit 64 bits, ends the job with a message."""
    over = F.exists(v, lambda x: F.abs(x) > LARGEST)
    return F.when(over, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("array<int>")).otherwise(v.cast("array<int>"))


class _Bucketed:
    """A table of the shared folder with a row number, bucketed by it; the catalog has it only while rounds run."""

    def __init__(self, df: DataFrame, buckets: int, label: str) -> None:
        self.spark, self.name, self.sparkgrade_path = df.sparkSession, f"sparkgrade_{label}_{uuid.uuid4().hex}", shared_path(df.sparkSession, label)
        self.sparkSession = self.spark
        df.write.bucketBy(buckets, "row").sortBy("row").option("path", self.sparkgrade_path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def release(self, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            remove(self)


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of `seed:vec_id`, in that order; equal hashes by the vector, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in vectors.select("v", h.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact: in doubles where all products and sums are below 2^53."""
    if not len(v) or max(int(np.abs(v).max()), int(np.abs(centroids).max())) <= SMALL:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
    else:
        a, b = v.astype(np.int64), centroids.astype(np.int64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def _nearest(v: np.ndarray, owner: np.ndarray, held: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances now. owner -1: none yet. changed: whether each centroid moved since owner and held were found."""
    owner, held = owner.copy(), held.copy()
    moved = (owner < 0) | changed[owner]
    if moved.any():
        d = _distances(v[moved], centroids)
        owner[moved] = d.argmin(1)
        held[moved] = d.min(1)
    among = np.flatnonzero(changed)
    if len(among) and not moved.all():
        at = np.flatnonzero(~moved)
        d = _distances(v[at], centroids[among])
        best = d.argmin(1)
        low, who = d[np.arange(len(at)), best], among[best]
        nearer = (low < held[at]) | ((low == held[at]) & (who < owner[at]))
        owner[at[nearer]], held[at[nearer]] = who[nearer], low[nearer]
    return owner, held


def _transfers(v: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """What each centroid gains or loses: the number of vectors that came less those that left, then their sums by dimension."""
    out = []
    gone = before != after
    for c in np.unique(np.concatenate([before[gone], after[gone]])):
        if c >= 0:
            came, left = v[gone & (after == c)], v[gone & (before == c)]
            out.append({"centroid": int(c), "gains": [len(came) - len(left), *(came.sum(0, dtype=np.int64) - left.sum(0, dtype=np.int64)).tolist()]})
    return out


def _round(rows: DataFrame, centroids: list[list[int]], changed: list[bool], dimensions: int) -> DataFrame:
    """row, vec_id, owner, held, transfers of rows (row, vec_id, v, owner, held)."""
    now, new = np.array(centroids, np.int64).reshape(-1, dimensions), np.array(changed, bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column("v").flatten()).reshape(-1, dimensions)
            before = np.asarray(batch.column("owner")).astype(np.int64)
            owner, held = _nearest(v, before, np.asarray(batch.column("held")), now, new)
            transfers = [_transfers(v, before, owner)] + [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(owner, pa.int32()), pa.array(held, pa.int64()), pa.array(transfers, _TRANSFERS)], ["row", "vec_id", "owner", "held", "transfers"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("row", "vec_id", "v", "owner", "held").mapInArrow(run, f"row bigint, vec_id {kind}, owner int, held bigint, transfers array<struct<centroid:int,gains:array<bigint>>>")


def _summed(assigned: DataFrame, dimensions: int) -> dict[int, list[int]]:
    """centroid -> its gains over all of the round's transfers: a row for each centroid at most."""
    each = assigned.where("transfers IS NOT NULL").select(F.inline("transfers"))
    return {r[0]: list(r[1:]) for r in each.groupBy("centroid").agg(*(F.sum(F.get("gains", F.lit(i))) for i in range(1 + dimensions))).collect()}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors that are null, of another length, or with a null or non-finite component are left
    out. Repeated ids and vectors are vectors of their own; null ids are kept, and start no
    cluster while others can. Fewer kept vectors than clusters: as many clusters; none: no
    rows. A component beyond LARGEST after scaling raises. Ties go to the smaller number. If
    no centroid changes, the remaining rounds would change nothing and are left out. Other
    columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = kept(vectors, id_col, vector_col, dimensions, scale)
    base = _Bucketed(given.select(F.monotonically_increasing_id().alias("row"), "vec_id", _bounded(F.col("v")).alias("v")).repartition(buckets, "row"), buckets, "vectors")
    rows = base.read()
    centroids = first_centroids(rows, clusters, seed)
    totals = [[0] * (1 + dimensions) for _ in centroids]  # the number of vectors, then their sums
    changed, held = [True] * len(centroids), None
    for k in range(rounds + 1):
        owned = rows.withColumns({"owner": F.lit(-1), "held": F.lit(0).cast("long")}) if held is None else rows.join(held.read().select("row", "owner", "held"), "row")
        after = _Bucketed(_round(owned, centroids, changed, dimensions), buckets, "owners")
        if held is not None:
            held.release()
        held = after
        if k == rounds:
            break
        for c, gains in _summed(held.read(), dimensions).items():
            totals[c] = [a + b for a, b in zip(totals[c], gains, strict=True)]
        moved = [[s // n for s in own] if n else old for (n, *own), old in zip(totals, centroids, strict=True)]
        changed, centroids = [a != b for a, b in zip(moved, centroids, strict=True)], moved
        if not any(changed):
            break
    schema = held.read().schema
    base.release()
    held.release(files=False)
    found = spark.read.schema(schema).parquet(held.sparkgrade_path).select("vec_id", F.col("owner").alias("cluster"), F.col("held").alias("distance"))
    # One row for each cluster, broadcast: their number is a parameter.
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)], "cluster int, centroid_sha256 string")
    per = own.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(found.agg(F.sum("distance").alias("inertia"))))
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Plain Lloyd, a CTE a step: the rounds are written out."""
    steps = [f"c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CLUSTERS}))"]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS o FROM (SELECT r, c, list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept p, c{k} q) GROUP BY r)")
        if k < ROUNDS:
            steps.append(f"m{k} AS (SELECT c, list(f ORDER BY i) AS v FROM (SELECT o.c AS c, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS f FROM a{k} JOIN kept USING (r), range(1, {DIMENSIONS + 1}) g(i) GROUP BY ALL) GROUP BY c)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, p.v)::BIGINT[] AS v FROM c{k} p LEFT JOIN m{k} m USING (c))")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
{", ".join(steps)}
SELECT vec_id, o.c::INT AS cluster, o.d AS distance, sum(o.d) OVER (PARTITION BY o.c)::BIGINT AS cluster_inertia, sum(o.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(q.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} q ON q.c = o.c
"""


OP12_SQL = _sql()
