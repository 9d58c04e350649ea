"""Queries that write a log, follow it as a stream over a restart, and read what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import work_folder
from ..streaming import buffers

QUERIES: dict[str, object] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def followed(spark: SparkSession, log: DataFrame, at: str, low: int, high: int, slices: int, closing: DataFrame, follow) -> DataFrame:
    """What follow(stream of the log) gives: the log is written in slices of `at` (from low to high), some before the stream's first run, the rest and the closing rows before its second, which goes on from the first one's checkpoint."""
    folder, out = work_folder(spark, "log"), work_folder(spark, "followed")
    bounds = [low + (high + 1 - low) * k // slices for k in range(slices + 1)]

    def run() -> None:
        with buffers.state_store(spark):
            stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 64).parquet(folder)
            follow(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()

    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        log.where((F.col(at) >= a) & (F.col(at) < b)).write.mode("append").parquet(folder)
        if k == slices // 2:
            run()
    closing.write.mode("append").parquet(folder)
    run()
    return spark.read.parquet(out)


_STATUS = "CASE WHEN event_id % 13 = 12 THEN 'sampled' WHEN event_id % 20 = 19 THEN 'failure' WHEN event_id % 10 >= 2 THEN 'finished' ELSE 'running' END"


@query(
    f"""WITH b AS (SELECT user_id::VARCHAR AS uid, event_id AS seq, event_id % 4 AS session, event_id // 100 AS step, {_STATUS} AS status, floor(value / 50) AS v FROM events),
    e AS (SELECT uid, seq, session, step, status, CASE WHEN status = 'finished' THEN v END AS m FROM b),
    s AS (SELECT *, {", ".join(f"last_value(CASE WHEN session = {k} AND status <> 'sampled' THEN {{'st': status, 'm': m}} END IGNORE NULLS) OVER w AS s{k}" for k in range(4))}, min(step) OVER (PARTITION BY uid) AS born FROM e WINDOW w AS (PARTITION BY uid ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, {" + ".join(f"(coalesce(s{k}.st, '') IN ('finished', 'failure'))::INT" for k in range(4))} AS ended, {" OR ".join(f"coalesce(s{k}.st, '') = 'failure'" for k in range(4))} AS failed, least({", ".join(f"s{k}.m" for k in range(4))}) AS lo, greatest({", ".join(f"s{k}.m" for k in range(4))}) AS hi FROM s),
    first_end AS (SELECT uid, min(seq) AS seq FROM f WHERE ended >= 3 AND status <> 'sampled' GROUP BY uid),
    taken AS (SELECT uid, min(seq) AS seq, min(step) AS step FROM e WHERE status = 'sampled' GROUP BY uid),
    ends AS (SELECT f.uid, f.seq, f.step, f.born, CASE WHEN f.step - born + 1 > 12 THEN 'stale' WHEN failed THEN 'failed' WHEN lo = hi THEN 'constant' ELSE 'ready' END AS what FROM f JOIN first_end USING (uid, seq) LEFT JOIN taken t ON t.uid = f.uid WHERE t.seq IS NULL OR f.seq < t.seq),
    u AS (SELECT DISTINCT uid, born FROM s)
    SELECT uid, step, what, CASE what WHEN 'ready' THEN 0 WHEN 'constant' THEN 2 ELSE 1 END AS refill FROM ends
    UNION ALL SELECT n.uid, n.born + 12, 'stale', 1 FROM ends n LEFT JOIN taken t USING (uid) WHERE n.what = 'ready' AND n.born + 12 <= (SELECT max(step) FROM e) AND (t.step IS NULL OR t.step >= n.born + 12)
    UNION ALL SELECT t.uid, t.step, 'sampled', 0 FROM taken t JOIN u USING (uid) LEFT JOIN ends n USING (uid) WHERE n.uid IS NULL OR (n.what = 'ready' AND t.step < n.born + 12)"""
)
def buffered_stream(spark, d):
    """What becomes of every group of the event log: a user is a group of up to four trajectories, of which three must end."""
    e = F.col("event_id")
    status = F.expr(_STATUS)
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("uid"), (e % 4).cast("int").alias("session"), F.lit(0).alias("idx"), status.alias("status"), F.floor(e / 100).alias("global_step"), F.when(status == "finished", F.floor(F.col("value") / 50).cast("double")).alias("metric"), e.alias("seq"))
    ends = log.agg(F.min("global_step"), F.max("global_step")).first()
    low, high = ends[0] or 0, ends[1] or 0
    late = (high - low) // 4 + 2  # files of a slice come in any order
    closing = spark.createDataFrame([("", 0, 0, "pending", high + late, None, -1)], log.schema)
    return followed(spark, log, "global_step", low, high, 4, closing, lambda s: buffers.buffered_groups(s, 3, 12, late, keep=high + 2 * late))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) // 1000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 1000, event_id) AS k FROM events),
    f AS (SELECT *, 1 AS n, sec AS first, 0::BIGINT AS batch FROM e WHERE k = 1 UNION ALL
      SELECT e.*, CASE WHEN f.n >= 4 OR e.sec - f.first >= 7200 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 4 OR e.sec - f.first >= 7200 THEN e.sec ELSE f.first END, CASE WHEN f.n >= 4 OR e.sec - f.first >= 7200 THEN f.batch + 1 ELSE f.batch END FROM e JOIN f ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, event_id, batch, CASE WHEN count(*) OVER (PARTITION BY user_id, batch) = 4 THEN 'full' ELSE 'waited' END AS why FROM f"""
)
def served_stream(spark, d):
    """Every user's events as requests of a queue, at their own times: a batch leaves with four, or two hours after its first."""
    log = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.unix_timestamp("ts").alias("second"))
    ends = log.agg(F.min("second"), F.max("second")).first()
    low, high = ends[0] or 0, ends[1] or 0
    late = (high - low) // 4 + 2
    closing = spark.createDataFrame([(-1, -1, high + late + 7200)], log.schema)
    return followed(spark, log, "second", low, high, 4, closing, lambda s: buffers.timed_batches(s.withColumn("at", F.timestamp_seconds("second")), "user_id", "event_id", 4, 7200.0, "at", f"{late} seconds"))
