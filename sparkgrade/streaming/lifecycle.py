"""Life-cycles of prompt groups: as a fold over an event log, and as state on a stream.

Events: uid, session, idx, status (pending, running, finished, failure), global_step, metric, seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import stale

ENDED = ("finished", "failure")


def group_states(events: DataFrame, size: int) -> DataFrame:
    """uid, n, ended, failed, born, low, high of every group, from the last event of each trajectory."""
    last = events.groupBy("uid", "session", "idx").agg(F.max_by(F.struct("status", "metric"), "seq").alias("e"), F.min("global_step").alias("born"))
    return last.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("e.status").isin(*ENDED)) >= size).alias("ended"), F.bool_or(F.col("e.status") == "failure").alias("failed"), F.min("born").alias("born"), F.min("e.metric").alias("low"), F.max("e.metric").alias("high"), F.count_if((F.col("e.status") == "finished") & F.col("e.metric").isNull()).alias("lacking"))


def evictions(states: DataFrame, now: int, threshold: int | None = None, constant: bool = True) -> DataFrame:
    """states with reason: each ended group is evicted once, for the first reason of stale, failed, constant; null stays.

    A finished trajectory without its metric is an error when run.
    """
    old = stale(states, "born", F.lit(now), threshold) if threshold is not None else F.lit(False)
    same = (F.col("n") > 1) & (F.col("low") == F.col("high")) if constant else F.lit(False)
    reason = F.when(F.col("lacking") > 0, F.raise_error(F.lit("a finished group lacks its metric")).cast("string")).when(~F.col("ended"), F.lit(None).cast("string")).when(old, "stale").when(F.col("failed"), "failed").when(same, "constant")
    return states.withColumn("reason", reason)


def sample_groups(states: DataFrame, now: int, size: int, threshold: int | None = None, wait: bool = False, refill: int = 2) -> tuple[DataFrame, DataFrame]:
    """refill: prompts asked for in place of an evicted one (1: a buffer that keeps its size while it waits).

    (the oldest `size` ready groups, or none if there are fewer or a group in flight is at the threshold; a row of eviction counts and the refill asked for)."""
    told = evictions(states, now, threshold)
    ready = told.where(F.col("ended") & F.col("reason").isNull()).orderBy("born", "uid").limit(size)
    gate = told.agg((F.count_if(F.col("ended") & F.col("reason").isNull()) >= size).alias("enough"), (F.count_if(~F.col("ended") & (F.lit(now) - F.col("born") + 1 >= (threshold if threshold is not None else 1 << 60))) > 0).alias("blocked"))
    open_gate = F.col("enough") & (~F.col("blocked") if wait else F.lit(True))
    chosen = ready.crossJoin(F.broadcast(gate.select(open_gate.alias("_go")))).where("_go").drop("_go")
    gone = told.where("reason IS NOT NULL")
    counts = gone.agg(F.count(F.lit(1)).alias("evicted"), F.count_if(F.col("reason") == "stale").alias("stale"), F.count_if(F.col("reason") == "failed").alias("failed"), F.count_if(F.col("reason") == "constant").alias("constant"), (refill * F.count(F.lit(1))).alias("refill"))
    return chosen, counts


def drained(states: DataFrame, sampled: DataFrame, now: int, threshold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the groups that stay: neither evicted nor sampled; those that are discarded, with why: sampled or the reason)."""
    told = evictions(states, now, threshold).join(sampled.select("uid", F.lit(True).alias("_s")), "uid", "left")
    why = F.when(F.col("_s"), "sampled").otherwise(F.col("reason"))
    marked = told.withColumn("why", why).drop("_s", "reason")
    return marked.where("why IS NULL").drop("why"), marked.where("why IS NOT NULL")


def _following(queues: list, times: list, own: int, most: int, wait: float) -> list[int]:
    """For each of the first `own` rows, where the batch after the one that it opens begins."""
    out, j = [], 0
    for i in range(own):
        # The bound moves forward with the rows, but for those after a row without a time.
        j = i + 1 if i and times[i - 1] != times[i - 1] else max(j, i + 1)
        end = min(i + most, len(queues))
        while j < end and queues[j] == queues[i] and not times[j] - times[i] >= wait:
            j += 1
        out.append(j)
    return out


class _Piece:
    """Some rows in order, the row before them and as many after them as a batch can reach."""

    def __init__(self, rows: pd.DataFrame, queue: str, most: int, wait: float) -> None:
        rows = rows.sort_values("_pos")
        codes, self.names = pd.factorize(rows[queue], use_na_sentinel=False)
        before, self.own = int((rows["_side"] < 0).sum()), int((rows["_side"] == 0).sum())
        self.queues = codes[before:].tolist()
        self.follows = bool(before) and codes[0] == codes[before]
        self.goes_on = len(self.queues) > self.own and self.queues[self.own] == self.queues[self.own - 1]
        self.next = _following(self.queues, rows["_at"].to_numpy(float)[before:].tolist(), self.own, most, wait)
        self.pos = rows["_pos"].to_numpy()[before : before + self.own]

    def runs(self) -> list[tuple[int, int]]:
        """Where each queue begins and ends."""
        cuts = [0, *(i for i in range(1, self.own) if self.queues[i] != self.queues[i - 1]), self.own]
        return list(zip(cuts, cuts[1:], strict=False))


def count_or_time(rows: DataFrame, queue: str, at: str, order: list[str], most: int, wait: float, piece: int = 1 << 16) -> DataFrame:
    """Adds batch: a queue's rows in order; a batch ends when it has `most` rows, or a row comes `wait` or more after its first one.

    All rows are cut in pieces of `piece` rows, whatever their queues. Where a batch opens decides
    where the next one does, so a piece is a map from the place (below `most`) at which the first
    batch in it opens to that in the next piece, and how many it opens. The maps of a queue, one
    for each piece that it runs through, are folded; no queue comes together in a row or task.
    Rows without a time come first and end no batch by waiting.
    """
    from ..operators.sequences import scanned
    from ..operators.shapes import with_position

    piece = max(piece, most)
    placed = with_position(rows.select(queue, at, *order), [queue, at, *order], "_pos")
    p, k = F.floor(F.col("_pos") / piece), F.col("_pos") % piece
    side = lambda to, s: F.struct(to.alias("_piece"), F.lit(s).alias("_side"))
    sides = F.array(side(p, 0), F.when((k < most) & (p > 0), side(p - 1, 1)), F.when(k == piece - 1, side(p + 1, -1)))
    dealt = placed.select(F.col(queue), F.col(at).cast("double").alias("_at"), "_pos", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("_s")).select(queue, "_at", "_pos", "_s.*")
    kind = dict(rows.dtypes)[queue]

    def maps(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        if (frame["_side"] == 0).any():
            x = _Piece(frame, queue, most, wait)
            for n, (a, b) in enumerate(x.runs()):
                into, on = n == 0 and x.follows, b == x.own and x.goes_on
                if not into and not on:
                    continue
                ends, counts = {}, {}
                for i in range(b - 1, a - 1, -1):
                    j = x.next[i]
                    ends[i], counts[i] = (ends[j], 1 + counts[j]) if j < b else (j - b if on else -1, 1)
                entries = range(most) if into else (a,)
                name = x.names[x.queues[a]]
                out.append((None if pd.isna(name) else name, key[0], [ends.get(i, -1) for i in entries], [counts.get(i, 0) for i in entries]))
        return pd.DataFrame(out, columns=[queue, "_piece", "ends", "counts"], dtype=object)

    maps_of = dealt.groupBy("_piece").applyInPandas(maps, f"{queue} {kind}, _piece long, ends array<int>, counts array<long>")
    own = maps_of.groupBy(queue).agg(F.sort_array(F.collect_list(F.struct("_piece", "ends", "counts"))).alias("_maps"))

    def step(told: str):
        def of(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
            i = a["entry"].cast("int")
            return {"entry": F.get(x["ends"], i), "base": a["base"] + F.get(x["counts"], i)}, a[told]

        return of

    start = {"entry": F.lit(0.0), "base": F.lit(0.0)}
    entered = own.select(F.posexplode(F.arrays_zip(F.col("_maps._piece").alias("_piece"), scanned(F.col("_maps"), start, step("entry")).alias("entry"), scanned(F.col("_maps"), start, step("base")).alias("base"))).alias("_n", "_x")).where("_n > 0").select("_x.*")

    def numbers(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not (frame["_side"] == 0).any():
            return pd.DataFrame({"_pos": [], "batch": []})
        x, batches = _Piece(frame, queue, most, wait), []
        for n, (a, b) in enumerate(x.runs()):
            i, batch = (int(entry["entry"].iloc[0]), int(entry["base"].iloc[0])) if n == 0 and x.follows else (a, 0)
            i = b if i < 0 else min(i, b)
            batches += [batch - 1] * (i - a)
            while i < b:
                j = min(x.next[i], b)
                batches += [batch] * (j - i)
                i, batch = j, batch + 1
        return pd.DataFrame({"_pos": x.pos, "batch": batches})

    numbered = dealt.groupBy("_piece").cogroup(entered.groupBy("_piece")).applyInPandas(numbers, "_pos long, batch long")
    return placed.join(numbered, "_pos").drop("_pos")


def next_queue(queued: dict[str, int]) -> str | None:
    """The task of the longest queue, the first named of equal ones; null if all are empty. One task runs at a time."""
    waiting = {k: n for k, n in queued.items() if n > 0}
    return max(waiting, key=waiting.get) if waiting else None


def staleness_metrics(rows: DataFrame, first: str, last: str, now: Column) -> DataFrame:
    """One row: spans of versions within a trajectory and their age, mean, maximum and minimum."""
    span, age = F.col(last) - F.col(first), now - F.col(last)
    return rows.agg(*(f(x).alias(f"{name}_{k}") for name, x in (("span", span), ("age", age)) for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))))


def tracked(events: DataFrame, size: int, constant: bool = True) -> DataFrame:
    """A stream of uid, n, reason as groups end: state by uid holds the last event of each trajectory, and goes when the group does."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                key_of = f"{row.session}_{row.idx}"
                if key_of not in held or int(held[key_of].split("|")[0]) <= row.seq:  # events may come late
                    held[key_of] = f"{row.seq}|{row.status}|{'' if pd.isna(row.metric) else row.metric}"
        ends = [v.split("|")[1:] for v in held.values() if v.split("|")[1] in ENDED]
        if len(ends) < size:
            state.update((list(held), list(held.values())))
            return
        state.remove()
        values = {v for _, v in ends}
        reason = "failed" if any(s == "failure" for s, _ in ends) else "constant" if constant and len(ends) > 1 and len(values) == 1 else None
        yield pd.DataFrame({"uid": [key[0]], "n": [len(ends)], "reason": [reason]})

    return events.groupBy("uid").applyInPandasWithState(update, "uid string, n long, reason string", "keys array<string>, states array<string>", "append", GroupStateTimeout.NoTimeout)


def read_events(spark, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files; a bound on files a trigger is the bounded queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def drop_oldest(rows: DataFrame, queue: str, order: str, room: int) -> DataFrame:
    """dropped: rows that a bounded queue with the room would have lost when the newest came in."""
    from pyspark.sql import Window

    w = Window.partitionBy(queue).orderBy(F.col(order).desc())
    return rows.select("*", (F.row_number().over(w) > room).alias("dropped"))


class TokenBucket:
    """A rate limit for one task: a request larger than what is left is let through and leaves a debt."""

    def __init__(self, rate: float, most: float | None = None, clock=None, sleep=None) -> None:
        import time

        self.rate, self.most = rate, most or rate
        self.clock, self.sleep = clock or time.monotonic, sleep or time.sleep
        self.left, self.at = self.most, self.clock()

    def acquire(self, n: float) -> float:
        """Waits until there is room (for a large request: until the bucket is full); returns the seconds waited."""
        waited = 0.0
        while True:
            now = self.clock()
            self.left, self.at = min(self.most, self.left + (now - self.at) * self.rate), now
            need = min(n, self.most)
            if self.left >= need:
                self.left -= n
                return waited
            pause = (need - self.left) / self.rate
            self.sleep(pause)
            waited += pause


def rate_limited(df: DataFrame, call, schema: str, per_second: float, batch: int = 32, tries: int = 5, tokens: str | None = None, tokens_per_second: float | None = None, retry: tuple = (OSError, TimeoutError)) -> DataFrame:
    """call(frame of at most `batch` rows) over the rows, at most per_second rows a second in all (and tokens_per_second of the column `tokens`); failures of the kinds in retry are tried again with doubled waits."""
    import time

    parts = df.rdd.getNumPartitions()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(per_second / parts, max(batch, per_second / parts))
        budget = TokenBucket(tokens_per_second / parts) if tokens and tokens_per_second else None
        for frame in frames:
            for i in range(0, len(frame), batch):
                some = frame.iloc[i : i + batch]
                for k in range(tries):
                    bucket.acquire(len(some))
                    if budget:
                        budget.acquire(float(some[tokens].sum()))
                    try:
                        yield call(some)
                        break
                    except retry:
                        if k == tries - 1:
                            raise
                        time.sleep(min(30, 2**k))

    return df.mapInPandas(run, schema)


def should_pause(queued: int, room: int, in_flight: int, quota: int) -> bool:
    """Whether generation must wait: the queue is full, or what is in flight and queued reaches the staleness quota."""
    return queued >= room or queued + in_flight >= quota


def quota_at_sync(batch: int, threshold: float, in_flight: int, queued: int) -> tuple[int, int]:
    """(samples that may be asked for until the next weights, those that count as stale now)."""
    held = in_flight + queued
    return max(0, int(batch * (1 + threshold)) - held), held
