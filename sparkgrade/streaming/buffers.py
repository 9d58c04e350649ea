"""State with timers on a stream: a buffer of prompt groups, and batches closed by count or time.

Both hold rows back until the watermark has passed them and then take them in their own order, so
what comes out depends neither on how rows are dealt to micro-batches nor on restarts. State is
kept by group or queue; nothing is shared between keys. A key has one timer at a time, for the first
thing that it waits for, and what is of bounded size is one value: each call to the state store
costs more than the work on some rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .lifecycle import ENDED

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which timers need; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _none(x):
    return None if x is None or x != x else x


def _moved(handle, before: int | None, timer: int | None) -> None:
    """Puts a key's one timer to another time."""
    if before != timer:
        if before is not None:
            handle.deleteTimer(before)
        if timer is not None:
            handle.registerTimer(timer)


class GroupBuffer(StatefulProcessor):
    """One group's trajectories until it ends, and then the group until it is sampled or stale."""

    def __init__(self, size: int, threshold: int | None, constant: bool, wait: bool, keep: int, refill: int) -> None:
        self.size, self.threshold, self.constant, self.wait, self.keep, self.refill = size, threshold, constant, wait, keep, refill

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "step long, seq long, session int, idx int, status string, metric double")
        # life: open, blocking (open, and told so), ready, gone; since: the step of gone; last: the last event of each trajectory
        self.group = handle.getValueState("group", "born long, life string, since long, timer long, last array<struct<session: int, idx: int, seq: bigint, status: string, metric: double>>")

    def _state(self) -> tuple:
        found = self.group.get()
        return (None, "open", None, None, []) if found is None else (*found[:4], [tuple(r) for r in found[4]])

    @staticmethod
    def _at(step: int) -> int:
        # A step's time is a second later than its number (see buffered_groups). A watermark is a
        # whole step, so a timer a millisecond before it is due with it.
        return (step + 1) * 1000 - 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        some = [(r.global_step, r.seq, r.session, r.idx, r.status, _none(r.metric)) for r in rows]
        self.held.appendList(some)
        born, life, since, timer, last = self._state()
        first = self._at(min(s[0] for s in some))
        if timer is None or first < timer:
            _moved(self.handle, timer, first)
            self.group.update((born, life, since, first, last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // 1000 - 1
        born, life, since, timer, kept = self._state()
        if timer != expiredTimerInfo.getExpiryTimeInMs():  # put off since
            return
        held = [tuple(r) for r in self.held.get()]
        due = sorted((r for r in held if r[0] <= now), key=lambda r: r[:2])
        last = {r[:2]: r[2:] for r in kept}
        out: list[tuple] = []

        def told(step: int, what: str, refill: int = 0) -> None:
            out.append((key[0], step, what, refill))

        def deadline(step: int) -> None:
            """What the passing of time alone brings by the step."""
            nonlocal life, since
            if born is None or self.threshold is None:
                return
            if not self.wait and life == "ready" and step >= born + self.threshold:
                life, since = "gone", born + self.threshold
                told(since, "stale", 1)
            if self.wait and life == "open" and step >= born + self.threshold - 1:
                life = "blocking"
                told(born + self.threshold - 1, "blocking")

        for step, seq, session, idx, status, metric in due:
            # Evictions of a step come before its events; a step's blocking groups are those that it leaves open.
            deadline(step - 1 if self.wait else step)
            if life == "gone" and step >= since + self.keep:
                born, life, since, last = None, "open", None, {}
            if life == "gone":
                continue
            if born is None:
                born = step
            if status == "sampled":
                told(step, "sampled")
                life, since = "gone", step
                continue
            if life == "ready" or (session, idx) in last and last[session, idx][0] > seq:
                continue
            last[session, idx] = (seq, status, metric)
            ended = [v for v in last.values() if v[1] in ENDED]
            if len(ended) < self.size:
                continue
            if any(s == "finished" and m is None for _, s, m in ended):
                raise ValueError(f"a finished trajectory of group {key[0]} lacks its metric")
            values = {m for _, _, m in last.values() if m is not None}
            if self.threshold is not None and not self.wait and step - born + 1 > self.threshold:
                what = "stale"
            elif any(s == "failure" for _, s, _ in ended):
                what = "failed"
            elif self.constant and len(last) > 1 and len(values) == 1:
                what = "constant"
            else:
                what = "ready"
            told(step, what, {"ready": 0, "constant": self.refill}.get(what, 1))
            life, since = ("ready", None) if what == "ready" else ("gone", step)
        deadline(now)

        if life in ("ready", "gone"):
            last = {}
        rest = [r for r in held if r[0] > now]
        if held:
            self.held.put(rest) if rest else self.held.clear()
        if life == "gone" and now >= since + self.keep and not rest:
            self.group.clear()
        else:
            waits = [min(r[0] for r in rest)] if rest else []
            if life == "gone":
                waits.append(max(since + self.keep, now + 1))
            elif self.threshold is not None and born is not None and life == ("open" if self.wait else "ready"):
                waits.append(born + self.threshold - (1 if self.wait else 0))
            timer = self._at(min(waits)) if waits else None
            _moved(self.handle, None, timer)  # the one that has fired is gone
            self.group.update((born, life, since, timer, [(*k, *v) for k, v in last.items()]))
        yield from map(Row("uid", "step", "what", "refill"), *zip(*out, strict=True)) if out else ()


def buffered_groups(events: DataFrame, size: int, threshold: int | None = None, late: int = 1, constant: bool = True, wait: bool = False, keep: int = 1000, refill: int = 2) -> DataFrame:
    """A stream of uid, step, what, refill over a stream of life-cycle events (uid, session, idx, status, global_step, metric, seq).

    The clock is global_step, the step (from 0) at which an event happened. what: ready (ended and worth
    sampling), failed, constant or stale (evicted; refill: prompts to ask for in its place, `refill`
    for a constant group and else 1), sampled (an event of status "sampled" took it out). Stale is
    a group that ends, or isn't sampled, before its age in steps passes the threshold. With wait no
    group goes stale: one in flight at the threshold is told once as blocking.

    Events may come `late` steps after later ones (from 1); what comes later than that is dropped. A
    group that has gone is remembered for `keep` steps, so that its late events don't start it anew.
    Events of a null uid belong to one group; a null metric of a finished trajectory ends the stream
    with an error when its group ends. Start the stream within state_store().
    """
    if late < 1:
        raise ValueError("late must be 1 or more: rows of the watermark's own step count as late")
    # The first watermark is the epoch, whose rows would count as late.
    timed = events.withColumn("_at", F.timestamp_seconds(F.col("global_step") + 1)).withWatermark("_at", f"{late} seconds")
    return timed.groupBy("uid").transformWithState(GroupBuffer(size, threshold, constant, wait, keep, refill), "uid string, step long, what string, refill int", "Append", "EventTime")


class TimedBatches(StatefulProcessor):
    """One queue's requests: those that wait for the watermark, and the open batch."""

    def __init__(self, most: int, wait: int, at: str | None, queue: str, identity: str, kind: str) -> None:
        self.most, self.wait, self.at, self.queue, self.identity, self.kind = most, wait, at, queue, identity, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"at long, id {self.kind}")
        # open: the rows of the open batch, fewer than `most`
        self.place = handle.getValueState("place", f"batch long, timer long, open array<struct<at: bigint, id: {self.kind}>>")

    def _now(self, timers) -> int:
        return timers.getCurrentProcessingTimeInMs() if self.at is None else timers.getCurrentWatermarkInMs()

    def _state(self) -> tuple:
        found = self.place.get()
        return (0, None, []) if found is None else (*found[:2], [tuple(r) for r in found[2]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.at is None:
            now = self._now(timerValues)
            yield from self._advance(key, now, [(now, r[self.identity]) for r in rows], *self._state())
            return
        some = [(r["_ms"], r[self.identity]) for r in rows]
        self.held.appendList(some)
        batch, timer, open_rows = self._state()
        first = min(at for at, _ in some)
        if timer is None or first < timer:
            _moved(self.handle, timer, first)
            self.place.update((batch, first, open_rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._now(timerValues)
        batch, timer, open_rows = self._state()
        if timer != expiredTimerInfo.getExpiryTimeInMs():  # put off since
            return
        held = [tuple(r) for r in self.held.get()]
        rest = [r for r in held if r[0] > now]
        if held:
            self.held.put(rest) if rest else self.held.clear()
        # A timer that has fired is gone, hence None.
        yield from self._advance(key, now, sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], r[1])), batch, None, open_rows, min((at for at, _ in rest), default=None))

    def _advance(self, key, now: int, due: list[tuple], batch: int, timer: int | None, open_rows: list, later: int | None = None) -> Iterator[Row]:
        out: list[tuple] = []

        def close(why: str) -> None:
            nonlocal batch, open_rows
            out.extend((key[0], i, batch, why) for _, i in open_rows)
            batch, open_rows = batch + 1, []

        for at, i in due:
            if open_rows and at - open_rows[0][0] >= self.wait:
                close("waited")
            open_rows.append((at, i))
            if len(open_rows) == self.most:
                close("full")
        if open_rows and now - open_rows[0][0] >= self.wait:
            close("waited")
        after = min((x for x in (later, open_rows[0][0] + self.wait if open_rows else None) if x is not None), default=None)
        _moved(self.handle, timer, after)
        self.place.update((batch, after, open_rows))
        yield from map(Row(self.queue, self.identity, "batch", "why"), *zip(*out, strict=True)) if out else ()


def timed_batches(rows: DataFrame, queue: str, identity: str, most: int, wait: float, at: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of queue, identity, batch (from 0 in each queue), why (full or waited), as batches close.

    A batch closes when it has `most` rows, or `wait` seconds after its first one, be it that
    nobody else comes. Without `at` a row's time is that of its arrival (processing-time timers; a
    micro-batch's rows arrive together, in the order given). With a timestamp column `at` it is
    the row's own, ties by identity, and rows are held until the watermark, `late` behind the
    latest row, has passed them: the batches are those of lifecycle.count_or_time over the whole
    log. Later rows, and rows of 1970's first
    instant or before, are dropped. Start the stream within state_store().
    """
    types = dict(rows.dtypes)
    processor = TimedBatches(most, round(wait * 1000), at, queue, identity, types[identity])
    own = rows.select(queue, identity) if at is None else rows.select(queue, identity, at, F.unix_millis(at).alias("_ms")).withWatermark(at, late)
    return own.groupBy(queue).transformWithState(processor, f"{queue} {types[queue]}, {identity} {types[identity]}, batch long, why string", "Append", "ProcessingTime" if at is None else "EventTime")
