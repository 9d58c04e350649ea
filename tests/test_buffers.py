"""State with timers: streams against plain models over the same log, over restarts and late rows."""

import json
import random
import time

import pytest
from pyspark.sql import Row

from sparkgrade.streaming import buffers, lifecycle

EVENTS = "uid string, session int, idx int, status string, global_step long, metric double, seq long"
NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def put(folder, n, rows, names=NAMES):
    (folder / f"{n:03}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    time.sleep(0.02)  # files are taken by their time


def run(spark, stream, tmp_path, out="out"):
    with buffers.state_store(spark):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-state")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / out)).collect()


def model(log, size, threshold, now, wait=False, refill=2):
    """What comes of each group when its whole log is read in order."""
    out = []
    for uid in {r[0] for r in log}:
        mine = sorted((r for r in log if r[0] == uid), key=lambda r: (r[4], r[6]))
        born, last, life = mine[0][4], {}, "open"
        for step in range(born, now + 1):
            if not wait and life == "ready" and step - born + 1 > threshold:
                out.append((uid, step, "stale", 1))
                life = "gone"
            for _, session, idx, status, at, metric, _ in mine:
                if at != step or life == "gone":
                    continue
                if status == "sampled":
                    out.append((uid, step, "sampled", 0))
                    life = "gone"
                elif life != "ready":
                    last[session, idx] = (status, metric)
                    ended = [v for v in last.values() if v[0] in ("finished", "failure")]
                    if len(ended) >= size:
                        same = len(last) > 1 and len({m for _, m in last.values() if m is not None}) == 1
                        what = "stale" if not wait and step - born + 1 > threshold else "failed" if any(s == "failure" for s, _ in ended) else "constant" if same else "ready"
                        out.append((uid, step, what, {"ready": 0, "constant": refill}.get(what, 1)))
                        life = "ready" if what == "ready" else "gone"
            if wait and life == "open" and step - born + 1 >= threshold:
                out.append((uid, step, "blocking", 0))
                life = "blocking"
    return sorted(out)


def log_of(seed, groups=30, steps=24):
    r, out, seq = random.Random(seed), [], 0
    for step in range(steps):
        for _ in range(r.randrange(16)):
            seq += 1
            status = r.choice(("pending", "running", "finished", "finished", "finished", "failure" if r.random() < 0.2 else "running", "sampled" if r.random() < 0.3 else "running"))
            out.append((f"g{r.randrange(groups)}", r.randrange(3), 0, status, step, float(r.randrange(2)) if status == "finished" else None, seq))
    return out


@pytest.mark.parametrize("wait", [False, True])
def test_group_buffer_equals_its_log_over_restarts_and_late_events(spark, tmp_path, wait):
    log, folder, r = log_of(8), tmp_path / "events", random.Random(1)
    folder.mkdir()
    mixed = sorted(log, key=lambda e: e[4] + 2.5 * r.random())  # at most three steps late
    cut = len(mixed) // 3
    for n in range(2):
        put(folder, n, mixed[n * cut : (n + 1) * cut])
    stream = lambda: buffers.buffered_groups(lifecycle.read_events(spark, str(folder), EVENTS), 2, 6, late=4, wait=wait)
    early = {tuple(x) for x in run(spark, stream(), tmp_path)}
    put(folder, 2, mixed[2 * cut :])
    now = max(e[4] for e in log)
    put(folder, 3, [("end", 0, 0, "pending", now + 4, None, 10**6)])
    got = sorted(tuple(x) for x in run(spark, stream(), tmp_path))
    want = model(log, 2, 6, now, wait)
    assert got == want and early < set(got)
    assert {w for _, _, w, _ in want} >= ({"blocking", "ready", "constant"} if wait else {"stale", "ready", "constant", "sampled", "failed"})


def test_gone_groups_are_forgotten_after_a_while(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    event = lambda step, seq: ("a", 0, 0, "failure", step, None, seq)
    for n, rows in enumerate(([event(1, 1)], [event(4, 2)], [event(30, 3)], [("end", 0, 0, "pending", 60, None, 4)])):
        put(folder, n, rows)
    got = run(spark, buffers.buffered_groups(lifecycle.read_events(spark, str(folder), EVENTS), 1, keep=10), tmp_path)
    assert sorted(tuple(r) for r in got) == [("a", 1, "failed", 1), ("a", 30, "failed", 1)]


def test_a_finished_trajectory_without_metric_ends_the_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    put(folder, 0, [("a", 0, 0, "finished", 1, None, 1), ("end", 0, 0, "pending", 9, None, 4)])
    with pytest.raises(Exception, match="lacks its metric"):
        run(spark, buffers.buffered_groups(lifecycle.read_events(spark, str(folder), EVENTS), 1), tmp_path)


def test_timed_batches_equal_the_batch_form(spark, tmp_path):
    r, folder = random.Random(3), tmp_path / "rows"
    folder.mkdir()
    rows = [(f"q{r.randrange(3)}", i, 1000 + r.randrange(400)) for i in range(300)]
    names = ["q", "id", "s"]
    mixed = sorted(rows, key=lambda x: x[2] + 15 * r.random())
    for n in range(3):
        put(folder, n, mixed[n * 100 : n * 100 + 100], names)
    read = lambda: lifecycle.read_events(spark, str(folder), "q string, id long, s long").selectExpr("q", "id", "timestamp_seconds(s) AS at")
    stream = lambda: buffers.timed_batches(read(), "q", "id", 5, 9, "at", "16 seconds")
    run(spark, stream(), tmp_path)
    put(folder, 3, [("end", -1, 3000)], names)
    got = {(x.q, x.id): x.batch for x in run(spark, stream(), tmp_path)}
    want = lifecycle.count_or_time(spark.createDataFrame(rows, "q string, id long, s long"), "q", "s", ["id"], 5, 9.0).collect()
    assert got == {(x.q, x.id): x.batch for x in want} and len(got) == 300


def test_a_lone_request_leaves_after_the_wait(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    put(folder, 0, [("a", i) for i in range(4)] + [("b", 9)], ["q", "id"])
    rows = lifecycle.read_events(spark, str(folder), "q string, id long")
    with buffers.state_store(spark):
        q = buffers.timed_batches(rows, "q", "id", 3, 2.0).writeStream.format("memory").queryName("served").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("served").count() < 5:
            time.sleep(0.3)
        got = sorted((r.q, r.id, r.batch, r.why) for r in spark.table("served").collect())
    finally:
        q.stop()
    assert [g[0] for g in got] == ["a"] * 4 + ["b"]
    assert sorted(g[3] for g in got) == ["full"] * 3 + ["waited"] * 2 and got[-1] == ("b", 9, 0, "waited")


@pytest.mark.parametrize(("most", "piece"), [(1, 1), (3, 3), (4, 7), (5, 16), (6, 1000)])
def test_count_or_time_in_pieces_equals_a_walk_over_each_queue(spark, most, piece):
    r = random.Random(most)
    rows = [("hot", i, float(i // 2 + r.randrange(2))) for i in range(90)] + [(f"q{r.randrange(9)}", i, float(r.randrange(60))) for i in range(90, 140)]
    rows += [("hot", 200, None), ("hot", 201, None), (None, 300, 5.0), (None, 301, 6.0), ("sparse", 400, 0.0), ("sparse", 401, 1e6)]
    want, state = {}, {}
    for q, i, t in sorted(rows, key=lambda x: (x[0] or "", x[2] is not None, x[2] or 0, x[1])):
        n, first, batch = state.get(q, (most, None, -1))
        if n >= most or (t is not None and first is not None and t - first >= 4):
            n, first, batch = 0, t, batch + 1
        state[q] = (n + 1, first, batch)
        want[q, i] = batch
    df = spark.createDataFrame(rows, "q string, id long, t double").repartition(5)
    got = {(x.q, x.id): x.batch for x in lifecycle.count_or_time(df, "q", "t", ["id"], most, 4.0, piece).collect()}
    assert got == want
    assert lifecycle.count_or_time(df.where("id < 0"), "q", "t", ["id"], most, 4.0, piece).count() == 0


def test_back_pressure_and_quota():
    assert lifecycle.should_pause(4, 4, 0, 99) and lifecycle.should_pause(1, 4, 5, 6) and not lifecycle.should_pause(1, 4, 4, 6)
    assert lifecycle.quota_at_sync(8, 0.5, 3, 2) == (7, 5) and lifecycle.quota_at_sync(8, 0.0, 6, 5) == (0, 11)


class Calls:
    """A handle to a state store that holds nothing and counts what it is asked."""

    def __init__(self):
        self.asked = []

    def __getattr__(self, name):
        def ask(*given):
            self.asked.append(name)
            return None if name in ("get", "update", "appendList", "registerTimer", "deleteTimer") else self

        return ask


@pytest.mark.parametrize("processor", [buffers.GroupBuffer(3, 12, True, False, 99, 2), buffers.TimedBatches(4, 7000, "at", "q", "id", "long")])
def test_a_key_asks_its_state_no_more_often_for_more_rows(processor):
    asked = []
    for n in (1, 50):
        handle = Calls()
        processor.init(handle)
        handle.asked.clear()
        rows = [Row(global_step=k, seq=k, session=0, idx=0, status="running", metric=None, _ms=1000 * k, id=k) for k in range(5, 5 + n)]
        list(processor.handleInputRows(("a",), iter(rows), None))
        asked.append(sorted(handle.asked))
    assert asked[0] == asked[1] == ["appendList", "get", "registerTimer", "update"]
