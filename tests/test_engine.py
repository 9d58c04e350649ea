"""Shapes, filters, joins, life-cycles, readers and writers on small frames."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgrade import sources
from sparkgrade.functions import text
from sparkgrade.operators import correction, filters, losses, matching, metrics, scoring, shapes
from sparkgrade.plans import catalog
from sparkgrade.streaming import lifecycle


def test_positions_and_padding(spark):
    df = spark.createDataFrame([(x,) for x in "dbcae"], "x string")
    got = shapes.with_position(df, ["x"])
    assert sorted((r.x, r.pos) for r in got.collect()) == list(zip("abcde", range(5), strict=True))
    padded = shapes.pad_to_divisor(got, 4, 5)
    assert padded.count() == 8 and shapes.unpad(padded).count() == 5
    assert shapes.pad_to_divisor(got, 13, 5).where("is_padding").count() == 8


def test_unite_and_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert shapes.unite(a, a.withColumn("w", F.lit(1)), "k").count() == 2
    with pytest.raises(Exception, match="differ"):
        shapes.unite(a, a.withColumn("v", F.lit("z")), "k").collect()
    with pytest.raises(Exception, match="differ"):
        shapes.unite(a, a.limit(1), "k").collect()
    assert shapes.differences(a, a).isEmpty() and shapes.differences(a, a.limit(1)).count() == 1
    with pytest.raises(ValueError):
        shapes.rename(a, {"q": "r"})


def test_chunks_repeats_and_folds(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert [r[1] for r in shapes.chunk(df, 4, F.lit(10)).groupBy("chunk").count().orderBy("chunk").collect()] == [3, 3, 2, 2]
    tiled = shapes.repeat(df, 2, F.lit(10), interleave=False)
    assert sorted(r.new_pos for r in tiled.collect()) == list(range(20))
    folded = shapes.fold(df.withColumn("v", F.col("pos") * 2), ["v"], 5)
    assert {r.slot: r.v for r in folded.collect()} == {0: [0, 2, 4, 6, 8], 1: [10, 12, 14, 16, 18]}
    assert shapes.unfold(folded, ["v"]).count() == 10
    assert shapes.inverse_permutation(spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "pos int, new_pos int")).count() == 3


def test_group_filters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 3)], "g string, v int")
    assert sorted(r.g for r in filters.varied_groups(df, "g", "v").collect()) == ["b", "b", "c"]
    assert [tuple(r) for r in filters.constant_group_counts(df, "g", "v").collect()] == [(1, 1)]
    with pytest.raises(Exception, match="lacks"):
        filters.varied_groups(df.withColumn("v", F.when(F.col("g") != "a", F.col("v"))), "g", "v").collect()
    assert filters.selected_indices(10, 3, "first", start=8) == [8, 9] and filters.selected_indices(10, 3, "random", 1) == sorted(filters.selected_indices(10, 3, "random", 1))


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "k int, w double")
    got = {r.k: r["count"] for r in filters.draw_with_replacement(df, F.col("w"), 4000, 5, ["k"]).groupBy("k").count().collect()}
    assert sum(got.values()) == 4000 and 3 not in got and abs(got[2] / 4000 - 0.75) < 0.05


def test_trace_back_prefers_equal_then_longest_and_equal_truth(spark):
    long = "a long enough source key of thirty"
    src = spark.createDataFrame([(0, long, "x"), (1, long + " more", "y"), (2, "short", "z"), (3, long, "w"), (4, "", "q")], "o int, k string, t string")
    rec = spark.createDataFrame([(10, "short", "z"), (11, f"pre {long} more post", "y"), (12, f"pre {long} post", "w"), (13, "has short inside", None), (14, None, None), (15, long, "none")], "r int, k string, t string")
    got = {r.r: r.o for r in matching.trace_back(rec, src, "r", "k", "k", "o", "t", "t").collect()}
    assert got == {10: 2, 11: 1, 12: 3, 13: None, 14: None, 15: 0}


def test_resume_and_alignment(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, None), (2, "bad")], "k int, error string")
    assert [r.k for r in matching.remaining(rows, done, "k").collect()] == [3]
    assert sorted(r.k for r in matching.remaining(rows, done, "k", True).collect()) == [2, 3]
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, None)], [(2, None), (1, "b"), (4, "c")]))
    assert sorted((r.k, r.fault) for r in matching.alignment_faults(a, b, "k", ["v"]).collect()) == [(1, "differs"), (4, "missing left")]
    log = spark.createDataFrame([(1, 1, "e"), (1, 2, "ok")], "k int, line int, s string")
    assert matching.last_wins(log, "k", ["line"]).first().s == "ok"


def test_validation_metrics_are_exact_expectations(spark):
    df = spark.createDataFrame([("s", "u", float(x)) for x in (0, 1, 2, 5)], "source string, uid string, v double")
    got = {r.metric: r.value for r in metrics.validation_metrics(df, "source", "uid", "v").collect()}
    assert got["mean@4"] == 2 and set(got) == {"mean@4", "std@4", "best@2", "best@4", "worst@2", "worst@4"}
    pairs = [max(a, b) for a in (0, 1, 2, 5) for b in (0, 1, 2, 5)]
    assert got["best@2"] == pytest.approx(sum(pairs) / 16)


def test_bootstrap_query_resamples_every_user(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, u, k, rnd.uniform(0, 9)) for i, (k, u) in enumerate((k, u) for k in "ab" for u in (1, 2, 49, 50, 51, 100, None) for _ in range(2 + (u or 5) % 6))]
    shuffled = rnd.sample(rows, len(rows))
    spark.createDataFrame(shuffled, "event_id long, user_id long, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: r for r in catalog.QUERIES["validation_bootstrap"](spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"}
    for kind, row in got.items():
        each = []
        for user in (1, 2, 49, 50, 51, 100, None):
            x = [v for _, u, k, v in rows if k == kind and u == user]
            if len(x) >= 4:
                np.random.seed(42)
                draws = [[x[i] for i in some] for some in np.random.choice(len(x), size=(1000, 4), replace=True)]
                top, low = [max(s) for s in draws], [min(s) for s in draws]
                each.append((np.mean(top), np.std(top), np.mean(low), np.std(low)))
        assert len(each) > 2
        assert [row.best, row.best_std, row.worst, row.worst_std] == pytest.approx(np.mean(each, axis=0), abs=1e-4)


def test_objectives(spark):
    df = spark.createDataFrame([(1, -1.0, -1.5, 2.0, 1), (1, -1.0, -0.2, -1.0, 1), (2, -0.5, -0.5, 1.0, 0)], "seq int, old_logp double, logp double, advantage double, mask int")
    got = losses.vanilla(df).collect()
    assert got[0].loss == pytest.approx(-2 * 2.718281828**-0.5) and got[2].loss == -1
    assert losses.aggregate(losses.gpg_loss(df), "token-sum").first().loss == pytest.approx(1.5 * 2 - 0.2)
    assert losses.preference_loss(F.lit(1000.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0) is not None
    kept = correction.rejection_mask(df.withColumnRenamed("logp", "rollout_logp"), {"token_k1": 1.5}).collect()
    assert [r.kept for r in kept] == [0, 0, 0] or [r.kept for r in kept][2] == 0


EVENTS = "uid string, session int, idx int, status string, global_step long, metric double, seq long"


def group_events():
    out, seq = [], 0
    for uid, ends in (("ok", [("finished", 1.0), ("finished", 0.0)]), ("same", [("finished", 1.0), ("finished", 1.0)]), ("bad", [("finished", 1.0), ("failure", None)]), ("open", [("finished", 1.0), ("running", None)]), ("old", [("finished", 1.0), ("finished", 1.0)])):
        for s, (status, metric) in enumerate(ends):
            for st, m in (("running", None), (status, metric)):
                seq += 1
                out.append((uid, s, 0, st, 1 if uid == "old" else 9, m, seq))
    return out


def test_life_cycles(spark):
    states = lifecycle.group_states(spark.createDataFrame(group_events(), EVENTS), 2)
    assert {r.uid: r.reason for r in lifecycle.evictions(states, 10, 5).collect()} == {"ok": None, "same": "constant", "bad": "failed", "open": None, "old": "stale"}
    chosen, counts = lifecycle.sample_groups(states, 10, 1, 5)
    told = counts.first()
    assert [r.uid for r in chosen.collect()] == ["ok"] and (told.evicted, told.refill) == (3, 6)
    assert lifecycle.sample_groups(states, 10, 2, 5)[0].isEmpty() and lifecycle.sample_groups(states, 14, 1, 5, wait=True)[0].isEmpty()
    with pytest.raises(Exception, match="lacks"):
        lifecycle.evictions(lifecycle.group_states(spark.createDataFrame([("x", 0, 0, "finished", 1, None, 1)], EVENTS), 1), 1).collect()


def test_life_cycles_on_a_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    rows = group_events()
    for n, part in enumerate((rows[:7], rows[7:])):
        names = [c.split()[0] for c in EVENTS.split(", ")]
        (folder / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in part))
    stream = lifecycle.tracked(lifecycle.read_events(spark, str(folder), EVENTS), 2)
    q = stream.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.uid: r.reason for r in spark.table("ended").collect()} == {"ok": None, "same": "constant", "bad": "failed", "old": "constant"}


def test_token_bucket_lets_large_requests_run_into_debt():
    now = [0.0]
    bucket = lifecycle.TokenBucket(10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert bucket.acquire(10) == 0 and bucket.acquire(5) == pytest.approx(0.5)
    assert bucket.acquire(30) == pytest.approx(1.0) and bucket.left == pytest.approx(-20)
    assert bucket.acquire(1) == pytest.approx(2.1)


def test_rate_limited_calls(spark):
    got = lifecycle.rate_limited(spark.range(20, numPartitions=2), lambda f: pd.DataFrame({"id": f["id"] * 2}), "id long", 1e6, 7)
    assert sorted(r.id for r in got.collect()) == [2 * i for i in range(20)]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"x": 1}\n\nbroken\n[1]\n{"x": 2}\n')
    lines = sources.read_lines(spark, str(path), "x int")
    assert sorted((r.line, r.reason) for r in lines.where("reason IS NOT NULL").collect()) == [(2, "blank_line"), (3, "malformed"), (4, "not_an_object")]
    assert sorted((r.line, r.record.x) for r in lines.where("reason IS NULL").collect()) == [(1, 1), (5, 2)]
    from pyspark.sql.types import IntegerType, StructField, StructType

    with pytest.raises(Exception):
        sources.read_jsonl(spark, str(path), StructType([StructField("x", IntegerType())])).collect()


def test_steps_trees_and_numbers(spark, tmp_path):
    for name in ("1.jsonl", "20.jsonl", "x3.jsonl"):
        (tmp_path / name).write_text('{"v": 1}\n')
    assert sorted(r.step for r in sources.read_steps(spark, str(tmp_path)).collect()) == [1, 20]
    tree = tmp_path / "tree"
    spark.createDataFrame([(1, "a")], "v int, w string").write.parquet(str(tree / "one" / "p"))
    (tree / "two").mkdir()
    (tree / "two" / "r.jsonl").write_text('{"v": 5}\n')
    assert sorted((r.source, r.v) for r in sources.read_tree(spark, str(tree), ["v", "w"]).collect()) == [("one", 1), ("two", 5)]
    rows = sources.parquet_rows(spark, str(tree / "one" / "p"), ["v"])
    assert sources.rows_at(rows, rows.select("file", "row_index")).count() == 1


def test_checkpoints_and_rewrites(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for _ in range(2):
        sources.append_checkpoint(rows, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    assert sources.rewrite_parquet(spark, source, target, lambda d: d.withColumn("w", F.lit(1)), F.col("w") == 1) == 1
    with pytest.raises(ValueError):
        sources.rewrite_parquet(spark, source, target, lambda d: d.limit(0), F.lit(True))
    assert spark.read.parquet(target).columns == ["k", "v", "w"]


def test_option_enrichment(spark):
    df = spark.createDataFrame([("g", "A. x\nB. y", ("s", None)), ("d", "", ("s", None)), ("?", "", ("s", None)), ("g", "A. x", ("s", None)), ("g", "A. x\nB. y", ("s", "q"))], "src string, p string, info struct<split:string,option_a:string>")
    df = df.withColumn("info", F.col("info").withField("option_b", F.when(F.col("info.option_a").isNotNull(), "y")))
    got = [(r.status, r.info.option_a) for r in sources.enrich_options(df, F.col("p"), "info", "src", {"g"}, {"d"}).collect()]
    assert got == [("added", "x"), ("detection", None), ("unknown source", None), ("option missing", None), ("options conflict", "q")]


def test_routes_raise_for_unknown_sources(spark):
    df = spark.createDataFrame([("z", "1", "1")], "s string, a string, b string")
    with pytest.raises(Exception, match="unknown source"):
        scoring.route(df, "s", "a", "b", {"x": "last_number"}).collect()


def test_gate_and_judge(spark):
    question = "Are they consistent?\nA. It remains.\nB. It changed.\n"
    rows = [
        ("same", "pos", '<think>The layout is stable.</think>{"answer":"A"}', '{"answer":"A"}', question), ("other", "pos", '<think>The layout changed.</think>{"answer":"A"}', '{"answer":"A"}', question),
        ("wrong", "neg", '<think>The layout is stable.</think>{"answer":"A"}', '{"answer":"B"}', "no options"), ("bare", "pos", '{"answer":"A"}', '{"answer":"A"}', question), ("unclear", "pos", '<think>More is needed.</think>{"answer":"A"}', '{"answer":"A"}', question),
        ("boxes", "detection", "{}", "{}", None), ("swapped", "pos", '<think>The layout is stable.</think>{"answer":"B"}', '{"answer":"B"}', "Q\nA. It changed.\nB. It remains.\n"),
    ]
    df = spark.createDataFrame(rows, "k string, source string, solution string, truth string, prompt string")
    judge = spark.createDataFrame([("The layout is stable.", "It remains.", "It changed.", "A", 0.0), ("The layout changed.", "It remains.", "It changed.", "B", 0.1), ("More is needed.", "It remains.", "It changed.", "U", 0.9), ("The layout is stable.", "It changed.", "It remains.", "B", 0.0)], "sentence string, option_a string, option_b string, option string, unclear double")
    gate = lambda d, j: scoring.reasoning_gate(d, "k", "source", "solution", "truth", "prompt", F.lit(1.0), j, {"pos", "neg"})
    got = {r[0]: tuple(r)[1:] for r in gate(df, judge).collect()}
    assert got == {"same": (1, 1, 1, 1, 0, 0), "other": (0, 1, 0, 1, 0, 0.1), "wrong": (0, 0, 0, 0, 0, 0), "bare": (0, 1, 0, 1, 1, 0), "unclear": (1, 1, 1, 1, 0, 0.9), "boxes": (1, 1, 1, 0, 0, 0), "swapped": (1, 1, 1, 1, 0, 0)}
    with pytest.raises(Exception, match="lacks a question"):
        gate(df, judge.limit(1)).collect()
    with pytest.raises(Exception, match="isn't A, B or U"):
        gate(df, judge.withColumn("option", F.lit("C"))).collect()
    with pytest.raises(Exception, match="two options"):
        gate(df.withColumn("prompt", F.lit("none")), judge).collect()
    pairs = spark.createDataFrame([("a", "b"), ("X", "x"), (" ", "b"), ("a", "b")], "p string, t string")
    table = spark.createDataFrame([("a", "b", [0.1, 0.2, 0.4, 0.3])], "prediction string, truth string, probabilities array<double>")
    assert sorted(r.judged for r in scoring.with_judge(pairs, "p", "t", table).collect()) == pytest.approx([0, 0.3, 0.3, 1])
    assert text.ACTIONS


def test_positions_over_many_partitions(spark):
    """Rows whose order repeats, in more ranges than cores, and with pruned columns."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(300_000).selectExpr("id", "CAST(pmod(hash(id), 5000) AS int) AS k", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS n")
        got = shapes.with_position(df, ["n", "k"]).agg(F.count_distinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.count(F.lit(1)).alias("c")).first()
        assert tuple(got) == (300_000, 0, 299_999, 300_000)
        rows = shapes.with_position(df, ["n", "k"]).orderBy("pos").select("n", "k").collect()
        keys = [(r.n is not None, r.n or 0, r.k) for r in rows]
        assert keys == sorted(keys)
        draws = filters.draw_with_replacement(df, F.lit(1.0), 20_000, 3, ["id"])
        assert draws.columns == [*df.columns, "draw"] and draws.select("draw").distinct().count() == draws.count() == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    none = spark.createDataFrame([], "x int")
    assert shapes.with_position(none, ["x"]).count() == 0


def test_resampled_tree_in_numpys_stream(spark):
    rnd = random.Random(5)
    rows = [(s, u, i, float(rnd.randrange(5)), rnd.choice("AB")) for s in "xy" for u in "pq" for i in range(2 + (u == "q") * 5)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "s string, u string, i int, v double, vote string")
    got = {(r.s, r.metric): r.value for r in metrics.resampled_tree(df, "s", "u", ["v"], "i", "vote").collect()}
    want = {}
    for s in "xy":
        for u in "pq":
            own = [r for r in rows if r[:2] == (s, u)]
            n = len(own)
            told = {f"mean@{n}": np.mean([r[3] for r in own]), f"std@{n}": np.std([r[3] for r in own])}
            for k in [x for x in (2, 4) if x < n] + [n]:
                np.random.seed(42)
                draws = [[own[i] for i in some] for some in np.random.choice(n, size=(1000, k), replace=True)]

                def voted(draw):
                    votes = {}
                    for r in draw:
                        votes.setdefault(r[4], []).append(r[3])
                    return max(votes.values(), key=len)[0]

                for name, f in (("best", lambda d: max(r[3] for r in d)), ("worst", lambda d: min(r[3] for r in d)), ("maj", voted)):
                    values = [f(d) for d in draws]
                    told |= {f"{name}@{k}/mean": np.mean(values), f"{name}@{k}/std": np.std(values)}
            for m, v in told.items():
                want.setdefault((s, m), []).append(v)
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()})


def slow_or_wrong(x):
    import time

    if x == 3:
        time.sleep(60)
    if x == 4:
        raise KeyError("four")
    return x * 2


def test_guarded_scores_end_what_hangs():
    from sparkgrade.functions.guarded import Pool

    with Pool(slow_or_wrong, 2) as pool:
        got = pool.map([(x,) for x in range(6)], 1.0)
        assert [v for v, _ in got] == [0, 2, 4, None, None, 10] and got[3][1] == "timeout" and got[4][1].startswith("KeyError")
        assert pool.map([(7,)], 1.0) == [(14, None)] and pool.map([], 1.0) == []


def test_rewrites_keep_one_whole_table(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    for k in (1, 2):
        sources.rewrite_parquet(spark, source, target, lambda d, k=k: d.withColumn("k", F.lit(k)), F.col("k") == k)
        assert {r.k for r in spark.read.parquet(target).collect()} == {k}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["in", "out"]
    with pytest.raises(ValueError, match="lengths"):
        sources.dump_step({"a": [1], "b": []}, spark, str(tmp_path / "s"), 1)


def test_media_and_images_must_agree(spark):
    df = spark.createDataFrame([("a <image> b", ["x"]), ("no", ["x"])], "t string, i array<string>")
    assert [p.item for p in df.where("size(i) = 1 AND t LIKE 'a%'").select(sources.bound_media(F.col("t"), F.col("i")).alias("p")).first().p] == [None, "x", None]
    with pytest.raises(Exception, match="marks and"):
        df.select(sources.bound_media(F.col("t"), F.col("i"))).collect()


def test_remote_tests_and_batches(spark):
    tests = spark.createDataFrame([("a", 0, "c", "1", "1"), ("a", 1, "c", "2", "3"), ("b", 0, "c", "1", "1")], "k string, test int, code string, input string, output string")
    results = scoring.run_tests(tests, "k", lambda rows: [(r[3] == r[4], None) for r in rows])
    assert {(r.key, r.test): r.passed for r in results.collect()} == {("a", 0): True, ("a", 1): False, ("b", 0): True}

    def lost(rows):
        raise OSError("gone")

    assert not any(r.passed for r in scoring.run_tests(tests, "k", lost).collect())
    assert lifecycle.next_queue({"a": 2, "b": 5, "c": 5}) == "b" and lifecycle.next_queue({"a": 0}) is None


def test_notes_of_concatenated_frames(spark):
    a = spark.range(2)
    assert shapes.concat([a, a], [{"x": 1}, {"x": 1}])[0].count() == 4
    with pytest.raises(ValueError, match="x is"):
        shapes.concat([a, a], [{"x": 1}, {"x": 2}])
    odd = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    with pytest.raises(Exception, match="divide"):
        shapes.unfold_chunks(odd, "v", 2).collect()


def test_long_scans_keep_their_order(spark):
    from sparkgrade.operators import sequences

    n = 3 * sequences.BLOCK + 7
    df = spark.createDataFrame([([1.0] * n, [1] * n)], "r array<double>, m array<int>")
    got = df.select(sequences.discounted_returns(F.col("r"), F.col("m"), 1.0).alias("v")).first().v
    assert got == [float(n - i) for i in range(n)]
