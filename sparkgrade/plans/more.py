"""Queries of the gate, decompositions, joins, shapes, packing, streams and metrics that need more than a line of SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, parsers
from ..functions.registry import SCORERS
from ..operators import advantages as adv
from ..operators import correction, filters, losses, matching, metrics, packing, scoring, sequences, shapes
from ..streaming import lifecycle

QUERIES: dict[str, object] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, digits: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# Gate and decomposition: an event is a response.

_GATED = """(SELECT event_id, event_id % 7 AS k, event_id % 5 AS j FROM events)"""


@query(
    f"""WITH g AS (SELECT *, k <> 0 AS gated, k NOT IN (0, 1) AS ok, k NOT IN (0, 1, 2) AS need FROM {_GATED}),
    o AS (SELECT *, CASE WHEN need THEN CASE WHEN j = 0 THEN 'U' WHEN j < 3 THEN 'A' ELSE 'B' END END AS opt FROM g)
    SELECT event_id, CASE WHEN NOT gated THEN 0.25 WHEN need AND (opt = 'U' OR opt = 'A') THEN 0.25 ELSE 0.0 END AS score, CASE WHEN NOT gated OR ok THEN 1.0 ELSE 0.0 END AS R1,
      CASE WHEN NOT gated THEN 1.0 WHEN need AND opt IN ('U', 'A') THEN 1.0 ELSE 0.0 END AS reasoning_gate, CASE WHEN gated AND ok THEN 1.0 ELSE 0.0 END AS reasoning_gate_applied,
      CASE WHEN gated AND ok AND NOT need THEN 1.0 ELSE 0.0 END AS reasoning_malformed, CASE WHEN need THEN j / 10.0 ELSE 0.0 END AS reasoning_unclear_probability FROM o"""
)
def reasoning_gate(spark, d):
    """By event_id % 7: another source, a wrong answer, no thinking, and right answers with five different judge's options."""
    k, j, i = F.col("event_id") % 7, F.col("event_id") % 5, F.col("event_id").cast("string")
    think = F.concat(F.lit("<think>First. Case "), j.cast("string"), F.lit(" holds.</think>"))
    said = F.when(k == 1, '{"answer": "B"}').otherwise('{"answer": "(a)"}')
    rows = _t(spark, d, "events").select("event_id", F.when(k == 0, "boxes").otherwise("gated").alias("source"), F.when(k == 2, said).otherwise(F.concat(think, said)).alias("solution"), F.lit('{"answer": "A"}').alias("truth"), F.when(k == 0, F.concat(F.lit("no options "), i)).otherwise("Q\nA. stable\nB. changed").alias("prompt"))
    option = F.when(F.col("j") == 0, " u").when(F.col("j") < 3, "A").otherwise("b")
    judge = spark.range(5).select(F.col("id").alias("j")).select(F.concat(F.lit("Case "), F.col("j").cast("string"), F.lit(" holds.")).alias("sentence"), F.lit("stable").alias("option_a"), F.lit("changed").alias("option_b"), option.alias("option"), (F.col("j") / 10).alias("unclear"))
    got = scoring.reasoning_gate(rows, "event_id", "source", "solution", "truth", "prompt", F.lit(0.25), judge, {"gated"})
    return got.select("event_id", *(_r(c).alias(c) for c in got.columns[1:]))


_KIND_SQL = """WITH e AS (SELECT event_id, event_id % 4 AS k, event_id % 3 AS j, event_id % 2 AS a FROM events),
  p AS (SELECT *, CASE WHEN a = 0 THEN 1.0 ELSE 0.0 END AS c, CASE WHEN j = 0 THEN 1.0 ELSE 25 / 175.0 END AS iou, CASE WHEN j = 2 THEN 0.0 ELSE 0.5 END AS r4 FROM e)"""


@query(
    _KIND_SQL
    + """ SELECT event_id, CASE WHEN k = 0 THEN c WHEN k = 2 THEN c END AS C, round(CASE k WHEN 1 THEN iou WHEN 2 THEN iou WHEN 3 THEN iou END, 4) AS R2, round(CASE WHEN k >= 2 THEN iou END, 4) AS R3, CASE WHEN k >= 2 THEN r4 END AS R4,
    round(CASE k WHEN 0 THEN c WHEN 1 THEN iou WHEN 2 THEN c * (0.1 + 0.25 * iou + 0.25 * iou + 0.4 * r4) ELSE 0.25 * iou + 0.25 * iou + 0.5 * r4 END, 4) + 0.0 AS reward FROM p"""
)
def decomposed_scores(spark, d):
    """Four kinds of sources, in two phases: what needs no judge, then the judge's score of the pairs that need it, each once."""
    k, j, a = F.col("event_id") % 4, F.col("event_id") % 3, F.col("event_id") % 2
    box = F.when(j == 0, "[0, 0, 10, 10]").otherwise("[5, 5, 15, 15]")
    entry = lambda b: F.when(k == 1, b).otherwise(F.concat(F.lit('{"bbox": '), b, F.lit(', "label": "add"}')))
    text = lambda answer, b, s: F.concat(F.lit('{"answer": "'), answer, F.lit('", "summary": "'), s, F.lit('", "boxes": ['), entry(b), F.lit("]}"))
    rows = _t(spark, d, "events").select("event_id", F.concat(F.lit("s"), k.cast("string")).alias("source"), text(F.when(a == 0, "(A)").otherwise("b"), box, F.when(j == 2, " ").otherwise("near")).alias("solution"), text(F.lit("A"), F.lit("[0, 0, 10, 10]"), F.lit("wanted")).alias("truth"))
    first = scoring.deferred(rows, "source", "solution", "truth", {"s0": "answer", "s1": "hungarian", "s2": "consistency", "s3": "detection"})
    pairs = first.select("given", "wanted").where("given IS NOT NULL").distinct().select(F.col("given").alias("prediction"), F.col("wanted").alias("truth"), F.array(*map(F.lit, (0.25, 0.25, 0.5, 0.0))).alias("probabilities"))
    told = scoring.with_judge(first.drop("truth"), "given", "wanted", pairs)
    got = scoring.decomposed(told, F.col("judged"))
    return got.select("event_id", *(_r(c).alias(c) for c in ("C", "R2", "R3", "R4", "reward")))


@query("SELECT event_id, (event_id % 3 = 0)::INT::DOUBLE AS C, CASE WHEN event_id % 2 = 1 THEN 0.5 END AS R4 FROM events")
def answers_and_summaries(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, "both").otherwise("answer").alias("source"))
    got = scoring.answer_and_summary(rows, "source", (F.col("event_id") % 3 == 0).cast("double"), F.lit(0.5), {"answer"}, {"both"}, {"boxes"})
    return got.select("event_id", "C", "R4")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.55 END AS judged FROM events")
def judged_pairs(spark, d):
    """Blank and equal summaries need no judge; each other pair meets it once."""
    k = F.col("event_id") % 4
    rows = _t(spark, d, "events").select("event_id", F.when(k == 0, " ").when(k == 1, "Same").otherwise("near").alias("p"), F.when(k == 1, "same").otherwise("far").alias("t"))
    judge = spark.createDataFrame([("near", "far", [0.4, 0.2, 0.2, 0.2])], "prediction string, truth string, probabilities array<double>")
    return scoring.with_judge(rows, "p", "t", judge).select("event_id", _r("judged").alias("judged"))


@query("SELECT event_id, event_id % 3 <> 2 AND event_id % 4 IN (1, 3) AND (event_id % 3 = 0) <> (event_id % 4 = 1) AS raw_conflict, event_id % 3 <> 2 AND event_id % 4 IN (1, 3) AND (event_id % 3 = 0) <> (event_id % 4 = 1) AND (event_id % 10) / 10.0 >= 0.5 AS conflict FROM events")
def conflict_labels(spark, d):
    e = F.col("event_id")
    rows = _t(spark, d, "events").select("event_id", F.when(e % 3 == 0, "A").when(e % 3 == 1, "B").otherwise(F.lit(None)).alias("stated"), F.when(e % 4 == 1, "A").when(e % 4 == 3, "B").when(e % 4 == 0, "U").alias("supported"), ((e % 10) / 10).alias("confidence"))
    got = scoring.conflicts(rows.na.fill({"stated": "none"}), "stated", "supported", "confidence", 0.5)
    return got.select("event_id", *((F.col(c) & (F.col("stated") != "none")).alias(c) for c in ("raw_conflict", "conflict")))


@query("SELECT event_id, (event_id % 10) / 10.0 AS confidence FROM events WHERE event_id % 3 = 0 ORDER BY confidence DESC, event_id LIMIT 15")
def highest_conflicts(spark, d):
    rows = _t(spark, d, "events").select("event_id", (F.col("event_id") % 3 == 0).alias("conflict"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return filters.top_conflicts(rows, "conflict", "confidence", 15, ["event_id"]).select("event_id", "confidence")


@query("SELECT event_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 4) AS first, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS best FROM (SELECT event_id, -(event_id % 7) / 2.0 AS a, -(event_id % 5) / 2.0 AS b, -(event_id % 3) / 2.0 AS c FROM events)")
def option_support(spark, d):
    e = F.col("event_id")
    rows = _t(spark, d, "events").select("event_id", F.array(*(-(e % m) / 2 for m in (7, 5, 3))).alias("x"))
    p = sequences.softmax_of(F.col("x"))
    return rows.select("event_id", _r(p[0]).alias("first"), sequences.first_argmax(F.col("x")).alias("best"))


@query("SELECT event_id, round(CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE sqrt(event_id % 50) END, 12) AS score, CASE event_id % 50 WHEN 0 THEN 'ValueError: zero' END AS failure FROM events")
def guarded_scores(spark, d):
    """A scoring function that raises costs its own row the default alone."""

    def score(x):
        if x == 0:
            raise ValueError("zero")
        return x**0.5

    rows = _t(spark, d, "events").select("event_id", (F.col("event_id") % 50).alias("x"))
    return scoring.guarded(rows, ["x"], score, 20.0).select("event_id", _r("score", 12).alias("score"), "failure")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 3 * 0.5 ELSE CASE event_id % 3 WHEN 1 THEN 1.0 ELSE 0.0 END END AS score FROM events")
def split_judged(spark, d):
    e = F.col("event_id")
    rows = _t(spark, d, "events").select("event_id", F.when(e % 2 == 0, "test").otherwise("train").alias("split"), (e % 3 * 0.5).alias("rule"), F.when(e % 3 == 0, F.lit(None).cast("string")).when(e % 3 == 1, "so \\boxed{True}").otherwise("so \\boxed{False}").alias("response"))
    return scoring.judged_by_split(rows, "split", F.col("rule"), F.col("response")).select("event_id", "score")


@query("SELECT event_id, (value > 10)::INT::DOUBLE AS score FROM events")
def custom_reward(spark, d):
    """A function of a file, registered under a name and found by it; scorers and estimators are looked up likewise."""
    name = "over_ten"
    if name not in SCORERS:
        SCORERS.register(name)(lambda solution, truth: (solution > truth).cast("double"))
    rows = _t(spark, d, "events").select("event_id", "value", F.lit(10).alias("t"))
    return scoring.REWARDS.resolve("naive")(rows, name, "value", "t").select("event_id", "score")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'empty cot' WHEN 2 THEN 'answer should be the other' WHEN 3 THEN 'object count mismatch' ELSE 'box y mismatch' END AS fault FROM events")
def output_faults(spark, d):
    k = F.col("event_id") % 5
    box = lambda y: F.struct(F.lit(1).alias("x"), y.alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h"))
    one = lambda y: F.struct(box(y).alias("box"), F.lit("a red ball").alias("description"))
    objects = F.when(k == 3, F.array(one(F.lit(2)), one(F.lit(2)))).when(k == 4, F.array(one(F.lit(9)))).otherwise(F.array(one(F.lit(2))))
    out = F.struct(F.when(k == 2, "consistent").otherwise("Inconsistent ").alias("answer"), F.when(k == 1, " ").otherwise("cot").alias("cot"), F.lit("sum").alias("summary"), objects.alias("objects"))
    rows = _t(spark, d, "events").select("event_id", out.alias("o"), F.array(one(F.lit(2))).alias("i"))
    return rows.select("event_id", scoring.output_fault(F.col("o"), F.col("i"), F.lit(False), F.lit(""), ("moves",), ("annotation",)).alias("fault"))


@query("SELECT conv_id, round(greatest(-1, least(1, avg(turn) * 0.1)) + greatest(-1, least(1, avg(length(coalesce(text, ''))) * 0.01)), 4) AS reward FROM conversations GROUP BY 1")
def weighted_metrics(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", F.explode(F.array(F.struct(F.lit("turn").alias("metric"), F.col("turn").cast("double").alias("v")), F.struct(F.lit("size").alias("metric"), F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("v")))).alias("m")).select("conv_id", "m.*")
    return scoring.multi_metric(rows, "conv_id", "metric", "v", {"turn": 0.1, "size": 0.01}).select("conv_id", _r("reward").alias("reward"))


@query("SELECT o_orderkey, round(coalesce(avg((l_quantity > 25)::INT), 0), 4) AS score FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber < 3) ON o_orderkey = l_orderkey GROUP BY 1")
def scores_of_tests(spark, d):
    """A results table of tests: the share of the first ones that pass."""
    results = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("test"), (F.col("l_quantity") > 25).alias("passed"))
    return scoring.from_results(_t(spark, d, "orders").select("o_orderkey").distinct(), results, "o_orderkey", 3).select("o_orderkey", _r("score").alias("score"))


# Joins.


@query("SELECT 1 AS one, count(item_id) AS matched, count(*) - count(item_id) AS unmatched FROM (SELECT doc_id % 100 AS k FROM documents) LEFT JOIN (SELECT item_id FROM benchmark) ON k = item_id")
def matched_counts(spark, d):
    traced = _t(spark, d, "documents").select((F.col("doc_id") % 100).alias("k")).join(_t(spark, d, "benchmark").select("item_id"), F.col("k") == F.col("item_id"), "left").withColumn("one", F.lit(1))
    return matching.match_counts(traced, "item_id", ["one"])


@query("SELECT l.doc_id FROM labels l LEFT JOIN (SELECT doc_id, doc_id % 2 AS p FROM documents WHERE doc_id % 3 <> 0) d USING (doc_id) WHERE d.doc_id IS NULL OR l.quality IS DISTINCT FROM d.p")
def incompatible_records(spark, d):
    done = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("p"))
    return matching.compatible(done, _t(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", (F.col("doc_id") % 2).alias("p")), "doc_id", ["p"]).select("doc_id")


@query(
    """WITH k AS (SELECT n_nationkey AS id FROM nation), r AS (SELECT id, unnest(['a', 'b', 'c']) AS run FROM k)
    SELECT id, run, CASE WHEN run = 'b' AND id % 5 = 0 THEN 'missing' WHEN run = 'c' AND id % 7 = 1 THEN 'repeated' ELSE 'differs' END AS fault FROM r WHERE (run = 'b' AND (id % 5 = 0 OR id % 6 = 1)) OR (run = 'c' AND id % 7 = 1)"""
)
def aligned_runs(spark, d):
    """Three runs: one lacks rows and has others, one repeats some."""
    a = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"), (F.col("n_nationkey") * 10).alias("order"))
    b = a.where("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 6 == 1, "other").otherwise(F.col("text")))
    c = a.unionAll(a.where("id % 7 = 1"))
    return matching.aligned({"a": a, "b": b, "c": c}, "id", ["text"], "order")


@query("SELECT doc_id, item_id, CASE WHEN item_id IS NOT NULL THEN 'set' || (item_id % 3) END AS source FROM (SELECT doc_id, doc_id % 60 AS k FROM documents) LEFT JOIN benchmark ON k = item_id")
def traced_sources(spark, d):
    """A record that is traced back takes over its source's name."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("key of item number "), (F.col("doc_id") % 60).cast("string"), F.lit(" and end")).alias("k"))
    items = _t(spark, d, "benchmark").select("item_id", F.concat(F.lit("key of item number "), F.col("item_id").cast("string"), F.lit(" and end")).alias("k"), F.concat(F.lit("set"), (F.col("item_id") % 3).cast("string")).alias("name"))
    return matching.trace_back(docs, items, "doc_id", "k", "k", "item_id", override={"name": "source"})


# Advantages, losses and sequences.


@query("SELECT event_id, round(value - (1.0 + user_id % 3) / (3.0 + user_id % 3), 6) + 0.0 AS advantage, round(0.5 * (1 + user_id % 3) + sum(value) OVER w, 3) + 0.0 AS next_alpha, round(1.0 + sum(1 - value) OVER w, 3) + 0.0 AS next_beta FROM (SELECT event_id, user_id, value / 1000 AS value FROM events) WINDOW w AS (PARTITION BY user_id)")
def smoothed_baseline(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", (F.col("value") / 1000).alias("score"), (1.0 + F.col("user_id") % 3).alias("a"), F.lit(2.0).alias("b"))
    got = adv.beta_baseline(rows, "user_id", "score", 0.5, "a", "b")
    return got.select("event_id", _r("advantage", 6).alias("advantage"), _r("next_alpha", 3).alias("next_alpha"), _r("next_beta", 3).alias("next_beta"))


@query("SELECT x AS step, round(2.0 * (1 + greatest(-0.2, least(0.2, x * 0.01 / 0.05 - 1)) * 10 / 100.0), 6) AS value FROM (SELECT unnest(range(10)) AS x)")
def controlled_weights(spark, d):
    return spark.createDataFrame([(x, round(adv.kl_controller(2.0, x * 0.01, 0.05, 10, 100), 6)) for x in range(10)], "step long, value double")


_TOK = """(SELECT event_id, user_id AS seq, ln(0.05 + (event_id % 97) / 120.0) AS logp, ln(0.05 + (event_id % 89) / 110.0) AS old_logp, ln(0.05 + (event_id % 83) / 100.0) AS rollout_logp, (event_id % 11) - 5.0 AS advantage, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS mask FROM events)"""


def _tokens(spark, d) -> DataFrame:
    from .catalog import _tokens as tokens

    return tokens(spark, d)


def _ln(x):
    """The C library's logarithm. Spark's may be a last place off, which decides for ratios that lie on a bound."""

    def run(x: pa.Array) -> pa.Array:
        return pc.ln(x)

    return F.arrow_udf(run, "double")(x)


@query(f"SELECT event_id, round(least(exp(least(greatest(old_logp - rollout_logp, -20), 20)) * mask, 2), 4) AS weight, CASE WHEN abs(old_logp - rollout_logp) <= ln(2.5) THEN mask ELSE 0 END AS kept FROM {_TOK}")
def corrected_tokens(spark, d):
    """Weights and rejection together."""
    e = F.col("event_id")
    tokens = _tokens(spark, d).withColumns({"old_logp": _ln(0.05 + (e % 89) / 110.0), "rollout_logp": _ln(0.05 + (e % 83) / 100.0)})
    got = correction.correct(tokens, None, {"token_k1": 2.5})
    return got.select("event_id", _r("weight").alias("weight"), "kept")


@query("SELECT event_id, round(greatest(x, 0) - x * (event_id % 2) + ln(1 + exp(-abs(x))), 4) + 0.0 AS loss FROM (SELECT event_id, 0.5 * (event_id % 9 - 4) AS x FROM events)")
def cross_entropy_losses(spark, d):
    e = F.col("event_id")
    return _t(spark, d, "events").select("event_id", _r(losses.cross_entropy_preference(e % 9 - 4, e % 2, 0.5)).alias("loss"))


@query(
    """WITH t AS (SELECT event_id, user_id AS g, (event_id % 9) - 4.0 AS q, event_id % 2 AS y FROM events),
    o AS (SELECT a.event_id, a.g, a.q, a.y, 0.3 * coalesce((SELECT avg(b.q) FROM t b WHERE b.g = a.g AND CASE WHEN a.y > 0 THEN b.y < a.y ELSE b.y > a.y END), 0) AS other,
      count(*) OVER (PARTITION BY g) AS n, (SELECT count(*) FROM t b WHERE b.g = a.g AND b.y <= a.y) AS under FROM t a),
    x AS (SELECT *, (0.3 * q - other) * CASE WHEN y > 0 THEN 1 ELSE -1 END AS x FROM o), l AS (SELECT *, greatest(-x, 0) + ln(1 + exp(-abs(x))) AS l FROM x)
    SELECT event_id, round(l, 4) + 0.0 AS loss, round(l * n * pow(under / n, n - 1), 4) + 0.0 AS weighted FROM l"""
)
def detached_losses(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.col("user_id").alias("g"), (F.col("event_id") % 9 - 4.0).alias("q"), (F.col("event_id") % 2).alias("y"))
    a = losses.detached_preference(rows, "g", "q", "y", 0.3)
    b = losses.detached_preference(rows, "g", "q", "y", 0.3, "bon_acc").select("event_id", F.col("loss").alias("weighted"))
    return a.join(b, "event_id").select("event_id", _r("loss").alias("loss"), _r("weighted").alias("weighted"))


@query(
    """WITH t AS (SELECT event_type AS g, user_id AS r, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i, value AS x, -value / 100 AS lp, (event_id % 3 > 0)::INT AS m FROM events),
    s AS (SELECT *, CASE WHEN m > 0 THEN sum(m) OVER (PARTITION BY g, r ORDER BY i) END AS slot, sum(x * m) OVER (PARTITION BY g, r ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS ret, sum((1 - 2 * exp(lp) + 0.5) * m) OVER (PARTITION BY g, r ORDER BY i ROWS UNBOUNDED PRECEDING) AS path FROM t),
    b AS (SELECT *, sum(ret * path * m) OVER w / (sum(path * m) OVER w + 1e-8) AS base, sum(m) OVER w AS n FROM s WINDOW w AS (PARTITION BY g, slot)), c AS (SELECT g, count(DISTINCT r) AS rows FROM t GROUP BY g)
    SELECT event_id, round((ret - CASE WHEN rows > 1 AND n > 1 THEN base ELSE 0 END) * m, 3) + 0.0 AS advantage FROM b JOIN c USING (g)"""
)
def compact_token_baseline(spark, d):
    """Masked-in tokens are counted alone: responses of several turns."""
    rows = _t(spark, d, "events").select("event_id", F.col("event_type").alias("g"), F.col("user_id").alias("r"), F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")).alias("t"), "value", (F.col("event_id") % 3 > 0).cast("int").alias("mask"), (-F.col("value") / 100).alias("lp"), F.lit(0.5).alias("sp"))
    return adv.optimal_token_baseline(rows, "g", "r", "t", "value", "mask", "lp", "sp", compact=True).select("event_id", _r("advantage", 3).alias("advantage"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, value / 50 AS r, value / 100 AS v, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events),
    f AS (SELECT *, (r - v) * m AS s, v * m AS nv FROM o WHERE k = 1 UNION ALL
      SELECT o.*, (o.r + 0.9 * f.nv - o.v + 0.9 * 0.8 * f.s) * o.m + (1 - o.m) * f.s, o.v * o.m + (1 - o.m) * f.nv FROM o JOIN f ON o.user_id = f.user_id AND o.k = f.k + 1),
    n AS (SELECT avg(s) AS a, var_samp(s) AS b FROM f WHERE m <> 0) SELECT user_id, event_id, round((s - a) / sqrt(b + 1e-8), 4) + 0.0 AS advantage, round(s + v, 4) + 0.0 AS ret FROM f, n"""
)
def whitened_gae(spark, d):
    rows = _t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    rows = rows.select("user_id", F.col("x.event_id").alias("ids"), F.transform("x", lambda x: x["value"] / 50).alias("r"), F.transform("x", lambda x: x["value"] / 100).alias("v"), F.transform("x", lambda x: F.when(x["event_id"] % 5 == 0, 0).otherwise(1)).alias("m"))
    got = sequences.gae_whitened(rows, "r", "v", "m", 0.9, 0.8)
    each = got.select("user_id", F.explode(F.arrays_zip("ids", "advantages", "returns")).alias("z"))
    return each.select("user_id", F.col("z.ids").alias("event_id"), _r("z.advantages").alias("advantage"), _r("z.returns").alias("ret"))


# Metrics.


@query("SELECT section, seconds, round(seconds * 1000 / CASE section WHEN 'gen' THEN r ELSE p + r END, 6) AS ms_per_token, round((p + r) / (seconds * 4), 4) AS throughput FROM (SELECT unnest(['gen', 'ref', 'update']) AS section, unnest([1.5, 0.5, 2.0]) AS seconds), (SELECT sum(l_linenumber) AS p, sum(l_quantity) AS r FROM lineitem)")
def timings(spark, d):
    tokens = _t(spark, d, "lineitem").agg(F.sum("l_linenumber").alias("prompt_tokens"), F.sum("l_quantity").alias("response_tokens"))
    times = spark.createDataFrame([("gen", 1.5), ("ref", 0.5), ("update", 2.0)], "section string, seconds double")
    got = metrics.timing_metrics(times, tokens).crossJoin(F.broadcast(tokens))
    return got.select("section", "seconds", _r("ms_per_token", 6).alias("ms_per_token"), _r(metrics.throughput(F.col("prompt_tokens") + F.col("response_tokens"), F.col("seconds"), 4)).alias("throughput"))


@query(f"WITH s AS (SELECT seq, avg(advantage) AS a, sum(exp(logp)) AS w FROM {_TOK} WHERE mask <> 0 GROUP BY seq) SELECT round(avg(a * a * w), 4) AS proxy, round(avg(w), 4) AS expected_w, round(avg(a * a), 4) AS expected_a2, round(greatest(9 - avg(a * a * w), 0), 4) AS signal FROM s")
def variance_proxies(spark, d):
    got = metrics.variance_proxies(_tokens(spark, d).withColumn("w", F.exp("logp")), "advantage", "w", "seq", "mask", 3.0)
    return got.select(*(_r(c).alias(c) for c in got.columns))


@query("SELECT round(avg(CASE WHEN d > 0 THEN a / d ELSE 0 END), 4) AS accept_rate, round(avg(CASE WHEN v > 0 THEN a / v ELSE 0 END), 4) AS accept_length FROM (SELECT event_id % 4 AS d, event_id % 3 AS a, event_id % 5 AS v FROM events)")
def draft_metrics(spark, d):
    e = F.col("event_id")
    got = metrics.ratio_means(_t(spark, d, "events").select((e % 4).alias("d"), (e % 3).alias("a"), (e % 5).alias("v")), "d", "a", "v")
    return got.select(*(_r(c).alias(c) for c in got.columns))


@query("SELECT event_type, round(avg((value + user_id) / 2), 4) AS score FROM events GROUP BY 1")
def scores_by_source(spark, d):
    return metrics.mean_of_means(_t(spark, d, "events").select("event_type", F.array("value", F.col("user_id").cast("double")).alias("s")), "event_type", "s").select("event_type", _r("score").alias("score"))


@query("WITH c AS (SELECT event_type, count(*) AS rows, count(*) FILTER (value > 10) AS high, count(*) FILTER (user_id % 2 = 0) AS even FROM events GROUP BY 1) SELECT * FROM c UNION ALL SELECT NULL, sum(rows)::BIGINT, sum(high)::BIGINT, sum(even)::BIGINT FROM c")
def file_counters(spark, d):
    return metrics.file_counts(_t(spark, d, "events"), "event_type", {"high": F.col("value") > 10, "even": F.col("user_id") % 2 == 0})


@query("SELECT user_id, least(count(*), 5) AS kept, count(*) AS n FROM events GROUP BY 1")
def merged_scores(spark, d):
    return metrics.merge_scores(_t(spark, d, "events"), "user_id", "value", 5, "event_id").select("user_id", F.size("scores").cast("long").alias("kept"), "n")


@query("WITH a AS (SELECT l_suppkey % 8 AS p, sum(l_quantity) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_partkey % 8 AS p, sum(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT (SELECT max(s) - min(s) FROM a) AS before_spread, (SELECT max(s) - min(s) FROM b) AS after_spread, (SELECT max(s) FROM a) AS before_max, (SELECT max(s) FROM b) AS after_max")
def imbalance_before_and_after(spark, d):
    rows = _t(spark, d, "lineitem").withColumns({"p": F.col("l_suppkey") % 8, "q": F.col("l_partkey") % 8})
    return metrics.imbalance_change(rows, "p", "q", "l_quantity").select("before_spread", "after_spread", "before_max", "after_max")


@query("WITH g AS (SELECT unnest(range(2)) AS layer, unnest(range(4)) AS x), t AS (SELECT event_id, unnest(range(3)) AS i FROM events), u AS (SELECT event_id, i, unnest(range(2)) AS layer FROM t WHERE i < 2), c AS (SELECT layer, (event_id + i + layer) % 4 AS bucket FROM u WHERE i = 0) SELECT l.layer::INT AS layer, b.bucket::INT AS bucket, count(c.bucket) AS c FROM (SELECT unnest(range(2)) AS layer) l CROSS JOIN (SELECT unnest(range(4)) AS bucket) b LEFT JOIN c ON c.layer = l.layer AND c.bucket = b.bucket GROUP BY ALL")
def expert_loads(spark, d):
    """Three tokens, two layers, one expert each; the mask leaves the third out, and the last masked-in one doesn't count."""
    expert = lambda i, k: F.array(((F.col("event_id") + i + k) % 4).cast("int"))
    layers = F.array(*(F.array(*(expert(i, k) for k in range(2))) for i in range(3)))
    rows = _t(spark, d, "events").select(layers.alias("layers"), F.array(*map(F.lit, (1, 1, 0))).alias("mask"))
    return metrics.expert_loads(rows, "layers", "mask", 4)


@query(
    """WITH p AS (SELECT event_type, user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, 'value' AS variable, 'mean@' || n AS metric, round(avg(m), 6) AS value FROM p GROUP BY ALL"""
)
def resampled_means(spark, d):
    """The means of the resampled tree; its resamples follow NumPy's stream and are tested against it."""
    got = metrics.resampled_tree(_t(spark, d, "events").withColumn("vote", F.col("event_id") % 3), "event_type", "user_id", ["value"], "event_id", "vote", 50)
    return got.where("metric LIKE 'mean@%'").select("event_type", "variable", "metric", _r("value", 6).alias("value"))


# Shapes, filters and packing.


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders")
def batched(spark, d):
    return shapes.batches(shapes.with_position(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]), 64).select("o_orderkey", "batch")


@query("SELECT n_nationkey, (24 - n_nationkey)::BIGINT AS new_pos, n_nationkey::BIGINT AS back FROM nation")
def reordered(spark, d):
    rows = _t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("pos"))
    way = rows.select("pos", (24 - F.col("pos")).alias("new_pos"))
    there = shapes.reorder(rows, way).select("n_nationkey", F.col("new_pos").alias("pos"))
    back = shapes.reorder(there, shapes.inverse_permutation(way))
    return back.select("n_nationkey", F.col("pos").alias("new_pos"), F.col("new_pos").alias("back"))


@query("SELECT n_nationkey AS key, n_name, n_regionkey AS region, (n_nationkey // 7)::INT AS split FROM nation WHERE n_nationkey IN (3, 9, 24) UNION ALL SELECT n_nationkey, n_name, n_regionkey, (n_nationkey // 7)::INT FROM nation WHERE n_nationkey = 3")
def selected_and_renamed(spark, d):
    """Columns popped, joined again, renamed; rows selected by number, one twice; split into pieces of seven."""
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    popped, rest = shapes.pop(n, ["n_regionkey"], "n_nationkey")
    whole = shapes.rename(rest.join(popped, "n_nationkey"), {"n_regionkey": "region", "n_nationkey": "key"})
    picked = shapes.select_rows(whole.withColumn("pos", F.col("key").cast("long")), spark.createDataFrame([(3,), (9,), (24,), (3,)], "pos long"))
    return shapes.split(picked, 7).select("key", "n_name", "region", "split")


@query("SELECT n_nationkey AS k, n_name AS name, NULL::BIGINT AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey * 2 FROM region")
def concatenated(spark, d):
    a = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    b = _t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 2).cast("long").alias("extra"))
    both, notes = shapes.concat([a.where("k < 10"), a.where("k >= 10")], [{"step": 1}, {"step": 1, "more": 2}])
    assert notes == {"step": 1, "more": 2}
    return shapes.concat_ragged([both, b])


@query("SELECT n_nationkey, n_nationkey // 5 AS slot, (n_nationkey % 5)::INT AS i FROM nation")
def unfolded(spark, d):
    folded = shapes.fold(_t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").alias("at")), ["n_nationkey"], 5, "at")
    return shapes.unfold(folded, ["n_nationkey"]).select("n_nationkey", "slot", "i")


@query("SELECT uid, session, prompt_ids, response_ids, reward, is_padding FROM (SELECT 'u' || n_nationkey AS uid, n_nationkey::BIGINT AS session, n_nationkey || ',9' AS prompt_ids, '1,2' AS response_ids, 1.0 AS reward, false AS is_padding FROM nation UNION ALL SELECT 'pad', i, '7', '7', 0.0, true FROM (SELECT unnest(range(7)) AS i))")
def padded_with_empty(spark, d):
    k = F.col("n_nationkey")
    rows = _t(spark, d, "nation").select(F.concat(F.lit("u"), k.cast("string")).alias("uid"), k.cast("long").alias("session"), F.array(k.cast("long"), F.lit(9).cast("long")).alias("prompt_ids"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("response_ids"), F.lit(1.0).alias("reward"))
    got = shapes.pad_with_empty(rows, 32, 25, 7, zero=("reward",))
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return got.select("uid", "session", told("prompt_ids"), told("response_ids"), "reward", "is_padding")


@query("SELECT e AS epoch, b AS batch, CASE WHEN b < n // 100 THEN 100 ELSE n % 100 END AS n FROM (SELECT count(*) AS n FROM orders), (SELECT unnest(range(2))::INT AS e), (SELECT unnest(range(100000))::INT AS b) WHERE b < n // 100 OR (b = n // 100 AND n % 100 > 0)")
def minibatch_sizes(spark, d):
    """Batches of each epoch have exactly their size, but for the last."""
    return shapes.minibatches(_t(spark, d, "orders").select("o_orderkey"), 100, 2, 3, "o_orderkey").groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey // 10 AS slot, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys, string_agg((n_nationkey % 4)::VARCHAR, ',' ORDER BY n_nationkey) AS lengths, count(*) * 3 AS cells FROM nation GROUP BY 1")
def collated(spark, d):
    k = F.col("n_nationkey")
    rows = _t(spark, d, "nation").select(k.cast("long").alias("pos"), k.alias("key"), F.slice(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.lit(1), (k % 4).cast("int")).alias("ids"))
    got = shapes.collated(rows, ["key"], ["ids"], 10)
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return got.select("slot", told("key").alias("keys"), told("ids_lengths").alias("lengths"), F.aggregate("ids", F.lit(0), lambda a, x: a + F.size(x)).cast("long").alias("cells"))


@query("SELECT n_nationkey, w::INT AS worker FROM (SELECT n_nationkey, ntile(2) OVER (ORDER BY n_nationkey) - 1 AS c FROM nation) JOIN (SELECT unnest([0, 0, 1, 1]) AS r, unnest(range(4)) AS w) ON r = c WHERE w IN (0, 2)")
def dealt_by_rank(spark, d):
    """Two chunks to four workers of two ranks; the leaders' copies are collected."""
    rows = shapes.dealt_by_rank(_t(spark, d, "nation").select("n_nationkey"), [0, 0, 1, 1], 2, F.lit(25), "n_nationkey")
    return shapes.collected_by_rank(rows, [0, 0, 1, 1], [0, 2]).select("n_nationkey", "worker")


@query("SELECT n_nationkey, 'left' AS side FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 100 + n_nationkey, 'right' FROM nation WHERE n_nationkey < 2")
def frame_differences(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return shapes.differences(n, n.where("n_nationkey >= 3").unionAll(n.where("n_nationkey < 2").select(F.col("n_nationkey") + 100)))


@query("SELECT doc_id FROM documents WHERE n_chars // 4 <= 400")
def short_prompts(spark, d):
    from ..sources import prompt_length_filter

    return prompt_length_filter(_t(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("tokens")), F.col("tokens"), 400).select("doc_id")


@query("SELECT o_custkey, count(*) AS rows, sum(round(o_totalprice)::BIGINT % 1000 + 1)::BIGINT AS load, true AS fits FROM orders GROUP BY 1")
def packing_methods(spark, d):
    """Four ways of packing a customer's orders: every one deals out all loads, and keeps what it promises."""
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", (F.expr("CAST(round(o_totalprice) AS BIGINT)") % 1000 + 1).alias("load"))
    ways = {"heap": lambda x: packing.largest_first(x, 3), "greedy": lambda x: packing.greedy(x, 3), "kk": lambda x: packing.differencing(x, 3), "budget": lambda x: packing.micro_batches(x, 1500)}
    dealt = packing.partition(rows, ["o_custkey"], "o_orderkey", "load", ways)
    told = dealt.select("o_custkey", "load", F.explode(F.array(*(F.struct(F.lit(name).alias("way"), F.col(name).alias("part")) for name in ways))).alias("_p")).select("o_custkey", "load", "_p.*")
    parts = told.groupBy("o_custkey", "way", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("s"), F.max("load").alias("big"))
    even = (F.max("s") - F.min("s") <= F.max("big")) | (F.count(F.lit(1)) < 3)
    fits = F.when(F.col("way").isin("heap", "kk"), even).when(F.col("way") == "budget", F.max("s") <= 1500).otherwise(F.max("part") < 3)
    each = parts.groupBy("o_custkey", "way").agg(F.sum("n").alias("rows"), F.sum("s").alias("load"), fits.alias("fits"))
    return each.groupBy("o_custkey").agg(F.max("rows").alias("rows"), F.max("load").alias("load"), (F.bool_and("fits") & (F.min("load") == F.max("load")) & (F.count(F.lit(1)) == 4)).alias("fits"))


# Life-cycles and queues.


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id DESC) > 30 AS dropped FROM events")
def bounded_queue(spark, d):
    return lifecycle.drop_oldest(_t(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 30).select("event_id", "dropped")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 1000 + event_id / 7.0 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 1000 + event_id / 7.0, event_id) AS k FROM events),
    f AS (SELECT *, 1 AS n, ts AS first, 0::BIGINT AS batch FROM e WHERE k = 1 UNION ALL
      SELECT e.*, CASE WHEN f.n >= 4 OR e.ts - f.first >= 60 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 4 OR e.ts - f.first >= 60 THEN e.ts ELSE f.first END, CASE WHEN f.n >= 4 OR e.ts - f.first >= 60 THEN f.batch + 1 ELSE f.batch END FROM e JOIN f ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, event_id, batch FROM f"""
)
def served_batches(spark, d):
    """A batch ends at four rows, or 60 after its first."""
    rows = _t(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 1000 + F.col("event_id") / 7).alias("at"))
    return lifecycle.count_or_time(rows, "user_id", "at", ["event_id"], 4, 60.0).select("user_id", "event_id", "batch")


@query("SELECT round(avg(b - a), 4) AS span_mean, max(b - a) AS span_max, min(b - a) AS span_min, round(avg(5000 - b), 4) AS age_mean, max(5000 - b) AS age_max, min(5000 - b) AS age_min FROM (SELECT min(event_id) AS a, max(event_id) AS b FROM events GROUP BY user_id)")
def version_spans(spark, d):
    rows = _t(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    got = lifecycle.staleness_metrics(rows, "a", "b", F.lit(5000))
    return got.select(*(_r(c).alias(c) if c.endswith("mean") else F.col(c) for c in got.columns))


def _events(spark, d) -> DataFrame:
    from .catalog import _events as events

    return events(spark, d)


_STATES = """e AS (SELECT user_id::VARCHAR AS uid, event_id % 4 AS session, CASE WHEN event_id % 10 = 9 THEN 'failure' WHEN event_id % 10 >= 2 THEN 'finished' ELSE 'running' END AS status, event_id // 100 AS step, event_id AS seq, floor(value / 50) AS m FROM events),
    l AS (SELECT uid, session, arg_max(status, seq) AS status, arg_max(m, seq) AS m, min(step) AS born FROM e GROUP BY ALL),
    g AS (SELECT uid, count(*) AS n, count(*) FILTER (status IN ('finished', 'failure')) >= 3 AS ended, bool_or(status = 'failure') AS failed, min(born) AS born, min(m) FILTER (status = 'finished') AS lo, max(m) FILTER (status = 'finished') AS hi FROM l GROUP BY uid),
    t AS (SELECT *, CASE WHEN NOT ended THEN NULL WHEN 100 - born + 1 > 99 THEN 'stale' WHEN failed THEN 'failed' WHEN n > 1 AND lo = hi THEN 'constant' END AS reason FROM g)"""


@query(f"WITH {_STATES} SELECT count(*) AS evicted, count(*) FILTER (reason = 'stale') AS stale, count(*) FILTER (reason = 'failed') AS failed, count(*) FILTER (reason = 'constant') AS constant, count(*) AS refill FROM t WHERE reason IS NOT NULL")
def eviction_counts(spark, d):
    """The buffer that asks for as many groups as it evicts."""
    return lifecycle.sample_groups(lifecycle.group_states(_events(spark, d), 3), 100, 4, 99, refill=1)[1]


@query(
    f"""WITH {_STATES}, r AS (SELECT uid, row_number() OVER (ORDER BY born, uid) AS k, count(*) OVER () AS c FROM t WHERE ended AND reason IS NULL)
    SELECT t.uid, CASE WHEN r.k <= 4 AND r.c >= 4 THEN 'sampled' ELSE reason END AS why FROM t LEFT JOIN r USING (uid)"""
)
def drained_buffer(spark, d):
    states = lifecycle.group_states(_events(spark, d), 3)
    chosen = lifecycle.sample_groups(states, 100, 4, 99)[0]
    stays, gone = lifecycle.drained(states, chosen, 100, 99)
    return stays.select("uid", F.lit(None).cast("string").alias("why")).unionByName(gone.select("uid", "why"))


@query("SELECT event_id, round(value * 2, 4) AS twice FROM events")
def rate_limited_scores(spark, d):
    rows = _t(spark, d, "events").select("event_id", "value")
    return lifecycle.rate_limited(rows, lambda f: f.assign(twice=(f["value"] * 2).round(4))[["event_id", "twice"]], "event_id long, twice double", 1e9, 64, tokens="value", tokens_per_second=1e12).select("event_id", _r("twice").alias("twice"))


@query("SELECT event_id, i::INT AS sample, 'r' || i || '_' || event_id AS response, i * 0.5 AS score FROM events, (SELECT unnest(range(3)) AS i)")
def scored_groups(spark, d):
    from ..sources import scored_group_rows

    i = F.col("event_id").cast("string")
    rows = _t(spark, d, "events").select("event_id", F.array(*(F.concat(F.lit(f"r{k}_"), i) for k in range(3))).alias("response"), F.array(*(F.lit(k * 0.5) for k in range(3))).alias("score"))
    return scored_group_rows(rows, "event_id", ["response", "score"])


@query("SELECT event_id, round(i / (160000 + 160000 - i), 4) AS iou FROM (SELECT event_id, greatest(least(event_id % 500 + 400, 700) - greatest(event_id % 500, 300), 0) * greatest(least(event_id % 300 + 400, 600) - greatest(event_id % 300, 200), 0) AS i FROM events)")
def union_region_overlap(spark, d):
    """The overlap of regions of one box each."""
    e = F.col("event_id")
    box = F.concat_ws(", ", *((x).cast("string") for x in (e % 500, e % 300, e % 500 + 400, e % 300 + 400)))
    text = lambda b: F.concat(F.lit('{"boxes": [{"bbox": ['), b, F.lit('], "label": "add"}]}'))
    rows = _t(spark, d, "events").select("event_id", text(box).alias("s"), text(F.lit("300, 200, 700, 600")).alias("t"))
    return rows.select("event_id", _r(boxes.box_parts(F.col("s"), F.col("t"))["region"]).alias("iou"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN 'different' ELSE 'equal' END AS verdict FROM lineitem")
def symbolic_lines(spark, d):
    """Expressions built of each line's numbers against other forms of them: expanded, as a quotient, and, for every fourth line, another expression."""
    q, k, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_linenumber") % 4
    square, twice = (F.col("l_quantity") * F.col("l_quantity")).cast("int").cast("string"), (2 * F.col("l_quantity")).cast("int").cast("string")
    given = F.when(n == 1, F.concat(F.lit("(x+"), q, F.lit(")^2"))).when(n == 2, F.concat(F.lit("\\frac{x^2-"), square, F.lit("}{x-"), q, F.lit("}"))).otherwise(F.concat(q, F.lit("x+\\sqrt{"), k, F.lit("}")))
    truth = F.when(n == 1, F.concat(F.lit("x^{2}+"), twice, F.lit("x+"), square)).when(n == 2, F.concat(F.lit("x+"), q)).when(n == 3, F.concat(q, F.lit("x-\\sqrt{"), k, F.lit("}"))).otherwise(F.concat(F.lit("\\frac{"), k, F.lit("}{\\sqrt{"), k, F.lit("}}+"), q, F.lit("x")))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", given.alias("g"), truth.alias("t")).select("l_orderkey", "l_linenumber", parsers.math_verdict("g", "t").alias("verdict"))
