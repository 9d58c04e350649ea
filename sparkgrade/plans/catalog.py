"""The queries of the library over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, parsers, text
from ..operators import advantages as adv
from ..operators import correction, filters, losses, matching, metrics, packing, scoring, sequences, shapes
from ..streaming import lifecycle
from . import cases, files, more, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int = 4) -> Column:
    # + 0.0 makes a negative zero positive
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def seeded_sql(seed: int, key: str) -> str:
    """The number that filters.seeded() gives a key."""
    return f"(('0x' || md5('{seed}_' || {key})[1:13])::BIGINT / 4503599627370496.0)"


# Group-relative advantages: an order is a prompt, a line a response, the quantity its score, the line number its length.

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_KEYS = ", ".join(_LINE)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(*_LINE, F.col("l_quantity").alias("score"), "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")


def _adv(df: DataFrame) -> DataFrame:
    return df.select(*_LINE, _r("advantage").alias("advantage"))


def _adv_sql(expression: str, before: str = "") -> str:
    return f"SELECT {_KEYS}, round({expression}, 4) + 0.0 AS advantage FROM (SELECT *, l_quantity AS s, count(*) OVER w AS n, avg(l_quantity) OVER w AS m, sum(l_quantity) OVER w AS t, stddev_samp(l_quantity) OVER w AS sd {before} FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))"


@query(_adv_sql("CASE WHEN n > 1 THEN (s - m) / (sd + 1e-6) ELSE s / (1 + 1e-6) END"))
def grpo_advantage(spark, d):
    return _adv(adv.grpo(_lines(spark, d), "l_orderkey", "score"))


@query(_adv_sql("CASE WHEN n > 1 THEN s - m ELSE s END"))
def grpo_advantage_without_std(spark, d):
    return _adv(adv.grpo(_lines(spark, d), "l_orderkey", "score", by_std=False))


@query(_adv_sql("CASE WHEN n > 1 THEN s - (t - s) / (n - 1) ELSE s END"))
def rloo_advantage(spark, d):
    return _adv(adv.rloo(_lines(spark, d), "l_orderkey", "score"))


@query(_adv_sql("CASE WHEN n > 1 THEN s - (t - s) / (n - 1) ELSE 0 END"))
def rloo_vectorized_advantage(spark, d):
    return _adv(adv.rloo_vectorized(_lines(spark, d), "l_orderkey", "score"))


@query(_adv_sql("s - CASE WHEN n > 1 THEN b ELSE 0 END", ", sum(l_linenumber * l_quantity) OVER w / sum(l_linenumber) OVER w AS b"))
def opo_advantage(spark, d):
    return _adv(adv.opo(_lines(spark, d), "l_orderkey", "score", "l_linenumber"))


@query(_adv_sql("(SELECT count(*) / greatest(count(*) FILTER (l_quantity <> 0), 1) FROM lineitem) * (s - CASE WHEN n > 1 THEN m ELSE 0 END)"))
def gpg_advantage(spark, d):
    return _adv(adv.gpg(_lines(spark, d), "l_orderkey", "score"))


@query(
    """SELECT l_orderkey, round(CASE WHEN n < 2 THEN NULL ELSE (a[1] - a[2]) / (sd + 1e-6) END, 4) + 0.0 AS advantage
    FROM (SELECT l_orderkey, count(*) AS n, list(l_quantity ORDER BY l_quantity DESC) AS a, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY ALL) WHERE n > 1"""
)
def passk_advantage(spark, d):
    """Of the orders of two lines or more: the best line's advantage."""
    lines = _lines(spark, d)
    many = lines.select("*", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("c")).where("c > 1")
    return adv.passk(many, "l_orderkey", "score", list(_LINE[1:])).groupBy("l_orderkey").agg(_r(F.max("advantage")).alias("advantage"))


@query(
    f"""WITH a AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN l_quantity - avg(l_quantity) OVER w ELSE l_quantity END AS x FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
    s AS (SELECT avg(x) AS m, var_samp(x) AS v FROM a) SELECT {_KEYS}, round((x - m) / sqrt(v + 1e-8), 4) + 0.0 AS advantage FROM a, s"""
)
def reinforce_pp_baseline_advantage(spark, d):
    return _adv(adv.reinforce_pp_baseline(_lines(spark, d), "l_orderkey", "score"))


def _gdpo_part(c: str) -> str:
    return f"CASE WHEN count(*) OVER w > 1 THEN ({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-6) ELSE {c} / (1 + 1e-6) END"


@query(
    f"""WITH a AS (SELECT *, {_gdpo_part("l_quantity")} + 0.5 * {_gdpo_part("l_linenumber")} AS x FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
    s AS (SELECT avg(x) AS m, var_samp(x) AS v FROM a) SELECT {_KEYS}, round((x - m) / sqrt(v + 1e-8), 3) + 0.0 AS advantage FROM a, s"""
)
def gdpo_advantage(spark, d):
    got = adv.gdpo(_lines(spark, d), "l_orderkey", ["score", "l_linenumber"], [1.0, 0.5])
    return got.select(*_LINE, _r("advantage", 3).alias("advantage"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / greatest(stddev_pop(o_totalprice) OVER w, 1e-8), 4) + 0.0 AS advantage FROM orders WINDOW w AS (PARTITION BY floor(o_orderkey / 8))")
def positional_advantage(spark, d):
    got = adv.positional(_t(spark, d, "orders"), "o_orderkey", 8, "o_totalprice")
    return got.select("o_orderkey", _r("advantage").alias("advantage"))


@query("SELECT event_id, round(value - (SELECT max(value) + ln(avg(exp(value - (SELECT max(value) FROM events)))) FROM events), 4) + 0.0 AS advantage FROM events")
def soft_mean_advantage(spark, d):
    return adv.soft_mean(_t(spark, d, "events"), "value").select("event_id", _r("advantage").alias("advantage"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) - 1.5, 4) + 0.0 AS advantage FROM events")
def remax_advantage(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("t"), "value", F.lit(1.5).alias("base"))
    return adv.remax(rows, "user_id", "t", "value", "base").select("event_id", _r("advantage").alias("advantage"))


@query(
    """WITH p AS (SELECT event_type, user_id, avg(value) AS a FROM events GROUP BY ALL),
    b AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (sum(a) OVER w - a) / (count(*) OVER w - 1) ELSE 0 END AS base FROM p WINDOW w AS (PARTITION BY event_type))
    SELECT event_id, round(sum(value - base) OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS advantage FROM events JOIN b USING (event_type, user_id)"""
)
def process_rloo_advantage(spark, d):
    got = adv.process_rloo(_t(spark, d, "events"), "event_type", "user_id", "event_id", "value")
    return got.select("event_id", _r("advantage").alias("advantage"))


@query(
    """WITH t AS (SELECT event_type AS g, user_id AS r, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS t, event_id, value AS x, -value / 100 AS lp FROM events),
    a AS (SELECT *, sum(x) OVER (PARTITION BY g, r ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS ret, sum(1 - 2 * exp(lp) + 0.5) OVER (PARTITION BY g, r ORDER BY t ROWS UNBOUNDED PRECEDING) AS path FROM t),
    b AS (SELECT *, sum(ret * path) OVER w / (sum(path) OVER w + 1e-8) AS base, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY g, t))
    SELECT event_id, round(ret - CASE WHEN n > 1 THEN base ELSE 0 END, 3) + 0.0 AS advantage FROM b"""
)
def optimal_token_baseline_advantage(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.col("event_type").alias("g"), F.col("user_id").alias("r"), F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")).alias("t"), "value", F.lit(1).alias("mask"), (-F.col("value") / 100).alias("lp"), F.lit(0.5).alias("sp"))
    got = adv.optimal_token_baseline(rows, "g", "r", "t", "value", "mask", "lp", "sp")
    return got.select("event_id", _r("advantage", 3).alias("advantage"))


@query(
    """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1),
    a AS (SELECT conv_id, CASE WHEN count(*) OVER w > 1 THEN (turn - avg(turn) OVER w) / (stddev_samp(turn) OVER w + 1e-6) ELSE turn / (1 + 1e-6) END AS x FROM f WINDOW w AS (PARTITION BY conv_id % 8))
    SELECT c.conv_id, c.turn, round(x, 4) + 0.0 AS advantage FROM conversations c JOIN a USING (conv_id)"""
)
def session_broadcast_advantage(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 8).alias("g"))
    return adv.session_broadcast(rows, "g", "conv_id", "turn", "turn").select("conv_id", "turn", _r("advantage").alias("advantage"))


@query("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def session_final(spark, d):
    return adv.final_of_session(_t(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT DISTINCT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS group_id FROM lineitem")
def dense_group_ids(spark, d):
    return adv.dense_group_ids(_t(spark, d, "lineitem"), "l_returnflag").select("l_returnflag", F.col("group_id").cast("long").alias("group_id")).distinct()


@query(f"WITH s AS (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem) SELECT {_KEYS}, round((l_quantity - m) / sqrt(v + 1e-8), 4) + 0.0 AS advantage FROM lineitem, s")
def whitened_scores(spark, d):
    return _adv(adv.whiten(_lines(spark, d).withColumn("advantage", F.col("score")), "advantage"))


# Token rows: an event is a token of a user's response.

_TOKENS_SQL = """(SELECT event_id, user_id AS seq, ln(0.05 + (event_id % 97) / 120.0) AS logp, ln(0.05 + (event_id % 89) / 110.0) AS old_logp,
  ln(0.05 + (event_id % 83) / 100.0) AS rollout_logp, (event_id % 11) - 5.0 AS advantage, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS mask FROM events)"""


def _tokens(spark, d) -> DataFrame:
    e = F.col("event_id")
    logp = lambda m, by: F.log(0.05 + (e % m) / by)
    return _t(spark, d, "events").select("event_id", F.col("user_id").alias("seq"), logp(97, 120.0).alias("logp"), logp(89, 110.0).alias("old_logp"), logp(83, 100.0).alias("rollout_logp"), ((e % 11) - 5.0).alias("advantage"), F.when(e % 7 == 0, 0).otherwise(1).alias("mask"))


_A, _RATIO = "advantage", "exp(greatest(least(logp - old_logp, 20), -20))"
_CLIP = f"greatest(-advantage * {_RATIO}, -advantage * least(greatest({_RATIO}, 0.8), 1.2))"
_SEQ = "(sum((logp - old_logp) * mask) OVER w / greatest(sum(mask) OVER w, 1))"
_P, _Q = "exp(logp)", "exp(old_logp)"
_KL = f"({_Q} * (old_logp - logp) + (1 - {_Q}) * ln((1 - {_Q} + 1e-8) / (1 - {_P} + 1e-8)))"
_LOSS_SQL = {
    "vanilla": f"CASE WHEN advantage < 0 THEN least(-advantage * 3, {_CLIP}) ELSE {_CLIP} END",
    "gspo": f"greatest(-advantage * exp(least({_SEQ}, 10)), -advantage * least(greatest(exp(least({_SEQ}, 10)), 1 - 3e-4), 1 + 4e-4))",
    "sapo": f"-(1 / (1 + exp(-CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END * ({_RATIO} - 1)))) * (4 / CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END) * advantage",
    "gpg": "-logp * advantage",
    "geo_mean": "-(sum(advantage * mask) OVER w / (sum(mask) OVER w + 1e-8)) * exp(sum(sign(advantage) * least(sign(advantage) * (logp - old_logp), sign(advantage) * least(greatest(logp - old_logp, -0.2), 0.2)) * mask) OVER w / (sum(mask) OVER w + 1e-8))",
    "cispo": f"-least(greatest({_RATIO}, -9), 1.2) * advantage * logp",
    "reinforce": "-logp * advantage",
    "dro": "-logp * advantage + 0.0005 * (logp - old_logp) * (logp - old_logp)",
    "dppo_tv": f"CASE WHEN CASE WHEN advantage > 0 THEN {_P} - {_Q} > 0.2 ELSE {_P} - {_Q} < -0.2 END THEN 0 ELSE -advantage * least({_RATIO}, 20) * logp END",
    "dppo_kl": f"CASE WHEN CASE WHEN advantage > 0 THEN {_KL} > 0.2 AND {_P} > {_Q} ELSE {_KL} > 0.2 AND {_P} < {_Q} END THEN 0 ELSE -advantage * least({_RATIO}, 20) * logp END",
}


def _loss_query(kind: str):
    def run(spark, d):
        return losses.LOSSES.resolve(kind)(_tokens(spark, d)).select("event_id", _r("loss").alias("loss"))

    return run


for _kind, _sql in _LOSS_SQL.items():
    query(f"SELECT event_id, round({_sql}, 4) + 0.0 AS loss FROM {_TOKENS_SQL} WINDOW w AS (PARTITION BY seq)", f"loss_{_kind}")(_loss_query(_kind))


@query(
    f"""WITH t AS (SELECT * FROM {_TOKENS_SQL}), m AS (SELECT sum(advantage * mask) / (sum(mask) + 1e-8) AS a, sum(logp * mask) / (sum(mask) + 1e-8) AS l FROM t),
    c AS (SELECT t.*, (advantage - a) * (logp - l) AS cov FROM t, m), b AS (SELECT *, row_number() OVER (PARTITION BY mask <> 0 ORDER BY cov DESC, event_id) AS k, count(*) FILTER (mask <> 0) OVER () AS n FROM c)
    SELECT event_id, round(-advantage * {_RATIO} + CASE WHEN mask <> 0 AND k <= greatest(1, floor(n * 0.02)) THEN abs(logp - old_logp) ELSE 0 END, 4) + 0.0 AS loss FROM b"""
)
def loss_kl_cov(spark, d):
    return losses.kl_cov(_tokens(spark, d), ratio=0.02, order=["event_id"]).select("event_id", _r("loss").alias("loss"))


@query(
    f"""WITH t AS (SELECT *, {_RATIO} AS r FROM {_TOKENS_SQL}), m AS (SELECT sum(advantage * mask) / (sum(mask) + 1e-8) AS a, sum(logp * mask) / (sum(mask) + 1e-8) AS l, greatest(1, floor(0.02 * sum(mask))) AS quota FROM t),
    c AS (SELECT t.*, quota, (advantage - a) * (logp - l) AS cov, -advantage * r AS plain, -advantage * least(greatest(r, 0.8), 1.2) AS cut FROM t, m),
    e AS (SELECT *, mask <> 0 AND cov BETWEEN 1 AND 5 AND NOT cut > plain AS eligible FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY {seeded_sql(0, "event_id")}, event_id) AS k FROM e)
    SELECT event_id, round(CASE WHEN eligible AND k <= quota THEN 0 WHEN advantage < 0 THEN least(-advantage * 1e9, greatest(plain, cut)) ELSE greatest(plain, cut) END, 4) + 0.0 AS loss FROM k"""
)
def loss_clip_cov(spark, d):
    return losses.clip_cov(_tokens(spark, d), ratio=0.02, order=["event_id"]).select("event_id", _r("loss").alias("loss"))


@query(f"SELECT event_id, round(0.5 * pow(0.1 * (logp - old_logp) - avg(0.1 * (logp - old_logp)) OVER w - advantage, 2) / greatest(count(*) OVER w - 1, 1), 4) + 0.0 AS loss FROM {_TOKENS_SQL} WINDOW w AS (PARTITION BY seq)")
def loss_group_centred(spark, d):
    return losses.group_centred(_tokens(spark, d), "seq").select("event_id", _r("loss").alias("loss"))


@query(f"SELECT event_id, round(pow(logp - old_logp - 0.3 * advantage, 2), 4) + 0.0 AS loss FROM {_TOKENS_SQL}")
def loss_squared_log_ratio(spark, d):
    return losses.squared_log_ratio(_tokens(spark, d), 0.3, "advantage").select("event_id", _r("loss").alias("loss"))


@query(f"SELECT event_id, round(-logp * advantage * 0.5, 4) + 0.0 AS loss FROM {_TOKENS_SQL}")
def loss_bypass(spark, d):
    return losses.bypass(_tokens(spark, d).withColumn("weight", F.lit(0.5)), "reinforce", "weight").select("event_id", _r("loss").alias("loss"))


@query(
    f"""WITH t AS (SELECT *, -logp * advantage AS x FROM {_TOKENS_SQL}), s AS (SELECT seq, sum(x * mask) AS s, sum(mask) AS n FROM t GROUP BY seq HAVING sum(mask) > 0)
    SELECT 'token-mean' AS mode, round(sum(x * mask) / sum(mask), 4) AS loss FROM t UNION ALL SELECT 'token-sum', round(sum(x * mask), 4) FROM t
    UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 4) FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / 1000, 4) FROM s UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / n), 4) FROM s"""
)
def loss_aggregation_modes(spark, d):
    rows = losses.gpg_loss(_tokens(spark, d))
    out = None
    for mode in ("token-mean", "token-sum", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean"):
        one = losses.aggregate(rows, mode, scale=1000).select(F.lit(mode).alias("mode"), _r("loss").alias("loss"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT event_id, round(0.5 * greatest(pow(v - 1.5, 2), pow(least(greatest(v, value - 0.2), value + 0.2) - 1.5, 2)), 4) + 0.0 AS loss FROM (SELECT event_id, value / 7 AS value, value * 1.1 / 7 AS v FROM events)")
def loss_value(spark, d):
    return _t(spark, d, "events").select("event_id", _r(losses.value_loss(F.col("value") * 1.1 / 7, F.col("value") / 7, F.lit(1.5), 0.2)).alias("loss"))


@query(f"SELECT event_id, round(advantage - 0.1 * (old_logp - rollout_logp), 4) + 0.0 AS reward FROM {_TOKENS_SQL}")
def kl_shaped_reward(spark, d):
    return _tokens(spark, d).select("event_id", _r(losses.shaped_reward(F.col("advantage"), F.col("old_logp"), F.col("rollout_logp"), 0.1)).alias("reward"))


_D3 = "least(greatest(-(logp - old_logp), -20), 20)"


@query(f"SELECT event_id, round(logp - old_logp, 4) + 0.0 AS k1, round(abs(logp - old_logp), 4) AS k_abs, round(0.5 * pow(logp - old_logp, 2), 4) AS k2, round(least(greatest(exp({_D3}) - {_D3} - 1, -10), 10), 4) + 0.0 AS k3 FROM {_TOKENS_SQL}")
def kl_estimators(spark, d):
    k = lambda kind: _r(adv.kl_estimate("logp", "old_logp", kind))
    return _tokens(spark, d).select("event_id", k("k1").alias("k1"), k("abs").alias("k_abs"), k("k2").alias("k2"), k("k3").alias("k3"))


@query(
    f"""WITH t AS (SELECT *, old_logp - rollout_logp AS d FROM {_TOKENS_SQL}), w AS (SELECT *, exp(least(greatest(d, -20), 20)) * mask AS raw FROM t)
    SELECT event_id, round(least(raw, 2), 4) AS token_weight, round(least(exp(least(greatest(sum(d * mask) OVER (PARTITION BY seq), -20), 20)) * mask, 2), 4) AS sequence_weight, round(CASE WHEN raw > 2 THEN 0 ELSE raw END, 4) AS zeroed FROM w"""
)
def importance_weights(spark, d):
    t = _tokens(spark, d)
    own = correction.importance_weights(t)
    seq = correction.importance_weights(own.withColumnRenamed("weight", "token_weight").drop("raw_weight"), "sequence").withColumnRenamed("weight", "sequence_weight").drop("raw_weight")
    zero = correction.importance_weights(seq, mode="zero")
    return zero.select("event_id", _r("token_weight").alias("token_weight"), _r("sequence_weight").alias("sequence_weight"), _r("weight").alias("zeroed"))


@query(
    f"""WITH t AS (SELECT *, old_logp - rollout_logp AS d FROM {_TOKENS_SQL}),
    s AS (SELECT *, sum(d * mask) OVER w / greatest(sum(mask) OVER w, 1) AS m1, sum(0.5 * d * d * mask) OVER w / greatest(sum(mask) OVER w, 1) AS m2 FROM t WINDOW w AS (PARTITION BY seq))
    SELECT event_id, CASE WHEN d <= ln(3.1) AND d >= ln(1 / 3.1) AND m2 <= 0.9 AND m1 <= ln(2.05) AND m1 >= ln(0.45) THEN mask ELSE 0 END AS kept FROM s"""
)
def rejection_mask(spark, d):
    return correction.rejection_mask(_tokens(spark, d), {"token_k1": 3.1, "seq_mean_k2": 0.9, "seq_mean_k1": (0.45, 2.05)}).select("event_id", "kept")


@query(
    f"""WITH w AS (SELECT exp(old_logp - rollout_logp) AS r FROM {_TOKENS_SQL} WHERE mask <> 0)
    SELECT round(avg(r), 4) AS mean, round(stddev_pop(r), 4) AS std, round(min(r), 4) AS min, round(max(r), 4) AS max, round(sum(r) * sum(r) / (count(*) * sum(r * r)), 4) AS ess, round(avg((r > 2)::INT), 4) AS share_high, round(avg((r < 0.5)::INT), 4) AS share_low FROM w"""
)
def importance_metrics(spark, d):
    got = correction.importance_metrics(correction.importance_weights(_tokens(spark, d)))
    return got.select(*(_r(c).alias(c) for c in got.columns))


@query(
    f"""WITH t AS (SELECT *, old_logp - rollout_logp AS d FROM {_TOKENS_SQL} WHERE mask <> 0), s AS (SELECT seq, avg(old_logp) AS o, avg(rollout_logp) AS r, sum(d) AS s FROM t GROUP BY seq)
    SELECT (SELECT round(avg(-d), 4) FROM t) AS kl, (SELECT round(avg(exp(d) - d - 1), 4) FROM t) AS k3_kl, (SELECT round(avg(exp(d) * exp(d)) - 1, 4) FROM t) AS chi2_token, round(avg(exp(-o)), 4) AS training_ppl, round(avg(exp(-r)), 4) AS rollout_ppl, round(avg(exp(r - o)), 4) AS ppl_ratio FROM s"""
)
def off_policy_metrics(spark, d):
    got = correction.off_policy_metrics(_tokens(spark, d)).drop("chi2_seq")
    return got.select(*(_r(c).alias(c) for c in got.columns))


@query(
    f"""WITH t AS (SELECT *, old_logp - rollout_logp AS d FROM {_TOKENS_SQL} WHERE mask <> 0), s AS (SELECT seq, count(*) AS n, count(*) FILTER (abs(d) > ln(2.0)) AS g FROM t GROUP BY seq)
    SELECT round(sum(g) / sum(n), 4) AS token_share, round(avg((g > 0)::INT), 4) AS seq_any_share, round(avg((g = n)::INT), 4) AS seq_all_share FROM s"""
)
def rejection_metrics(spark, d):
    got = correction.rejection_metrics(correction.rejection_mask(_tokens(spark, d), {"token_k1": 2.0}))
    return got.select(*(_r(c).alias(c) for c in got.columns))


# Folds over arrays: a customer's orders are a response.


def _arrays(spark, d) -> DataFrame:
    rows = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") / 70000).alias("r")))).alias("x"))
    return rows.select("o_custkey", F.col("x.o_orderkey").alias("ids"), F.col("x.r").alias("r"), F.transform("x", lambda x: F.when(x["o_orderkey"] % 5 == 0, 0).otherwise(1)).alias("mask"))


_FOLD_SQL = """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice / 70000 AS r, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS m,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_totalprice DESC) AS k FROM orders), {fold}"""


@query(_FOLD_SQL.format(fold="f AS (SELECT *, r AS ret, r * m AS run FROM o WHERE k = 1 UNION ALL SELECT o.*, o.r + 0.9 * f.run, (o.r + 0.9 * f.run) * o.m FROM o JOIN f ON o.o_custkey = f.o_custkey AND o.k = f.k + 1) SELECT o_custkey, o_orderkey, round(ret, 4) AS value FROM f"))
def discounted_returns(spark, d):
    a = _arrays(spark, d)
    out = sequences.discounted_returns(F.col("r"), F.col("mask"), 0.9)
    return a.select("o_custkey", F.explode(F.arrays_zip("ids", out.alias("v"))).alias("x")).select("o_custkey", F.col("x.ids").alias("o_orderkey"), _r("x.v").alias("value"))


@query(
    _FOLD_SQL.format(
        fold="""f AS (SELECT *, (r - 0.5 * r) * m AS s, 0.5 * r * m AS nv FROM o WHERE k = 1 UNION ALL
    SELECT o.*, (o.r + 0.9 * f.nv - 0.5 * o.r + 0.9 * 0.8 * f.s) * o.m + (1 - o.m) * f.s, 0.5 * o.r * o.m + (1 - o.m) * f.nv FROM o JOIN f ON o.o_custkey = f.o_custkey AND o.k = f.k + 1) SELECT o_custkey, o_orderkey, round(s, 4) + 0.0 AS value FROM f"""
    )
)
def gae_advantage(spark, d):
    a = _arrays(spark, d).withColumn("v", F.transform("r", lambda x: x * 0.5))
    out = sequences.gae(F.col("r"), F.col("v"), F.col("mask"), 0.9, 0.8)
    return a.select("o_custkey", F.explode(F.arrays_zip("ids", out.alias("w"))).alias("x")).select("o_custkey", F.col("x.ids").alias("o_orderkey"), _r("x.w").alias("value"))


@query("SELECT o_custkey, round(sum(o_totalprice / 70000) FILTER (o_orderkey % 5 <> 0), 4) AS total, round(coalesce(sum(o_totalprice / 70000) FILTER (o_orderkey % 5 <> 0), 0) / (count(*) FILTER (o_orderkey % 5 <> 0) + 1e-8), 4) AS mean FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 5 <> 0) > 0")
def masked_moments(spark, d):
    a = _arrays(spark, d).where(F.array_contains("mask", 1))
    return a.select("o_custkey", _r(sequences.masked_sum(F.col("r"), F.col("mask"))).alias("total"), _r(sequences.masked_mean(F.col("r"), F.col("mask"))).alias("mean"))


@query("SELECT o_custkey, round(var_samp(o_totalprice / 70000) FILTER (o_orderkey % 5 <> 0), 4) AS var FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 5 <> 0) > 1")
def masked_variance(spark, d):
    a = _arrays(spark, d).where(F.aggregate("mask", F.lit(0), lambda x, y: x + y) > 1)
    return a.select("o_custkey", _r(sequences.masked_var(F.col("r"), F.col("mask"))).alias("var"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), f AS (SELECT o_custkey, min(i) FILTER (o_orderkey % 5 = 0) AS e, count(*) AS n FROM k GROUP BY o_custkey) SELECT o_custkey, coalesce(e, n)::INT AS length FROM f")
def response_lengths(spark, d):
    a = _arrays(spark, d)
    mask = sequences.response_mask(F.transform("ids", lambda x: x % 5), 0)
    return a.select("o_custkey", F.aggregate(mask, F.lit(0), lambda x, y: x + y).alias("length"))


# Metrics.


@query(
    """WITH u AS (SELECT event_type, user_id, avg(value) AS a, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, round(avg(a), 4) AS mean, round(avg(s) FILTER (n > 1), 4) AS std FROM u GROUP BY event_type"""
)
def validation_mean_std(spark, d):
    own = _t(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return own.groupBy("event_type").agg(_r(F.avg("a")).alias("mean"), _r(F.avg(F.when(F.col("n") > 1, F.col("s")))).alias("std"))


_LADDER_SQL = """WITH o AS (SELECT event_type, user_id, value AS x, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events),
k AS (SELECT DISTINCT n, unnest(list_distinct(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048], lambda v: v < n), n))) AS k FROM o WHERE n > 1),
e AS (SELECT event_type, user_id, k, sum(x * (pow(i / n, k) - pow((i - 1) / n, k))) AS best, sum(x * (pow((n - i + 1) / n, k) - pow((n - i) / n, k))) AS worst FROM o JOIN k USING (n) GROUP BY ALL)"""


@query(_LADDER_SQL + " SELECT event_type, k::INT AS k, round(avg(best), 4) AS best, round(avg(worst), 4) AS worst FROM e GROUP BY ALL")
def validation_best_worst(spark, d):
    got = metrics.expected_extremes(_t(spark, d, "events"), ["event_type", "user_id"], "value")
    return got.groupBy("event_type", "k").agg(_r(F.avg("best")).alias("best"), _r(F.avg("worst")).alias("worst"))


@query(
    _LADDER_SQL
    + """, u AS (SELECT event_type, user_id, avg(value) AS a, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY ALL),
    m AS (SELECT event_type, 'mean@' || n AS metric, a AS value FROM u UNION ALL SELECT event_type, 'std@' || n, s FROM u WHERE n > 1 UNION ALL SELECT event_type, 'best@' || k, best FROM e UNION ALL SELECT event_type, 'worst@' || k, worst FROM e)
    SELECT event_type, metric, round(avg(value), 6) AS value FROM m GROUP BY ALL"""
)
def validation_metric_tree(spark, d):
    got = metrics.validation_metrics(_t(spark, d, "events"), "event_type", "user_id", "value")
    return got.select("event_type", "metric", _r("value", 6).alias("value"))


@query()
def validation_bootstrap(spark, d):
    own = metrics.bootstrap(_t(spark, d, "events"), ["event_type", "user_id"], "value", 4, "event_id")
    # As in the reference, prompts with fewer responses have no best of 4, and the others weigh 1 each.
    return own.where("n >= 4").groupBy("event_type").agg(*(_r(F.avg(c)).alias(c) for c in ("best", "best_std", "worst", "worst_std")))


@query(
    _LADDER_SQL.replace("WITH o", "WITH RECURSIVE o")
    + """, s AS (SELECT event_type, user_id, k, sum(x * x * (pow(i / n, k) - pow((i - 1) / n, k))) AS best, sum(x * x * (pow((n - i + 1) / n, k) - pow((n - i) / n, k))) AS worst FROM o JOIN k USING (n) GROUP BY ALL),
    -- Votes one after another: draws so far, the highest count, how many votes have it, the weight, and the weighted sums of those votes' means and squares.
    v AS (SELECT event_type, user_id, event_id % 3 AS vote, count(*) AS c, avg(value) AS a, avg(value * value) AS q FROM events GROUP BY ALL),
    g AS (SELECT *, sum(c) OVER u AS n, count(*) OVER u AS votes, row_number() OVER (PARTITION BY event_type, user_id ORDER BY vote) AS j FROM v WINDOW u AS (PARTITION BY event_type, user_id)),
    h AS (SELECT g.*, k.k FROM g JOIN k USING (n)),
    t AS (SELECT event_type, user_id, k, 0::BIGINT AS j, 0::BIGINT AS r, 0::BIGINT AS m, 0::BIGINT AS ties, 1.0::DOUBLE AS w, 0.0::DOUBLE AS a, 0.0::DOUBLE AS q FROM h WHERE j = 1
      UNION ALL SELECT event_type, user_id, k, j, r, m, ties, sum(w), sum(a), sum(q) FROM (
        SELECT h.event_type, h.user_id, h.k, h.j, t.r + d.d AS r, greatest(t.m, d.d) AS m, CASE WHEN d.d > t.m THEN 1 WHEN d.d = t.m AND d.d > 0 THEN t.ties + 1 ELSE t.ties END AS ties,
          t.w * p.p AS w, (CASE WHEN d.d > t.m THEN t.w * h.a WHEN d.d = t.m AND d.d > 0 THEN t.a + t.w * h.a ELSE t.a END) * p.p AS a, (CASE WHEN d.d > t.m THEN t.w * h.q WHEN d.d = t.m AND d.d > 0 THEN t.q + t.w * h.q ELSE t.q END) * p.p AS q
        FROM t JOIN h ON t.event_type = h.event_type AND t.user_id = h.user_id AND t.k = h.k AND h.j = t.j + 1, LATERAL (SELECT unnest(range(CASE WHEN h.j = h.votes THEN h.k - t.r ELSE 0 END, h.k - t.r + 1)) AS d) d, LATERAL (SELECT pow(h.c / h.n, d.d) / gamma(d.d + 1) AS p) p) GROUP BY ALL),
    maj AS (SELECT t.event_type, t.user_id, t.k, sum(t.a / t.ties) * gamma(any_value(t.k) + 1) AS mean, sum(t.q / t.ties) * gamma(any_value(t.k) + 1) AS square FROM t JOIN h ON t.event_type = h.event_type AND t.user_id = h.user_id AND t.k = h.k AND t.j = h.j WHERE h.j = h.votes AND t.r = t.k GROUP BY ALL),
    z AS (SELECT event_type, k, 'best' AS what, e.best AS mean, s.best AS square FROM e JOIN s USING (event_type, user_id, k) UNION ALL SELECT event_type, k, 'worst', e.worst, s.worst FROM e JOIN s USING (event_type, user_id, k) UNION ALL SELECT event_type, k, 'maj', mean, square FROM maj)
    SELECT event_type, k::INT AS k, what, round(avg(mean), 4) AS mean, round(avg(sqrt(greatest(square - mean * mean, 0))), 4) AS std FROM z GROUP BY ALL"""
)
def validation_ladder(spark, d):
    """Means and deviations of best, worst and majority of k, prompts weighing 1 each."""
    got = metrics.resampling_ladder(_t(spark, d, "events").withColumn("vote", F.col("event_id") % 3), ["event_type", "user_id"], "value", "vote")
    return got.groupBy("event_type", "k", "what").agg(_r(F.avg("mean")).alias("mean"), _r(F.avg("std")).alias("std"))


@query(
    """WITH v AS (SELECT user_id, event_type, count(*) AS c, arg_min(value, event_id) AS v, min(event_id) AS pos FROM events GROUP BY ALL)
    SELECT user_id, round(arg_max(v, c * 1000000000.0 - pos), 4) AS majority FROM v GROUP BY user_id"""
)
def validation_majority(spark, d):
    got = metrics.majority(_t(spark, d, "events"), ["user_id"], "event_type", "value", "event_id")
    return got.select("user_id", _r("majority").alias("majority"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def percentiles_linear(spark, d):
    got = metrics.percentiles_linear(_t(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])
    return got.select("event_type", *(_r(c).alias(c) for c in ("p50", "p95", "p99")))


@query("SELECT event_type, round(list(value ORDER BY value)[round_even(0.9 * (count(*) - 1), 0)::BIGINT + 1], 4) AS percentile FROM events GROUP BY event_type")
def percentile_nearest(spark, d):
    got = metrics.percentile_nearest(_t(spark, d, "events"), "value", 0.9, ["event_type"])
    return got.select("event_type", _r("percentile").alias("percentile"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, 'value' AS metric, round(avg(value / 7), 4) AS mean, count(value) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, strftime(ts, '%Y-%m-%d'), 'user_id', round(avg(user_id / 7), 4), count(user_id) FROM events GROUP BY ALL")
def trend_by_day(spark, d):
    got = metrics.trend(_t(spark, d, "events").withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "value": F.col("value") / 7, "user_id": F.col("user_id") / 7}), "event_type", "day", ["value", "user_id"])
    return got.select("event_type", "day", "metric", _r("mean").alias("mean"), "n")


@query("WITH g AS (SELECT DISTINCT p_brand, unnest(range(51)) AS bucket FROM part) SELECT g.p_brand, g.bucket::INT AS bucket, count(p.p_size) AS c FROM g LEFT JOIN part p ON p.p_brand = g.p_brand AND p.p_size = g.bucket GROUP BY ALL")
def histogram_zero_filled(spark, d):
    return metrics.zero_filled_histogram(_t(spark, d, "part"), "p_brand", F.col("p_size"), 51)


@query("WITH h AS (SELECT event_type, user_id % 8 AS e, count(*) AS c FROM events GROUP BY ALL), v AS (SELECT event_type, max(c) * 8 / sum(c) - 1 AS v FROM h GROUP BY ALL) SELECT round(max(v), 4) AS max, round(min(v), 4) AS min, round(avg(v), 4) AS avg FROM v")
def load_violation(spark, d):
    loads = metrics.zero_filled_histogram(_t(spark, d, "events"), "event_type", F.col("user_id") % 8, 8).withColumnRenamed("event_type", "layer")
    got = metrics.load_violation(loads, 8)
    return got.select(*(_r(c).alias(c) for c in got.columns))


@query("SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 4) AS value FROM (SELECT event_type || unnest(['_max', '_min', '_x']) AS key, value FROM events) GROUP BY key")
def reduce_by_name(spark, d):
    rows = _t(spark, d, "events").withColumn("end", F.explode(F.array(F.lit("_max"), F.lit("_min"), F.lit("_x")))).select(F.concat("event_type", "end").alias("key"), "value")
    return metrics.reduce_by_name(rows).select("key", _r("value").alias("value"))


@query(
    """WITH r AS (SELECT event_type AS key, unnest(['sum', 'mean', 'max', 'min']) AS kind, user_id % 4 AS rank, value FROM events),
    k AS (SELECT key, kind, rank, sum(value) AS s, avg(value) AS a, max(value) AS hi, min(value) AS lo FROM r GROUP BY ALL)
    SELECT key || '/' || kind AS key, round(CASE kind WHEN 'sum' THEN avg(s) WHEN 'mean' THEN avg(a) WHEN 'max' THEN max(hi) ELSE min(lo) END, 4) AS value FROM k GROUP BY key, kind"""
)
def aggregate_typed_metrics(spark, d):
    rows = _t(spark, d, "events").select("event_type", F.explode(F.array(*map(F.lit, ("sum", "mean", "max", "min")))).alias("kind"), (F.col("user_id") % 4).alias("rank"), "value").withColumn("key", F.concat_ws("/", "event_type", "kind"))
    return metrics.aggregate_typed(rows).select("key", _r("value").alias("value"))


@query("SELECT event_type AS key, round(sum(value * (user_id % 5 + 1)) / sum(user_id % 5 + 1), 4) AS value FROM events GROUP BY 1")
def aggregate_steps(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("step"), "value", (F.col("user_id") % 5 + 1).alias("weight"))
    return metrics.aggregate_steps(rows).select("key", _r("value").alias("value"))


def _moments_sql(name: str, c: str) -> str:
    return ", ".join(f"round({f}({c}), 4)::DOUBLE AS {name}_{k}" for k, f in (("mean", "avg"), ("max", "max"), ("min", "min")))


@query(
    f"""SELECT {_moments_sql("score", "l_quantity")}, {_moments_sql("reward", "l_extendedprice")}, {_moments_sql("advantage", "l_discount")}, {_moments_sql("returns", "l_quantity")}, {_moments_sql("prompt_length", "l_suppkey")}, round(avg((l_suppkey = 100)::INT), 4) AS prompt_length_clip_ratio,
    {_moments_sql("response_length", "l_linenumber")}, round(avg((l_linenumber = 7)::INT), 4) AS response_length_clip_ratio, round(avg((l_linenumber = 0)::INT), 4) AS aborted_ratio, round(1 - var_samp(l_quantity - 50 * l_discount) / (var_samp(l_quantity) + 1e-5), 4) AS explained_variance FROM lineitem"""
)
def data_metrics(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("v", 50 * F.col("l_discount"))
    got = metrics.data_metrics(rows, "l_quantity", "l_extendedprice", "l_discount", "l_quantity", "l_suppkey", "l_linenumber", 100, 7, "v")
    return got.select(*(_r(c).alias(c) for c in got.columns))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS conflicts, round(avg((l_linestatus = 'O')::INT), 4) AS rate, round(avg(l_discount), 4) AS confidence, count(*) FILTER (l_linestatus = 'O' AND l_discount >= 0.05) AS at_5 FROM lineitem GROUP BY 1")
def result_summary(spark, d):
    got = metrics.result_summary(_t(spark, d, "lineitem").withColumn("c", F.col("l_linestatus") == "O"), "c", "l_discount", [0.05], ["l_returnflag"])
    return got.select("l_returnflag", "n", "conflicts", _r("rate").alias("rate"), _r("confidence").alias("confidence"), "at_5")


@query("SELECT round(max(s), 2) AS max, round(min(s), 2) AS min, round(avg(s), 2) AS mean, round(max(s) - min(s), 2) AS spread FROM (SELECT l_suppkey % 16 AS p, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1)")
def load_imbalance(spark, d):
    got = metrics.imbalance(_t(spark, d, "lineitem").withColumn("p", F.col("l_suppkey") % 16), "p", "l_extendedprice")
    return got.select(*(_r(c, 2).alias(c) for c in got.columns))


@query("SELECT l.toxic, l.quality, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def label_confusion(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id"), "doc_id").groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(a), 4) AS chosen_mean, round(avg(b), 4) AS rejected_mean, round(avg(a - b), 4) AS margin_mean, round(max(a - b), 4) AS margin_max, round(min(a - b), 4) AS margin_min, round(avg((a > b)::INT), 4) AS accuracy FROM (SELECT l_discount AS a, l_tax AS b FROM lineitem)")
def preference_metrics(spark, d):
    got = metrics.preference_metrics(_t(spark, d, "lineitem"), "l_discount", "l_tax")
    return got.select(*(_r(c).alias(c) for c in got.columns))


_MARGIN = "((l_discount - l_tax) * 10 - (l_quantity / 50 - 0.5))"


@query(f"SELECT {_KEYS}, round(-(least(2 * {_MARGIN}, 0) - ln(1 + exp(-abs(2 * {_MARGIN})))), 4) + 0.0 AS sigmoid, round(pow({_MARGIN} - 0.25, 2), 4) AS ipo FROM lineitem")
def preference_loss(spark, d):
    a, b, c, z = F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.5)
    x = _t(spark, d, "lineitem")
    return x.select(*_LINE, _r(losses.preference_loss(a, b, c, z, 2.0)).alias("sigmoid"), _r(losses.preference_loss(a, b, c, z, 2.0, "ipo")).alias("ipo"))


@query(
    """WITH p AS (SELECT a.l_orderkey AS g, count(*) AS n, count(*) FILTER (a.l_quantity > b.l_quantity) AS r FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = 'O' AND b.l_linestatus <> 'O' GROUP BY 1)
    SELECT round(avg(coalesce(r / n, 0.5)), 4) AS accuracy FROM (SELECT DISTINCT l_orderkey AS g FROM lineitem) LEFT JOIN p USING (g)"""
)
def pairwise_accuracy(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("ok", (F.col("l_linestatus") == "O").cast("int"))
    return losses.pairwise_accuracy(rows, "l_orderkey", "l_quantity", "ok").select(_r("accuracy").alias("accuracy"))


@query("SELECT round(avg((l_quantity > 25) = (l_linestatus = 'O')), 4) AS accuracy FROM (SELECT l_quantity, l_linestatus, 1 FROM lineitem)".replace("avg((l_quantity > 25) = (l_linestatus = 'O'))", "avg(((l_quantity > 25) = (l_linestatus = 'O'))::INT)"))
def absolute_accuracy(spark, d):
    rows = _t(spark, d, "lineitem").select((F.col("l_quantity") - 25).alias("s"), (F.col("l_linestatus") == "O").cast("int").alias("ok"))
    return losses.absolute_accuracy(rows, "s", "ok").select(_r("accuracy").alias("accuracy"))


# Filters and samplers.


@query(f"SELECT {_KEYS}, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1 OR min(l_returnflag) <> max(l_returnflag))")
def zero_variance_filter(spark, d):
    return filters.varied_groups(_t(spark, d, "lineitem").select(*_LINE, "l_returnflag"), "l_orderkey", "l_returnflag")


@query("SELECT v AS l_returnflag, count(*) AS groups FROM (SELECT min(l_returnflag) AS v FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 AND min(l_returnflag) = max(l_returnflag)) GROUP BY 1")
def zero_variance_counts(spark, d):
    return filters.constant_group_counts(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("WITH g AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS ok FROM lineitem GROUP BY 1) SELECT l_orderkey FROM g ORDER BY ok DESC, l_orderkey LIMIT (SELECT count(*) // 4 FROM g)")
def passing_groups_first(spark, d):
    return filters.passing_first(_t(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", "l_orderkey", 4).select("l_orderkey").distinct()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def oldest_first(spark, d):
    return filters.oldest(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 100, ["o_orderkey"]).select("o_orderkey")


@query("SELECT event_id FROM events ORDER BY user_id DESC, event_id LIMIT 64")
def newest_version_sample(spark, d):
    return filters.by_version(_t(spark, d, "events").select("event_id", "user_id"), "user_id", 64, True, ["event_id"]).select("event_id")


@query("SELECT event_id FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def same_version_sample(spark, d):
    return filters.same_version(_t(spark, d, "events").select("event_id", "user_id"), "user_id", 1).select("event_id")


@query(f"SELECT o_orderkey FROM orders ORDER BY {seeded_sql(42, 'o_orderkey')}, o_orderkey LIMIT 50")
def hash_sample(spark, d):
    return filters.hash_sample(_t(spark, d, "orders").select("o_orderkey"), 50, 42, "o_orderkey")


@query(
    f"""WITH w AS (SELECT c_custkey, pow(abs(c_acctbal), 2) AS w FROM customer), r AS (SELECT c_custkey, w, sum(w) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS up FROM w),
    i AS (SELECT c_custkey, coalesce(lag(up) OVER (ORDER BY c_custkey), 0) AS lo, up FROM r), u AS (SELECT x AS draw, {seeded_sql(7, "x")} AS u FROM (SELECT unnest(range(500)) AS x))
    SELECT c_custkey, draw FROM u JOIN i ON u >= lo AND u < up"""
)
def weighted_resample(spark, d):
    got = filters.draw_with_replacement(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), filters.score_weights(F.col("c_acctbal"), "pow"), 500, 7, ["c_custkey"])
    return got.select("c_custkey", "draw")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000) ORDER BY 1 LIMIT 200")
def ready_set(spark, d):
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return filters.ready([o, lines], o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 1000"), "k", 200)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4 ORDER BY 1 LIMIT 50) GROUP BY 1")
def ready_groups(spark, d):
    return filters.ready_groups(_t(spark, d, "lineitem"), "l_orderkey", 4, 50).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE 400 - event_id // 25 + 1 > 100")
def stale_rows(spark, d):
    return _t(spark, d, "events").withColumn("born", F.floor(F.col("event_id") / 25)).where(filters.stale(None, "born", F.lit(400), 100)).select("event_id")


# Shapes.


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def positions(spark, d):
    return shapes.with_position(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "pos")


@query("SELECT n_nationkey, (ntile(4) OVER (ORDER BY n_nationkey) - 1)::INT AS chunk FROM nation")
def chunked(spark, d):
    return shapes.chunk(_t(spark, d, "nation").select("n_nationkey"), 4, F.lit(25), "n_nationkey").select("n_nationkey", "chunk")


@query("SELECT r_regionkey, (r_regionkey * 3 + c)::BIGINT AS interleaved, (c * 5 + r_regionkey)::BIGINT AS tiled FROM region, (SELECT unnest(range(3)) AS c)")
def repeated(spark, d):
    r = shapes.repeat(_t(spark, d, "region").select("r_regionkey"), 3, F.lit(5), True, "r_regionkey")
    return r.select("r_regionkey", F.col("new_pos").cast("long").alias("interleaved"), (F.col("copy") * 5 + F.col("r_regionkey")).cast("long").alias("tiled"))


@query("SELECT n_nationkey, unnest(range(n_regionkey)) AS copy FROM nation")
def repeated_each(spark, d):
    return shapes.repeat_each(_t(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey")).select("n_nationkey", F.col("copy").cast("long").alias("copy"))


@query("SELECT n_nationkey::BIGINT AS pos, n_nationkey % 25 AS n_nationkey, false AS is_padding FROM nation UNION ALL SELECT 25 + n_nationkey, n_nationkey, true FROM nation WHERE n_nationkey < 7")
def padded(spark, d):
    rows = _t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("pos"))
    return shapes.pad_to_divisor(rows, 32, 25)


@query("SELECT n_nationkey // 5 AS slot, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1".replace("list(n_name ORDER BY n_nationkey)", "string_agg(n_name, ',' ORDER BY n_nationkey)"))
def folded(spark, d):
    return shapes.fold(_t(spark, d, "nation"), ["n_name"], 5, "n_nationkey").select("slot", F.array_join("n_name", ",").alias("names"))


@query("SELECT vec_id, p::INT AS part, round(list_sum(embedding[p * (len(embedding) // 4) + 1 : (p + 1) * (len(embedding) // 4)]), 3) + 0.0 AS total FROM embeddings, (SELECT unnest(range(4)) AS p)")
def unfolded_chunks(spark, d):
    got = shapes.unfold_chunks(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    return got.select("vec_id", "part", _r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def united(spark, d):
    o = _t(spark, d, "orders").dropDuplicates(["o_orderkey"])
    return shapes.unite(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 2 AND n_nationkey < 20 AND (n_nationkey - 2) % 3 = 0")
def sliced(spark, d):
    return shapes.slice_rows(_t(spark, d, "nation").select("n_nationkey", "n_name"), 2, 20, 3, "n_nationkey")


@query("SELECT conv_id, kind, response FROM (SELECT conv_id, max(text) FILTER (turn = 0) AS chosen, max(text) FILTER (turn = 1) AS rejected FROM conversations GROUP BY 1) UNPIVOT INCLUDE NULLS (response FOR kind IN (chosen, rejected))")
def chosen_rejected(spark, d):
    from ..sources import chosen_rejected_rows

    wide = _t(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("chosen"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("rejected"))
    return chosen_rejected_rows(wide, "conv_id", "chosen", "rejected")


# Joins and look-ups.


@query("SELECT * EXCLUDE (k) FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_record_wins(spark, d):
    return matching.last_wins(_t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, d):
    return matching.remaining(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_retrying_errors(spark, d):
    done = _t(spark, d, "labels").withColumn("error", F.when(F.col("quality") == 0, "failed"))
    return matching.remaining(_t(spark, d, "documents").select("doc_id"), done, "doc_id", True)


_KEY_SQL = r"regexp_replace(lower(trim(text)), '\s+', '', 'g')"


@query(
    f"""WITH d AS (SELECT doc_id, {_KEY_SQL} AS k FROM documents), b AS (SELECT item_id, {_KEY_SQL} AS k FROM benchmark),
    m AS (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY (d.k = b.k) DESC, length(b.k) DESC, b.k DESC, item_id) AS r FROM d JOIN b ON contains(d.k, b.k))
    SELECT doc_id, item_id FROM d LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (doc_id)"""
)
def prompt_trace_back(spark, d):
    key = F.regexp_replace(F.lower(F.trim("text")), r"\s+", "")
    docs = _t(spark, d, "documents").select("doc_id", key.alias("k"))
    items = _t(spark, d, "benchmark").select("item_id", key.alias("k"))
    return matching.trace_back(docs, items, "doc_id", "k", "k", "item_id")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing right' ELSE 'missing left' END AS fault FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL".replace("l.doc_id IS NULL THEN", "l.doc_id IS NULL THEN"))
def alignment_faults(spark, d):
    a, b = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("x")), _t(spark, d, "labels").select("doc_id", F.lit(1).alias("x"))
    return matching.alignment_faults(a, b, "doc_id", ["x"])


@query("SELECT count(*) = 25 AND count(DISTINCT n_nationkey) = 25 AND min(n_nationkey) = 0 AND max(n_nationkey) = 24 AS complete FROM nation")
def completeness(spark, d):
    return matching.completeness(_t(spark, d, "nation"), "n_nationkey", 25, [])


# Text.


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM conversations""")
def qa_normal_form(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.qa_normal(F.col("text")).alias("answer"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text, len(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1))::INT AS n_links FROM pages""")
def html_text_and_links(spark, d):
    return _t(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"), F.size(text.links(F.col("html"))).alias("n_links"))


@query("SELECT event_id, round((props ->> '$.k')::DOUBLE, 4) AS k, json_valid(props) AS valid FROM events")
def json_scalars(spark, d):
    return _t(spark, d, "events").select("event_id", _r(F.get_json_object("props", "$.k").try_cast("double")).alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS one, list_filter(regexp_split_to_array(text, '\n[ \t\n\x0b\f\r]*\n'), lambda p: regexp_matches(p, '[^ \t\n\x0b\f\r]')) AS parts FROM documents),
    c AS (SELECT doc_id, one, list_filter(list_transform(string_split(replace(regexp_replace(one, '([!?\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(1), 'g'), '. ', '.' || chr(1)), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s,
      string_split(regexp_replace(regexp_replace(parts[-1], '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'), '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM d)
    SELECT doc_id, coalesce(s[-1], one) AS last, l[-1] AS last_of_paragraph FROM c"""
)
def last_sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.last_sentence(F.col("text")).alias("last"), text.last_sentence_of_paragraph(F.col("text")).alias("last_of_paragraph"))


_GRADED = """(SELECT event_id, '<think>so ' || event_id || '. Then A!</think>{"answer": "' || CASE event_id % 4 WHEN 0 THEN '(A)' WHEN 1 THEN ' b ' WHEN 2 THEN 'A' ELSE 'c' END || '", "boxes": [[' || event_id % 500 || ',' || event_id % 300 || ',' || event_id % 500 + 400 || ',' || event_id % 300 + 400 || ']]}' AS solution, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE '{"answer": "b"}' END AS truth FROM events)"""


def _graded(spark, d) -> DataFrame:
    e = F.col("event_id")
    s = lambda x: x.cast("string")
    answer = F.when(e % 4 == 0, "(A)").when(e % 4 == 1, " b ").when(e % 4 == 2, "A").otherwise("c")
    box = F.concat_ws(",", s(e % 500), s(e % 300), s(e % 500 + 400), s(e % 300 + 400))
    solution = F.concat(F.lit("<think>so "), s(e), F.lit('. Then A!</think>{"answer": "'), answer, F.lit('", "boxes": [['), box, F.lit("]]}"))
    return _t(spark, d, "events").select("event_id", solution.alias("solution"), F.when(e % 3 == 0, "a").otherwise('{"answer": "b"}').alias("truth"))


@query("SELECT event_id, CASE WHEN CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a' ELSE 'c' END = CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END THEN 1.0 ELSE 0.0 END AS score, 'so ' || event_id || '. Then A!' AS thinking, 'Then A!' AS last FROM events")
def answer_score(spark, d):
    g = _graded(spark, d)
    th = text.thinking(F.col("solution"))
    return g.select("event_id", scoring.json_answer(F.col("solution"), F.col("truth")).alias("score"), th.alias("thinking"), text.last_sentence(th).alias("last"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 3 = 0)::INT::DOUBLE WHEN 1 THEN (event_id % 3 = 0)::INT::DOUBLE WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE -1.0 END ELSE (event_id % 3 = 0)::INT::DOUBLE END AS score FROM events")
def routed_score(spark, d):
    """Four sources with a scorer each; a third of the solutions is right."""
    e, right = F.col("event_id"), F.col("event_id") % 3 == 0
    n = e.cast("string")
    said = F.when(e % 4 == 0, F.concat(F.lit('it is {"answer": "'), F.when(right, " (b) ").otherwise("c"), F.lit('"}'))).when(e % 4 == 1, F.concat(F.lit("about 1 and "), F.when(right, n).otherwise(F.concat(n, F.lit("1"))))).when(e % 4 == 2, F.concat(F.lit("Answer: "), F.when(right, F.concat(n, F.lit(" cm"))).otherwise("0.5"))).otherwise(F.concat(F.lit("\\boxed{"), F.when(right, n).otherwise("x"), F.lit("}")))
    rows = _t(spark, d, "events").select("event_id", F.concat(F.lit("s"), (e % 4).cast("string")).alias("source"), said.alias("solution"), F.when(e % 4 == 0, "B").otherwise(n).alias("truth"))
    return scoring.route(rows, "source", "solution", "truth", {"s0": "json_answer", "s1": "last_number", "s2": "minerva", "s3": "boxed_exact"}).select("event_id", "score")


@query("SELECT event_id, round(CASE WHEN event_id % 500 < 500 THEN i / (160000 + 160000 - i) END, 4) AS iou FROM (SELECT event_id, greatest(least(event_id % 500 + 400, 700) - greatest(event_id % 500, 300), 0) * greatest(least(event_id % 300 + 400, 600) - greatest(event_id % 300, 200), 0) AS i FROM events)")
def box_iou(spark, d):
    e = F.col("event_id")
    a = F.array(*((x).cast("double") for x in (e % 500, e % 300, e % 500 + 400, e % 300 + 400)))
    b = F.array(*(F.lit(float(x)) for x in (300, 200, 700, 600)))
    return _t(spark, d, "events").select("event_id", _r(boxes.iou_column(a, b)).alias("iou"))


def _overlap_sql(a: int, b: int, c: int, e: int) -> str:
    return f"greatest(least(event_id % 500 + 400, {c}) - greatest(event_id % 500, {a}), 0) * greatest(least(event_id % 300 + 400, {e}) - greatest(event_id % 300, {b}), 0)"


@query(f"SELECT event_id, round(greatest(i / (320000 - i), j / (320000 - j)) / 2, 4) AS score FROM (SELECT event_id, {_overlap_sql(0, 0, 400, 400)} AS i, {_overlap_sql(300, 200, 700, 600)} AS j FROM events)")
def hungarian_box_score(spark, d):
    truth = '{"boxes": [[0,0,400,400],[300,200,700,600]]}'
    return _graded(spark, d).select("event_id", _r(boxes.hungarian_iou("solution", F.lit(truth))).alias("score"))


@query(
    f"""WITH o AS (SELECT event_id, event_id % 4 IN (0, 2) AS same, {_overlap_sql(100, 100, 500, 500)} AS i, 300 - (event_id % 500 + 200) AS dx, event_id % 300 + 200 - 120 AS dy FROM events),
    p AS (SELECT event_id, same, i / (320000 - i) AS iou, CASE WHEN sqrt(dx * dx + dy * dy) < 1e-9 THEN 0 ELSE greatest(0, least(1, dy / sqrt(dx * dx + dy * dy))) END AS agree FROM o)
    SELECT event_id, round(CASE WHEN same THEN 0.1 + 0.25 * iou + 0.25 * iou * agree + 0.4 * 0.5 ELSE 0 END, 4) + 0.0 AS consistency, round(0.25 * iou + 0.25 * iou * agree + 0.5 * 0.5, 4) AS detection FROM p"""
)
def box_composites(spark, d):
    truth = '{"answer": "a", "boxes": [{"bbox": [100, 100, 500, 500], "label": "move (300, 100)"}]}'
    given = F.regexp_replace("solution", r"\[\[(.*?)\]\]", '[{"bbox": [$1], "label": "move (300, 120)"}]')
    p = boxes.box_parts(given, F.lit(truth))
    rows = _graded(spark, d).select("event_id", p.alias("p"))
    return rows.select("event_id", _r(boxes.consistency_score(F.col("p"), F.lit(0.5))).alias("consistency"), _r(boxes.detection_score(F.col("p"), F.lit(0.5))).alias("detection"))


@query(
    f"""WITH o AS (SELECT event_id, event_id % 4 IN (0, 2) AS same, {_overlap_sql(100, 100, 500, 500)} AS i, 300 - (event_id % 500 + 200) AS dx, event_id % 300 + 200 - 120 AS dy FROM events),
    p AS (SELECT event_id, same, i / (320000 - i) AS iou, CASE WHEN sqrt(dx * dx + dy * dy) < 1e-9 THEN 0 ELSE greatest(0, least(1, dy / sqrt(dx * dx + dy * dy))) END AS agree FROM o)
    SELECT event_id, 'consistency' AS kind, same::INT::DOUBLE AS c, round(iou, 4) AS r2, round(iou * agree, 4) AS r3, 0.5 AS r4, round(CASE WHEN same THEN 0.1 + 0.25 * iou + 0.25 * iou * agree + 0.4 * 0.5 ELSE 0 END, 4) + 0.0 AS reward FROM p
    UNION ALL SELECT event_id, 'detection', NULL, round(iou, 4), round(iou * agree, 4), 0.5, round(0.25 * iou + 0.25 * iou * agree + 0.5 * 0.5, 4) FROM p
    UNION ALL SELECT event_id, 'no boxes wanted', same::INT, NULL, NULL, NULL, round(CASE WHEN same THEN 0.2 ELSE 0 END, 4) FROM p"""
)
def score_details(spark, d):
    """The parts behind a graded answer's reward, of truths with a box and without one."""
    told = '{"answer": "a", "boxes": [{"bbox": [100, 100, 500, 500], "label": "move (300, 100)"}]}'
    given = F.regexp_replace("solution", r"\[\[(.*?)\]\]", '[{"bbox": [$1], "label": "move (300, 120)"}]')
    rows = _graded(spark, d).select("event_id", boxes.box_parts(given, F.lit(told)).alias("p"), boxes.box_parts(given, F.lit('{"answer": "a", "boxes": []}')).alias("q"))
    kinds = {"consistency": ("p", "consistency"), "detection": ("p", "detection"), "no boxes wanted": ("q", "consistency")}
    told = F.array(*(F.struct(F.lit(name).alias("kind"), scoring.details(F.col(c), F.lit(0.5), kind).alias("x")) for name, (c, kind) in kinds.items()))
    each = rows.select("event_id", F.explode(told).alias("e"))
    return each.select("event_id", "e.kind", *(_r(f"e.x.{n}").alias(n.lower()) for n in ("C", "R2", "R3", "R4", "reward")))


@query(_adv_sql("CASE WHEN n > 1 THEN (s - m) / (sd + 1e-6) ELSE s / (1 + 1e-6) END"))
def dispatched_advantage(spark, d):
    """An estimator found by its name."""
    return _adv(adv.compute_advantage(_lines(spark, d), "grpo", group="l_orderkey", score="score"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def unpadded(spark, d):
    """Rows padded to a divisor and without their padding again."""
    rows = shapes.with_position(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return shapes.unpad(shapes.pad_to_divisor(rows, 64, rows.count()))


@query("SELECT conv_id, sum(CASE WHEN k > 2 THEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) ELSE 0 END)::INT AS words FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def following_words(spark, d):
    """Words of a conversation's turns after its second one."""
    own = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return own.select("conv_id", text.future_words(F.col("turns"), F.lit(2)).alias("words"))


@query("SELECT event_id, round(least(-(event_id % 500 - 300) / 100.0, 0), 4) + 0.0 AS penalty FROM events")
def overlong_penalty(spark, d):
    return _t(spark, d, "events").select("event_id", _r(scoring.overlong_penalty(F.col("event_id") % 500, 400, 100)).alias("penalty"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 4) + 0.0 AS cosine FROM embeddings")
def cosine_to_first(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    first = e.orderBy("vec_id").limit(1).select(F.col("x").alias("y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return e.crossJoin(F.broadcast(first)).select("vec_id", _r(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))).alias("cosine"))


@query("SELECT event_id, 'look' AS name, '{\"id\": ' || event_id || '}' AS arguments FROM events")
def tool_calls(spark, d):
    e = F.col("event_id").cast("string")
    t = F.concat(F.lit("<function=look><parameter=id>"), e, F.lit("</parameter></function>"))
    return _t(spark, d, "events").select("event_id", F.explode(parsers.tool_calls(t, "function_xml")).alias("c")).select("event_id", "c.*")


@query("SELECT event_id, '\\frac{' || (event_id % 9 + 1) || '}{2}' AS form, event_id % 9 + 1 = 3 AS equal FROM events")
def math_forms(spark, d):
    t = F.concat(F.lit("so \\boxed{\\frac"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("2}"))
    return _t(spark, d, "events").select("event_id", parsers.latex_plain(parsers.boxed_answer(t)).alias("form"), parsers.math_equal(parsers.boxed_answer(t), F.lit("1.5")).alias("equal"))


# Packing.


@query("SELECT doc_id // 256 AS batch, count(*) AS rows, sum(n_chars)::BIGINT AS load, true AS balanced FROM documents GROUP BY 1")
def balanced_parts(spark, d):
    """Every document has a part, and no two parts of a batch differ by more than the largest load."""
    rows = _t(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 256).alias("batch"), F.col("n_chars").alias("load"))
    parts = packing.partition(rows, ["batch"], "doc_id", "load", lambda x: packing.differencing(x, 8)).groupBy("batch", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("s"), F.max("load").alias("big"))
    return parts.groupBy("batch").agg(F.sum("n").alias("rows"), F.sum("s").alias("load"), ((F.max("s") - F.min("s") <= F.max("big")) & (F.max("part") < 8)).alias("balanced"))


@query("SELECT doc_id // 256 AS batch, count(*) AS rows, sum(n_chars)::BIGINT AS load, true AS within FROM documents GROUP BY 1")
def token_budget_batches(spark, d):
    """Every document has a batch, and none is over the budget."""
    rows = _t(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 256).alias("batch"), F.col("n_chars").alias("load"))
    parts = packing.partition(rows, ["batch"], "doc_id", "load", lambda x: packing.micro_batches(x, max(200_000, max(x)))).groupBy("batch", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("s"), F.max("load").alias("big"))
    return parts.groupBy("batch").agg(F.sum("n").alias("rows"), F.sum("s").alias("load"), F.bool_and(F.col("s") <= F.greatest(F.lit(200_000), F.col("big"))).alias("within"))


@query("SELECT o_orderkey, 24576 * (o_orderkey % 1000) + (o_orderkey % 1000) * (o_orderkey % 1000) AS load FROM orders")
def workloads(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", packing.workload(F.col("o_orderkey") % 1000).alias("load"))


# Life-cycles.


def _events(spark, d) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 10 == 9, "failure").when(e % 10 >= 2, "finished").otherwise("running")
    return _t(spark, d, "events").select(F.col("user_id").cast("string").alias("uid"), (e % 4).alias("session"), F.lit(0).alias("idx"), status.alias("status"), F.floor(e / 100).alias("global_step"), F.when(status == "finished", F.floor(F.col("value") / 50)).alias("metric"), e.alias("seq"))


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS uid, event_id % 4 AS session, CASE WHEN event_id % 10 = 9 THEN 'failure' WHEN event_id % 10 >= 2 THEN 'finished' ELSE 'running' END AS status, event_id // 100 AS step, event_id AS seq, floor(value / 50) AS m FROM events),
    l AS (SELECT uid, session, arg_max(status, seq) AS status, arg_max(m, seq) AS m, min(step) AS born FROM e GROUP BY ALL),
    g AS (SELECT uid, count(*) AS n, count(*) FILTER (status IN ('finished', 'failure')) >= 3 AS ended, bool_or(status = 'failure') AS failed, min(born) AS born, min(m) FILTER (status = 'finished') AS lo, max(m) FILTER (status = 'finished') AS hi FROM l GROUP BY uid)
    SELECT uid, CASE WHEN NOT ended THEN NULL WHEN 100 - born + 1 > 90 THEN 'stale' WHEN failed THEN 'failed' WHEN n > 1 AND lo = hi THEN 'constant' END AS reason FROM g"""
)
def lifecycle_evictions(spark, d):
    return lifecycle.evictions(lifecycle.group_states(_events(spark, d), 3), 100, 90).select("uid", "reason")


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS uid, event_id % 4 AS session, CASE WHEN event_id % 10 = 9 THEN 'failure' WHEN event_id % 10 >= 2 THEN 'finished' ELSE 'running' END AS status, event_id // 100 AS step, event_id AS seq, floor(value / 50) AS m FROM events),
    l AS (SELECT uid, session, arg_max(status, seq) AS status, arg_max(m, seq) AS m, min(step) AS born FROM e GROUP BY ALL),
    g AS (SELECT uid, count(*) AS n, count(*) FILTER (status IN ('finished', 'failure')) >= 3 AS ended, bool_or(status = 'failure') AS failed, min(born) AS born, min(m) FILTER (status = 'finished') AS lo, max(m) FILTER (status = 'finished') AS hi FROM l GROUP BY uid),
    r AS (SELECT uid, born, count(*) OVER () AS c FROM g WHERE ended AND NOT failed AND NOT (n > 1 AND lo IS NOT DISTINCT FROM hi)) SELECT uid, born FROM r WHERE c >= 4 ORDER BY born, uid LIMIT 4"""
)
def lifecycle_sample(spark, d):
    return lifecycle.sample_groups(lifecycle.group_states(_events(spark, d), 3), 100, 4)[0].select("uid", "born")


# Over literal cases, files, and the rest.

for _more in (cases, files, more, streams):
    QUERIES.update(_more.QUERIES)
    ORACLE_SQL.update(_more.ORACLE_SQL)
