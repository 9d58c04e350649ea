"""Queries that write and read files: JSON lines, steps, trees, checkpoints, rewrites, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import sources
from ..operators import matching, shapes

QUERIES: dict[str, object] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_EVENT = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("event_type", StringType())])


@query("SELECT event_id, user_id, event_type FROM events")
def jsonl_scan(spark, d):
    folder = sources.work_folder(spark, "jsonl")
    _t(spark, d, "events").select("event_id", "user_id", "event_type").write.json(folder)
    return sources.read_jsonl(spark, folder, _EVENT)


_LINE = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '{broken' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '  ' ELSE '{\"event_id\": ' || event_id || '}' END"


@query("SELECT CASE event_id % 6 WHEN 1 THEN 'malformed' WHEN 2 THEN 'not_an_object' ELSE 'blank_line' END AS reason, count(*) AS n FROM events WHERE event_id % 6 < 4 GROUP BY 1")
def jsonl_skip_reasons(spark, d):
    folder = sources.work_folder(spark, "lines")
    _t(spark, d, "events").select(F.expr(_LINE).alias("value")).write.text(folder)
    return sources.skip_reasons(sources.read_lines(spark, folder, "event_id long"))


@query("SELECT event_id, line FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) AS line FROM events) WHERE event_id % 6 >= 4")
def jsonl_line_numbers(spark, d):
    """Lines keep their numbers in their files: seven files of records, blank lines and others, each in the order of its ids."""
    folder = sources.work_folder(spark, "numbered")
    lines = _t(spark, d, "events").select((F.col("event_id") % 7).alias("step"), F.expr(_LINE).alias("value"), "event_id")
    sources.write_step_lines(lines, folder, ["event_id"])
    return sources.read_lines(spark, folder, "event_id long").where("reason IS NULL").select("record.event_id", "line")


@query("SELECT event_id, value, event_type, event_id // 1000 AS step, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY user_id, event_id) AS line FROM events")
def step_files(spark, d):
    """A file {step}.jsonl for every thousand events, written and read by the data source; other files aren't read."""
    folder = sources.work_folder(spark, "steps")
    rows = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.floor(F.col("event_id") / 1000).alias("step"))
    sources.write_steps(rows, folder, order=["user_id", "event_id"])
    sources.Files(spark).write(f"{folder}/other.jsonl", '{"event_id": -1}\n')
    return sources.read_step_records(spark, folder, "event_id long, event_type string, value double").select("event_id", "value", "event_type", "step", "line")


@query("SELECT event_id // 1000 AS step, count(*) AS n, min(event_id) AS first FROM events WHERE event_id // 1000 >= 3 AND event_id // 1000 <> 5 GROUP BY 1")
def later_steps(spark, d):
    """Steps that are written again replace theirs; a filter on step leaves files out before they are opened."""
    folder = sources.work_folder(spark, "steps")
    rows = _t(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("step"))
    sources.write_steps(rows.where("event_id % 2 = 0"), folder, order=["event_id"])
    sources.write_steps(rows, folder, order=["event_id"])
    got = sources.read_step_records(spark, folder, "event_id long").where("step >= 3 AND step <> 5")
    return got.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'one' ELSE 'two' END AS source FROM events")
def mixed_tree(spark, d):
    root, rows = sources.work_folder(spark, "tree"), _t(spark, d, "events").select("event_id")
    rows.where("event_id % 2 = 0").write.parquet(f"{root}/one/parquet")
    rows.where("event_id % 2 = 1").write.json(f"{root}/two/lines")
    files = sources.Files(spark)
    for i, name in enumerate(files.list(f"{root}/two/lines", ".json")):
        files.copy(name, f"{root}/two/{i}.jsonl")
    return sources.read_tree(spark, root, ["event_id"]).select(F.col("event_id").cast("long").alias("event_id"), "source")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1 AS row FROM orders QUALIFY row % 100 = 7")
def parquet_rows_by_number(spark, d):
    """Rows at given numbers over all files of a table that is written in order."""
    folder = sources.work_folder(spark, "ordered")
    placed = shapes.with_position(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], "at")
    placed.withColumn("part", F.floor(F.col("at") / 1000)).repartitionByRange("at").sortWithinPartitions("at").drop("part").write.parquet(folder)
    rows = sources.parquet_rows(spark, folder, ["o_orderkey"], across=True)
    wanted = spark.range(0, placed.count()).where("id % 100 = 7").select(F.col("id").alias("row"))
    return sources.rows_at(rows, wanted, ("row",)).select("o_orderkey", "row")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def checkpoint_read_last(spark, d):
    """Records appended in two runs; a key's last one counts."""
    folder, rows = sources.work_folder(spark, "checkpoint"), _t(spark, d, "events").select("user_id", "event_id")
    for k in range(2):
        sources.append_checkpoint(rows.where(f"event_id % 2 = {k}"), folder)
    return matching.last_wins(spark.read.schema("user_id long, event_id long").json(folder), "user_id", ["event_id"]).select("user_id", "event_id")


@query("SELECT n_nationkey, n_name, n_nationkey * 2 AS twice FROM nation")
def rewritten_table(spark, d):
    """Rewritten twice in place, verified each time."""
    folder = sources.work_folder(spark, "rewritten")
    source = f"{folder}/in"
    _t(spark, d, "nation").select("n_nationkey", "n_name").write.parquet(source)
    for _ in range(2):
        sources.rewrite_parquet(spark, source, f"{folder}/out", lambda x: x.withColumn("twice", F.col("n_nationkey") * 2), F.col("twice") == 2 * F.col("n_nationkey"))
    return spark.read.parquet(f"{folder}/out")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def summary_files(spark, d):
    folder = sources.work_folder(spark, "summary")
    sources.write_summary(_t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), folder)
    one, other = spark.read.option("header", "true").schema("event_type string, n long").csv(f"{folder}/csv"), spark.read.schema("event_type string, n long").json(f"{folder}/json")
    return one.intersect(other)


@query("SELECT event_type AS key, round(avg(value), 4) AS value FROM events GROUP BY 1")
def metric_sinks(spark, d):
    folder = sources.work_folder(spark, "metrics")
    metrics = _t(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.round(F.avg("value"), 4).alias("value"))
    sources.write_metrics(metrics, {"parquet": lambda m: m.write.parquet(f"{folder}/p"), "lines": lambda m: m.write.json(f"{folder}/j")})
    return spark.read.parquet(f"{folder}/p").intersect(spark.read.schema("key string, value double").json(f"{folder}/j"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def discovered_files(spark, d):
    """Folders of a fixed list: the files of those that are there."""
    root, nation = sources.work_folder(spark, "data"), _t(spark, d, "nation").select("n_nationkey", "n_name")
    nation.where("n_nationkey < 5").write.parquet(f"{root}/a")
    nation.where("n_nationkey BETWEEN 5 AND 9").write.parquet(f"{root}/b")
    files, missing = sources.discover(spark, root, ["a", "gone", "b"])
    assert missing == ["gone"]
    return spark.read.parquet(*files)


@query("SELECT n_nationkey, n_name FROM nation")
def copied_file(spark, d):
    folder, files = sources.work_folder(spark, "copy"), sources.Files(spark)
    _t(spark, d, "nation").select("n_nationkey", "n_name").write.parquet(f"{folder}/a")
    files.copy(f"{folder}/a", f"{folder}/b")
    assert files.exists(f"{folder}/b") and not files.exists(f"{folder}/c")
    return spark.read.parquet(f"{folder}/b")


@query("SELECT o_orderkey, length(o_orderpriority) AS tokens FROM orders WHERE length(o_orderpriority) <= 8 ORDER BY ('0x' || md5('5_' || o_orderkey)[1:13])::BIGINT, o_orderkey LIMIT 40")
def loaded_rollouts(spark, d):
    folder = sources.work_folder(spark, "rollouts") + ".parquet"
    _t(spark, d, "orders").select("o_orderkey", F.length("o_orderpriority").cast("long").alias("tokens")).write.parquet(folder)
    return sources.load_rollouts(spark, [folder], F.col("tokens"), 8, 40, 5, "o_orderkey")


@query("SELECT conv_id, max(text) FILTER (turn = 0) AS chosen, max(text) FILTER (turn = 1) AS rejected FROM conversations GROUP BY 1")
def preference_rows(spark, d):
    folder = sources.work_folder(spark, "pairs")
    of = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("prompt")).agg(of(0).alias("chosen"), of(1).alias("rejected")).withColumn("other", F.lit(1)).write.parquet(folder)
    return sources.read_preferences(spark, [folder]).withColumnRenamed("prompt", "conv_id")


@query("SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'assistant' ELSE role END || ':' || coalesce(text, ''), '|' ORDER BY turn) FILTER (coalesce(trim(text), '') <> '') AS told FROM conversations GROUP BY 1 HAVING count(*) FILTER (coalesce(trim(text), '') <> '') > 0")
def conversation_rows(spark, d):
    """Messages whose roles have other names come back under the usual ones."""
    folder, role = sources.work_folder(spark, "chats"), F.when(F.col("role") == "assistant", " GPT ").when(F.col("role") == "user", "human").otherwise(F.col("role"))
    own = F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content"))))
    _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(own, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).write.parquet(folder)
    rows = spark.read.parquet(folder).select("conv_id", sources.normal_messages(F.col("messages")).alias("m")).where(F.size("m") > 0)
    return rows.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("told"))


@query("SELECT n_regionkey, 'm' || (n_nationkey % 2) AS model, max(n_nationkey) AS best FROM nation GROUP BY ALL")
def evaluation_results(spark, d):
    scores = _t(spark, d, "nation").groupBy("n_regionkey", F.concat(F.lit("m"), (F.col("n_nationkey") % 2).cast("string")).alias("model")).agg(F.max("n_nationkey").alias("best"))
    got = sources.write_results(scores, sources.work_folder(spark, "results"), "n_regionkey", "model", ["best"])
    names = got.schema["models"].dataType.fieldNames()
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"models.{m}.best").alias("best")) for m in names)))
    return got.select("n_regionkey", each.alias("x")).select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "x.*").where("best IS NOT NULL").select(F.col("n_regionkey"), "model", "best")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'option missing' WHEN 2 THEN 'detection' WHEN 3 THEN 'unknown source' ELSE 'options conflict' END AS status,
    CASE event_id % 5 WHEN 0 THEN 'yes ' || event_id WHEN 4 THEN 'other' END AS option_a FROM events"""
)
def enriched_options(spark, d):
    k = F.col("event_id") % 5
    prompt = F.concat(F.lit("Q\nA. yes "), F.col("event_id").cast("string"), F.when(k == 1, "").otherwise("\nB. no"))
    own = F.when(k == 4, "other")
    info = F.struct(F.lit("train").alias("split"), own.alias("option_a"), F.when(k == 4, "no").alias("option_b"))
    rows = _t(spark, d, "events").select("event_id", prompt.alias("p"), F.when(k == 2, "d").when(k == 3, "?").otherwise("g").alias("src"), info.alias("info"))
    return sources.enrich_options(rows, F.col("p"), "info", "src", {"g"}, {"d"}).select("event_id", "status", "info.option_a")


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS option_a FROM nation")
def added_fields(spark, d):
    rows = _t(spark, d, "nation").select("n_nationkey", F.struct("n_name").alias("info"))
    return sources.with_fields(rows, "info", sources.OPTION_FIELDS).select("n_nationkey", "info.n_name", "info.option_a")


@query(
    """SELECT 'set' AS data_source, 'What is ' || n_name || '?' AS question, 'geo' AS ability, n_name AS truth, n_nationkey::BIGINT AS index FROM nation
    UNION ALL SELECT 'searchR1_web', r_name, 'fact-reasoning', 'x' || r_name, r_regionkey::BIGINT FROM region"""
)
def training_rows(spark, d):
    """Two sources through their own maps, under one schema."""

    def plain(df):
        rows = sources.to_rl_rows(df, "set", F.concat(F.lit("What is "), F.col("n_name"), F.lit("?")), F.col("n_name"), "geo", "train", F.col("n_nationkey"))
        return rows.select("data_source", F.col("prompt")[0]["content"].alias("question"), "ability", F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("index"))

    def search(df):
        rows = sources.search_rows(df, F.lit("web"), F.col("r_name"), F.array(F.concat(F.lit("x"), F.col("r_name"))), "train", F.col("r_regionkey"), "Search first.")
        return rows.select("data_source", F.col("extra_info.tools_kwargs.search.create_kwargs.question").alias("question"), "ability", F.col("reward_model.ground_truth.target")[0].alias("truth"), F.col("extra_info.index").alias("index"))

    return sources.mapped_union([(_t(spark, d, "nation"), plain), (_t(spark, d, "region"), search)])


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'missing_input_or_output' WHEN 1 THEN 'no_ab_options' WHEN 2 THEN 'missing_think_end' WHEN 3 THEN 'empty_thinking' WHEN 4 THEN 'missing_final_answer' END AS reason,
    CASE event_id % 6 WHEN 5 THEN 'B' END AS answer, CASE event_id % 6 WHEN 5 THEN 'So B ' || event_id || '.' END AS last_sentence FROM events"""
)
def parsed_records(spark, d):
    k, i = F.col("event_id") % 6, F.col("event_id").cast("string")
    prompt = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "Q\nA. x").otherwise("Q\nA. x\nB. y")
    output = F.when(k == 2, "no end").when(k == 3, '<think> </think>{"answer": "A"}').when(k == 4, "<think>a</think>{}").otherwise(F.concat(F.lit("<think>First. So B "), i, F.lit('.</think>{"answer": "a"} {"answer": "b"}')))
    return sources.parse_records(_t(spark, d, "events").select("event_id", prompt.alias("input"), output.alias("output"))).select("event_id", "reason", "answer", "last_sentence")


@query("SELECT event_id, 'text:see |image:i' || event_id || '|text: and |image:j|text:it is A' AS told FROM events")
def bound_images(spark, d):
    images = F.array(F.concat(F.lit("i"), F.col("event_id").cast("string")), F.lit("j"))
    rows = _t(spark, d, "events").select("event_id", sources.revealed(sources.bound_media(F.lit("see <image> and <image>"), images), F.lit("it is A")).alias("p"))
    return rows.select("event_id", F.array_join(F.transform("p", lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["text"], x["item"]))), "|").alias("told"))


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'g' END, CASE WHEN n_nationkey % 3 = 0 THEN 't' END, CASE WHEN n_nationkey % 5 = 0 THEN 'm' END) AS truth FROM nation")
def coalesced_truths(spark, d):
    k = F.col("n_nationkey")
    rows = _t(spark, d, "nation").select("n_nationkey", F.struct(F.when(k % 5 == 0, "m").alias("ground_truth")).alias("reward_model"), F.when(k % 3 == 0, "t").alias("gt"), F.when(k % 2 == 0, "g").alias("gts"))
    return rows.select("n_nationkey", sources.truth_of(rows).alias("truth"))


@query("SELECT n_nationkey, n_name || chr(10) || 'see ' || n_nationkey || chr(10) || 'end' AS flat FROM nation")
def nested_prompts(spark, d):
    from ..functions.text import prompt_text

    part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    turns = F.array(F.struct(F.lit("user").alias("role"), F.array(part(F.col("n_name")), part(F.concat(F.lit("see "), F.col("n_nationkey").cast("string")))).alias("content")), F.struct(F.lit("assistant").alias("role"), F.array(part(F.lit("end"))).alias("content")))
    rows = _t(spark, d, "nation").select("n_nationkey", F.struct(turns.alias("messages")).alias("prompt"))
    return rows.select("n_nationkey", prompt_text(rows, "prompt").alias("flat"))
