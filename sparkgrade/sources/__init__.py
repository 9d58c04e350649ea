"""Readers and writers: JSON lines, directories of steps, trees of sources, checkpoints, Parquet rewrites, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .steps import read_step_lines, read_step_records, write_step_lines, write_steps

__all__ = ["read_step_lines", "read_step_records", "write_step_lines", "write_steps"]

def read_jsonl(spark: SparkSession, path: str, schema: StructType | None = None, strict: bool = True) -> DataFrame:
    """Objects of JSON lines; blank lines are skipped. strict: anything else is an error when run."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (from 1), record, reason of every line: why a line has no record (blank_line, malformed, not_an_object), or null.

    Files are read in splits. A line's number is its place in its split, after the lines of the
    splits before it in the file, so no file is held in one row or one task.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))
    counts = text.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = text.withColumn("_i", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")))
    text = placed.join(starts, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).select("file", (F.col("_before") + F.col("_i")).alias("line"), "text")
    bare = F.btrim(F.col("text"), F.lit(" \t\r\n"))
    parsed = F.from_json("text", schema, {"mode": "PERMISSIVE"})
    reason = F.when(bare == "", "blank_line").when(F.try_parse_json(bare).isNull(), "malformed").when(~bare.startswith("{"), "not_an_object")
    return text.select("file", "line", reason.alias("reason"), F.when(reason.isNull(), parsed).alias("record"))


def skip_reasons(lines: DataFrame) -> DataFrame:
    return lines.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_steps(spark: SparkSession, folder: str, schema: StructType | None = None) -> DataFrame:
    """Rows of files {number}.jsonl with the number as step; other files aren't read."""
    reader = spark.read.option("mode", "FAILFAST").option("pathGlobFilter", "[0-9]*.jsonl")
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.json(folder)
    step = F.regexp_extract("_metadata.file_name", r"^(\d+)\.jsonl$", 1)
    own = [F.col(f"`{c}`") for c in rows.columns if c != "step"]  # a record's own step gives way to its file's
    return rows.select(*own, F.nullif(step, F.lit("")).cast("long").alias("step")).where("step IS NOT NULL")


def read_tree(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """The columns of all JSON lines and Parquet files below root, with source, the first folder below it."""
    out = None
    for kind, pattern in (("json", "*.jsonl"), ("parquet", "*.parquet")):
        try:
            own = getattr(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern), kind)(root)
        except Exception as e:  # no file of the kind
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        kept = own.select(*(c for c in columns if c in own.columns), F.regexp_extract("_metadata.file_path", rf"{root.rstrip('/').split('://')[-1]}/([^/]+)/", 1).alias("source"))
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(root)
    return out


def discover(spark: SparkSession, root: str, names: list[str]) -> tuple[list[str], list[str]]:
    """(the Parquet files of the named folders below root, in order; the folders that have none)."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    found, missing = [], []
    for name in names:
        at = fs.Path(f"{root.rstrip('/')}/{name}")
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        own = [str(f.getPath()) for f in store.listStatus(at) if str(f.getPath()).endswith(".parquet")] if store.exists(at) else []
        found += sorted(own)
        if not own:
            missing.append(name)
    return found, missing


def parquet_rows(spark: SparkSession, path: str, columns: list[str], across: bool = False) -> DataFrame:
    """The columns, with file and row_index, a row's number in its file; across: also row, its number over all files in the order of their names."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    if not across:
        return rows
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col("file").alias("_f"), F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(starts, F.col("file") == F.col("_f")).select(*columns, "file", "row_index", (F.col("_start") + F.col("row_index")).alias("row"))


def rows_at(rows: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ("file", "row_index")) -> DataFrame:
    """Rows at given files and row numbers (or by=("row",): at numbers over all files)."""
    return rows.join(wanted.select(*by), list(by))


def read_mixed(spark: SparkSession, paths: list[str], most: int | None = None, seed: int | None = None, key: str | None = None) -> DataFrame:
    """Parquet, JSON and JSON lines by their endings, one after another; at most `most` rows, by a seeded hash of the key if there is one."""
    out = None
    for p in paths:
        own = spark.read.parquet(p) if p.endswith(".parquet") else spark.read.option("multiLine", str(p.endswith(".json")).lower()).json(p)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if most is None:
        return out
    return out.orderBy(F.xxhash64(F.lit(seed), F.col(key))).limit(most) if seed is not None and key else out.limit(most)


def prompt_length_filter(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most `most` tokens; a length that isn't known drops the row."""
    return df.where(length <= most)


def append_checkpoint(rows: DataFrame, folder: str) -> None:
    """Adds records to a checkpoint folder; readers take a key's last one."""
    rows.write.mode("append").json(folder)


def dump_step(columns: dict[str, list], spark: SparkSession, folder: str, step: int) -> str:
    """Writes one step's columns, lists of one length (else ValueError), as {step}.jsonl; returns the path. The rows are one batch, and small."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError(f"lengths differ: { {k: len(v) for k, v in columns.items()} }")
    import json

    rows = [dict(zip(columns, r, strict=True)) | {"step": step} for r in zip(*columns.values(), strict=True)]
    files = Files(spark)
    files.make(folder)
    target = f"{folder.rstrip('/')}/{step}.jsonl"
    files.write(target, "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
    return target


def write_summary(df: DataFrame, folder: str) -> None:
    """A small summary in one CSV file and one of JSON lines, replaced each time."""
    one = df.coalesce(1)
    one.write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")
    one.write.mode("overwrite").json(f"{folder}/json")


def write_metrics(metrics: DataFrame, sinks: dict[str, object]) -> None:
    """Gives metrics (step, key, value) to every sink, a function of a DataFrame."""
    for sink in sinks.values():
        sink(metrics)


def rewrite_parquet(spark: SparkSession, source: str, target: str, change, check: Column) -> int:
    """Writes change(rows) beside the target, verifies it (as many rows, none for which check isn't true), and then puts it in place."""
    rows = spark.read.parquet(source)
    beside = f"{target}.{uuid.uuid4().hex}"
    change(rows).write.parquet(beside)
    told = spark.read.parquet(beside).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(check, F.lit(False))).alias("bad")).first()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(beside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if told["bad"] or told["n"] != rows.count():
        store.delete(path(beside), True)
        raise ValueError(f"{told['bad']} rows fail the check, {told['n']} rows written")
    # The old table steps aside and goes last, so that one of the two is whole at any time.
    aside = f"{target}.{uuid.uuid4().hex}.old"
    had = store.exists(path(target))
    if had and not store.rename(path(target), path(aside)):
        raise OSError(f"{target} can't be moved")
    if not store.rename(path(beside), path(target)):
        if had:
            store.rename(path(aside), path(target))
        raise OSError(f"{target} can't be put in place")
    if had:
        store.delete(path(aside), True)
    return told["n"]


def write_results(scores: DataFrame, path: str, row: str, model: str, columns: list[str]) -> DataFrame:
    """The evaluation sink: a JSON line for each row with a map of each model's scores; returns what was written, read again."""
    from ..operators.matching import results_map

    results_map(scores, row, model, columns).write.mode("overwrite").json(path)
    return scores.sparkSession.read.json(path)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one where a local session has none."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkgrade-")
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: The columns that may hold a truth, in their order; then the field of reward_model.
TRUTH_COLUMNS = ("gts", "ground_truth", "gt")


def truth_of(df: DataFrame) -> Column:
    """The first of the truth columns that the frame has and that isn't null, then reward_model.ground_truth."""
    found = [F.col(c).cast("string") for c in TRUTH_COLUMNS if c in df.columns]
    if "reward_model" in df.columns and "ground_truth" in df.schema["reward_model"].dataType.fieldNames():
        found.append(F.col("reward_model.ground_truth").cast("string"))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def parse_records(df: DataFrame, prompt: str = "input", output: str = "output") -> DataFrame:
    """Adds option_a, option_b, answer, thinking, last_sentence and reason: the first rule by which a row is no record, or null (then only are the others set)."""
    from ..functions import text

    p, o = F.col(prompt), F.col(output)
    lines = F.filter(text.option_lines(p), lambda x: x["letter"].isNotNull())
    last = lambda letter: (lambda own: F.get(own, F.size(own) - 1)["value"])(F.filter(lines, lambda x: x["letter"] == letter))
    a, b = last("A"), last("B")
    think = text.thinking(o)
    said = F.regexp_extract_all(F.substring_index(o, "</think>", -1), F.lit(r"(?i)\"answer\"\s*:\s*\"\(?([AB])\)?\""), F.lit(1))
    answer = F.upper(F.get(said, F.size(said) - 1))
    reason = (
        F.when(p.isNull() | o.isNull(), "missing_input_or_output").when(a.isNull() | b.isNull(), "no_ab_options").when(~F.contains(o, F.lit("</think>")), "missing_think_end")
        .when(think == "", "empty_thinking").when(answer.isNull(), "missing_final_answer")
    )
    values = {"option_a": text.trimmed(a), "option_b": text.trimmed(b), "answer": answer, "thinking": think, "last_sentence": text.last_sentence_of_paragraph(think)}
    got = df.withColumn("reason", reason)
    return got.select("*", *(F.when(F.col("reason").isNull(), v).alias(n) for n, v in values.items()))


def bound_media(text: Column, images: Column) -> Column:
    """Array of (type, text, item): the parts of a text with the image of each mark in order; an error when run if marks and images aren't as many."""
    from ..functions.text import media_parts

    parts = F.filter(media_parts(text), lambda p: p["type"].isin("text", "image"))
    marks = F.size(F.filter(parts, lambda p: p["type"] == "image"))
    have = F.coalesce(F.size(images), F.lit(0))
    number = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda p: p["type"] == "image"))
    bound = F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.when(p["type"] == "image", F.get(images, number(i))).alias("item")))
    return F.when(marks != have, F.raise_error(F.concat(marks.cast("string"), F.lit(" marks and "), have.cast("string"), F.lit(" images"))).cast("array<struct<type:string,text:string,item:string>>")).otherwise(bound)


def revealed(parts: Column, truth: Column, reveal: bool = True) -> Column:
    """The parts, and where wanted the truth as one more part at the end."""
    return F.concat(parts, F.array(F.struct(F.lit("text").alias("type"), truth.alias("text"), F.lit(None).cast("string").alias("item")))) if reveal else parts


#: The prefix of a search set's source, and its ability.
SEARCH_PREFIX, SEARCH_ABILITY = "searchR1_", "fact-reasoning"


def search_rows(df: DataFrame, source: Column, question: Column, targets: Column, split: str, index: Column, system: str | None = None) -> DataFrame:
    """data_source (with its prefix), prompt, ability, reward_model, extra_info with the arguments of a search tool: rows of a tool-using training set."""
    user = F.struct(F.lit("user").alias("role"), question.alias("content"))
    turns = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), user) if system else F.array(user)
    named = F.concat(F.lit(SEARCH_PREFIX), source)
    truth = F.struct(targets.alias("target"))
    create = F.struct(truth.alias("ground_truth"), question.alias("question"), named.alias("data_source"))
    info = F.struct(F.lit(split).alias("split"), index.cast("long").alias("index"), F.lit(True).alias("need_tools_kwargs"), F.struct(F.struct(create.alias("create_kwargs")).alias("search")).alias("tools_kwargs"))
    return df.select(named.alias("data_source"), turns.alias("prompt"), F.lit(SEARCH_ABILITY).alias("ability"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), info.alias("extra_info"))


def mapped_union(parts: list[tuple[DataFrame, object]]) -> DataFrame:
    """The rows of several sources, each through its own function of a DataFrame, under one schema."""
    out = None
    for df, change in parts:
        own = change(df)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def normal_messages(messages: Column) -> Column:
    """(role, content) in lower-case roles without blanks around them; `human` and `gpt`, as some sets call them, are user and assistant; empty turns go."""
    names = F.create_map(*(F.lit(x) for pair in (("human", "user"), ("gpt", "assistant"), ("bot", "assistant")) for x in pair))
    role = lambda m: F.lower(F.trim(m["role"]))
    out = F.transform(messages, lambda m: F.struct(F.coalesce(names[role(m)], role(m)).alias("role"), m["content"].alias("content")))
    return F.filter(out, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) != "")


def load_rollouts(spark: SparkSession, paths: list[str], length: Column | None = None, longest: int | None = None, most: int | None = None, seed: int | None = None, key: str | None = None) -> DataFrame:
    """Rows of Parquet, JSON and JSON lines; without prompts over `longest` tokens; then at most `most` rows, by a seeded hash of the key if there is one."""
    rows = read_mixed(spark, paths)
    if length is not None and longest is not None:
        rows = prompt_length_filter(rows, length, longest)
    if most is None:
        return rows
    from ..operators.filters import hash_sample

    return hash_sample(rows, most, seed, key) if seed is not None and key else rows.limit(most)


def enrich_options(df: DataFrame, prompt: Column, info: str, source: str, gated: set[str], detection: set[str]) -> DataFrame:
    """Adds option_a and option_b to the info struct of gated sources; status: added, present, detection or an error's message."""
    from ..functions.text import strict_options

    s = F.col(source)
    got = df.withColumn("_o", strict_options(prompt))
    has = {c: c in df.schema[info].dataType.fieldNames() for c in ("option_a", "option_b")}
    own = {c: F.col(f"{info}.{c}") if has[c] else F.lit(None).cast("string") for c in has}
    present = own["option_a"].isNotNull() & own["option_b"].isNotNull()
    equal = (own["option_a"] == F.col("_o.a")) & (own["option_b"] == F.col("_o.b"))
    status = F.when(s.isin(*detection), "detection").when(~s.isin(*gated), "unknown source").when(F.col("_o.error").isNotNull(), F.col("_o.error")).when(present & ~equal, "options conflict").when(present, "present").otherwise("added")
    added = status == "added"
    wide = F.col(info).withField("option_a", F.when(added, F.col("_o.a")).otherwise(own["option_a"])).withField("option_b", F.when(added, F.col("_o.b")).otherwise(own["option_b"]))
    return got.withColumns({"status": status, info: wide}).drop("_o")


def missing_fields(actual: StructType, wanted: StructType) -> list[StructField]:
    """Fields of wanted that actual lacks; TypeError if one has another type."""
    have = {f.name: f for f in actual.fields}
    for f in wanted.fields:
        if f.name in have and have[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return [f for f in wanted.fields if f.name not in have]


def with_fields(df: DataFrame, column: str, wanted: StructType) -> DataFrame:
    """The struct column with the fields that it lacks, as nulls."""
    c = F.col(column)
    for f in missing_fields(df.schema[column].dataType, wanted):
        c = c.withField(f.name, F.lit(None).cast(f.dataType))
    return df.withColumn(column, c)


OPTION_FIELDS = StructType([StructField("option_a", StringType()), StructField("option_b", StringType())])


def to_rl_rows(df: DataFrame, source: str, question: Column, answer: Column, ability: str, split: str, index: Column) -> DataFrame:
    """data_source, prompt, ability, reward_model, extra_info: the rows of a training set."""
    return df.select(
        F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.cast("long").alias("index")).alias("extra_info"),
    )


def chosen_rejected_rows(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows of each pair: prompt, response and which it is."""
    return df.selectExpr(prompt, f"stack(2, 'chosen', {chosen}, 'rejected', {rejected}) AS (kind, response)")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def read_preferences(spark: SparkSession, paths: list[str], prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return spark.read.parquet(*paths).select(prompt, chosen, rejected)


def read_conversations(spark: SparkSession, paths: list[str], messages: str = "messages", tools: str | None = None) -> DataFrame:
    return spark.read.parquet(*paths).select(messages, *([tools] if tools else []))


def scored_group_rows(df: DataFrame, uid: str, columns: list[str]) -> DataFrame:
    """A row for each sample of a group's parallel arrays, with the group's uid."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("sample", "_x")).select(*rest, "sample", *(F.col(f"_x.{c}").alias(c) for c in columns))


class Files:
    """exists, make and copy in any store that Hadoop knows."""

    def __init__(self, spark: SparkSession) -> None:
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        store, p = self._at(path)
        return store.exists(p)

    def make(self, path: str) -> None:
        store, p = self._at(path)
        store.mkdirs(p)

    def list(self, folder: str, ending: str) -> list[str]:
        store, p = self._at(folder)
        return sorted(x for f in store.listStatus(p) if (x := str(f.getPath())).endswith(ending))

    def write(self, path: str, text: str) -> None:
        store, p = self._at(path)
        out = store.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def copy(self, source: str, target: str) -> None:
        (a, p), (b, q) = self._at(source), self._at(target)
        self.fs.FileUtil.copy(a, p, b, q, False, self.conf)
