"""Row scorers and their routing by data source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers, text
from ..functions.registry import REWARDS, SCORERS

#: Weights of a judge's four classes.
JUDGE_WEIGHTS = (1.0, 0.5, 0.25, 0.0)


@SCORERS.register("json_answer")
def json_answer(solution: Column, truth: Column) -> Column:
    return F.coalesce((text.flat_json_answer(solution) == text.truth_answer(truth)).cast("double"), F.lit(0.0))


@SCORERS.register("last_number")
def last_number_score(solution: Column, truth: Column, strict: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    got = text.last_number(solution, strict)
    return F.when(got.isNull(), 0.0).when(got == truth, score).otherwise(format_score)


@SCORERS.register("exact_match")
def exact_match(prediction: Column, golden: Column) -> Column:
    """Whether any golden answer (array) equals the prediction, both normalised."""
    p = text.qa_normal(prediction)
    return F.coalesce(F.exists(golden, lambda g: text.qa_normal(g) == p), F.lit(False)).cast("double")


@SCORERS.register("substring_match")
def substring_match(prediction: Column, golden: Column) -> Column:
    p = text.qa_normal(prediction)
    return F.coalesce(F.exists(golden, lambda g: F.contains(p, text.qa_normal(g))), F.lit(False)).cast("double")


@SCORERS.register("tagged_exact_match")
def tagged_exact_match(solution: Column, golden: Column, most_tags: int = 10) -> Column:
    """Exact match of the last tagged answer; a quarter if the text abuses tags."""
    tags = lambda t: F.size(F.split(solution, t)) - 1
    own = exact_match(text.tagged_answer(solution), golden)
    return F.when((tags("<answer>") > most_tags) | (tags("</answer>") > most_tags), own / 4).otherwise(own)


@SCORERS.register("boxed_sign")
def boxed_sign(solution: Column, truth: Column, tail: int = 300) -> Column:
    """1 if the boxed answer of the text's end has the normal form of the truth, else -1."""
    got = parsers.final_answer_text(parsers.boxed_answer(F.right(solution, F.lit(tail))))
    return F.when(F.coalesce(got == parsers.final_answer_text(truth), F.lit(False)), 1.0).otherwise(-1.0)


@SCORERS.register("minerva")
def minerva(solution: Column, truth: Column) -> Column:
    """1 if the stated answer has the truth's normal form, else -1."""
    return parsers.minerva_score(solution, truth)["score"]


@SCORERS.register("boxed_exact")
def boxed_exact(solution: Column, truth: Column) -> Column:
    """1 if the last box holds exactly the truth, else 0 (as for counts of characters)."""
    return F.coalesce((parsers.boxed_answer(solution) == truth).cast("double"), F.lit(0.0))


@SCORERS.register("boxed_true")
def boxed_true(response: Column, truth: Column | None = None) -> Column:
    """A generative judge's verdict: 1 if the last box of its response holds True."""
    return boxed_exact(response, F.lit("True"))


@SCORERS.register("latex_equal")
def latex_equal(solution: Column, truth: Column) -> Column:
    return F.coalesce(parsers.latex_plain(parsers.boxed_answer(solution)) == parsers.latex_plain(truth), F.lit(False)).cast("double")


@SCORERS.register("math_equal")
def math_equal_score(solution: Column, truth: Column) -> Column:
    return F.coalesce(parsers.math_equal(F.coalesce(parsers.boxed_answer(solution), solution), truth), F.lit(False)).cast("double")


@SCORERS.register("choice")
def choice(solution: Column, truth: Column) -> Column:
    return F.coalesce(text.choice_letter(solution) == truth, F.lit(False)).cast("double")


def blend(accuracy: Column, form: Column, format_share: float = 0.1) -> Column:
    return (1 - format_share) * accuracy + format_share * form


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to most - buffer, then falling without a lower bound."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def tool_bonus(score: Column, turns: Column) -> Column:
    """A wrong answer's score, raised by turns to -0.6 at most."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


def judge_score(prediction: Column, truth: Column, probabilities: Column) -> Column:
    """Blank: 0; equal but for case: 1; else the judge's class probabilities, weighted."""
    weighted = F.aggregate(F.transform(probabilities, lambda p, i: p * F.get(F.array(*map(F.lit, JUDGE_WEIGHTS)), i)), F.lit(0.0), lambda a, x: a + x)
    blank = (F.trim(F.coalesce(prediction, F.lit(""))) == "") | (F.trim(F.coalesce(truth, F.lit(""))) == "")
    return F.when(blank, 0.0).when(F.lower(F.trim(prediction)) == F.lower(F.trim(truth)), 1.0).otherwise(weighted)


def with_judge(df: DataFrame, prediction: str, truth: str, judge: DataFrame) -> DataFrame:
    """Adds judged: each different pair that needs it meets the judge's table (prediction, truth, probabilities) once."""
    pairs = df.select(prediction, truth).distinct()
    told = pairs.join(judge, (pairs[prediction] == judge["prediction"]) & (pairs[truth] == judge["truth"]), "left").select(pairs[prediction].alias("_p"), pairs[truth].alias("_t"), judge_score(pairs[prediction], pairs[truth], judge["probabilities"]).alias("judged"))
    return df.join(told, F.col(prediction).eqNullSafe(F.col("_p")) & F.col(truth).eqNullSafe(F.col("_t")), "left").drop("_p", "_t")


def _failed(condition: Column, message: str, value: Column) -> Column:
    """value, or an error when run where the condition is true."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def gate_questions(df: DataFrame, key: str, source: str, solution: str, truth: str, prompt: str, gated: set[str], option_a: str | None = None, option_b: str | None = None) -> DataFrame:
    """key, gated, right, said (the answer), sentence, option_a, option_b of each row: all that the reasoning gate needs before the judge.

    Only rows of gated sources with a right answer and a last sentence have a sentence. Such a
    row whose prompt states no two options (or a given pair) is an error when run.
    """
    said, wanted = text.flat_json_answer(F.col(solution)), text.truth_answer(F.col(truth))
    is_gated = F.col(source).isin(*gated)
    right = is_gated & F.coalesce(said == wanted, F.lit(False))
    sentence = F.nullif(text.last_sentence(text.thinking(F.col(solution))), F.lit(""))
    got = df.select(F.col(key).alias("_key"), is_gated.alias("gated"), right.alias("right"), said.alias("said"), F.when(right, sentence).alias("sentence"), *(F.col(c) if c else F.lit(None).cast("string").alias(n) for c, n in ((option_a, "_a"), (option_b, "_b"))), F.col(prompt).alias("_prompt"))
    a, b = (option_a or "_a"), (option_b or "_b")
    options = text.lenient_options(F.col("_prompt"), F.col(a), F.col(b))
    asked = F.col("sentence").isNotNull()
    told = got.select("_key", "gated", "right", "said", "sentence", F.when(asked, options).alias("_o"))
    return told.select(F.col("_key").alias(key), "gated", "right", "said", "sentence", *(_failed(asked & F.col("_o.error").isNotNull(), "a gated prompt states no two options", F.col(f"_o.{x}")).alias(f"option_{x}") for x in "ab"))


def reasoning_gate(df: DataFrame, key: str, source: str, solution: str, truth: str, prompt: str, base: Column, judge: DataFrame, gated: set[str], option_a: str | None = None, option_b: str | None = None) -> DataFrame:
    """key, score, R1, reasoning_gate, reasoning_gate_applied, reasoning_malformed, reasoning_unclear_probability.

    judge: (sentence, option_a, option_b, option, unclear), each question once; only rows that
    need it meet it, and one that it lacks, or an answer other than A, B and U or a probability
    outside 0 to 1, is an error when run. base is the score where no gate closes: rows of other
    sources have it at once; a wrong answer, no thinking and another option give 0.
    """
    asked = gate_questions(df, key, source, solution, truth, prompt, gated, option_a, option_b)
    told = judge.select(F.col("sentence").alias("_s"), F.col("option_a").alias("_qa"), F.col("option_b").alias("_qb"), F.upper(F.trim("option")).alias("_option"), F.col("unclear").cast("double").alias("_unclear"), F.lit(True).alias("_told"))
    met = asked.join(told, (F.col("sentence") == F.col("_s")) & (F.col("option_a") == F.col("_qa")) & (F.col("option_b") == F.col("_qb")), "left")
    need = F.col("sentence").isNotNull()
    option = _failed(need & F.col("_told").isNull(), "the judge lacks a question", _failed(need & ~F.coalesce(F.col("_option").isin("A", "B", "U"), F.lit(False)), "the judge's option isn't A, B or U", F.col("_option")))
    unclear = F.when(need & ~F.coalesce(F.col("_unclear").between(0, 1), F.lit(False)), F.raise_error(F.lit("the judge's probability isn't one")).cast("double")).otherwise(F.col("_unclear"))
    opened = F.when(need, ((option == "U") | (option == F.upper("said"))).cast("double"))
    flag = lambda c: c.cast("double")
    gates = met.select(
        F.col(key).alias("_key"), "gated", flag(~F.col("gated") | F.col("right")).alias("R1"), F.when(~F.col("gated"), 1.0).otherwise(F.coalesce(opened, F.lit(0.0))).alias("reasoning_gate"),
        flag(F.col("gated") & F.col("right")).alias("reasoning_gate_applied"), flag(F.col("gated") & F.col("right") & ~need).alias("reasoning_malformed"), F.coalesce(F.when(need, unclear), F.lit(0.0)).alias("reasoning_unclear_probability"),
    )
    joined = df.join(gates, F.col(key) == F.col("_key"))
    score = F.when(F.col("reasoning_gate") == 1, base).otherwise(0.0)
    return joined.select(F.col(key), score.cast("double").alias("score"), "R1", "reasoning_gate", "reasoning_gate_applied", "reasoning_malformed", "reasoning_unclear_probability")


def summaries(solution: Column, truth: Column) -> Column:
    """Struct (given, wanted, asks): the summaries of both last JSON objects, and whether both hold text, so that the judge is asked."""
    own = lambda c: F.get_json_object(parsers.last_object_json(c), "$.summary")
    a, b = own(solution), own(truth)
    asks = F.coalesce((F.trim(a) != "") & (F.trim(b) != ""), F.lit(False))
    return F.struct(a.alias("given"), b.alias("wanted"), asks.alias("asks"))


def details(parts: Column, judged: Column, kind: str) -> Column:
    """Struct (C, R2, R3, R4, reward) of one row, null where a kind has no such part. parts: boxes.box_parts(); judged: the summary's score, 0 if it isn't asked.

    kind: answer, hungarian (parts is then the score itself), consistency or detection.
    """
    null = F.lit(None).cast("double")
    pack = lambda c=null, r2=null, r3=null, r4=null, reward=null: F.struct(c.cast("double").alias("C"), r2.cast("double").alias("R2"), r3.cast("double").alias("R3"), r4.cast("double").alias("R4"), reward.cast("double").alias("reward"))
    if kind == "answer":
        return pack(c=parts, reward=parts)
    if kind == "hungarian":
        return pack(r2=parts, reward=parts)
    from ..functions import boxes

    if kind == "detection":
        return pack(r2=parts["region"], r3=parts["label"], r4=judged, reward=boxes.detection_score(parts, judged))
    if kind == "consistency":
        none = parts["wanted"] == 0
        return F.when(none, pack(c=parts["same"], reward=boxes.consistency_score(parts, judged))).otherwise(pack(parts["same"], parts["region"], parts["label"], judged, boxes.consistency_score(parts, judged)))
    raise ValueError(kind)


def answer_and_summary(df: DataFrame, source: str, correct: Column, judged: Column, answer_only: set[str], with_summary: set[str], boxes_only: set[str]) -> DataFrame:
    """Adds C and R4 by source: the answer alone, both, or (sources that have boxes only, and unknown ones) an error when run."""
    s = F.col(source)
    c = F.when(s.isin(*boxes_only), F.raise_error(F.lit("a source of boxes alone has neither answer nor summary")).cast("double")).when(s.isin(*answer_only, *with_summary), correct).otherwise(F.raise_error(F.concat(F.lit("unknown source: "), s)).cast("double"))
    return df.select("*", c.alias("C"), F.when(s.isin(*with_summary), judged).alias("R4"))


def deferred(df: DataFrame, source: str, solution: str, truth: str, kinds: dict[str, str]) -> DataFrame:
    """First phase of a decomposition: adds the parts that need no judge, and given, wanted (the pair that does; null where none is asked).

    kinds: answer, hungarian, consistency or detection of each source; another source is an error when run.
    """
    from ..functions import boxes

    s = F.col(source)
    kind = F.raise_error(F.concat(F.lit("unknown source: "), s)).cast("string")
    for name, k in kinds.items():
        kind = F.when(s == name, k).otherwise(kind)
    got = df.select("*", kind.alias("kind"), json_answer(F.col(solution), F.col(truth)).alias("answer"), boxes.hungarian_iou(solution, F.col(truth)).alias("hungarian"), boxes.box_parts(F.col(solution), F.col(truth)).alias("parts"), summaries(F.col(solution), F.col(truth)).alias("_pair"))
    asks = F.col("_pair.asks") & ((F.col("kind") == "detection") | ((F.col("kind") == "consistency") & (F.col("parts.wanted") > 0)))
    return got.select("*", F.when(asks, F.col("_pair.given")).alias("given"), F.when(asks, F.col("_pair.wanted")).alias("wanted")).drop("_pair")


def decomposed(df: DataFrame, judged: Column) -> DataFrame:
    """Second phase: C, R2, R3, R4 and reward of deferred()'s rows, with the judge's score of their pairs (0 where none was asked)."""
    j = F.when(F.col("given").isNotNull(), judged).otherwise(0.0)
    of = {"answer": F.col("answer"), "hungarian": F.col("hungarian"), "consistency": F.col("parts"), "detection": F.col("parts")}
    out = None
    for kind, parts in of.items():
        own = details(parts, j, kind)
        out = F.when(F.col("kind") == kind, own) if out is None else out.when(F.col("kind") == kind, own)
    return df.withColumn("_d", out).select(*df.columns, "_d.*")


def conflicts(df: DataFrame, stated: str, supported: str, confidence: str, threshold: float) -> DataFrame:
    """Adds raw_conflict and conflict: the supported option isn't the stated one, and confidently so."""
    raw = F.col(supported).isNotNull() & (F.col(supported) != "U") & (F.col(supported) != F.col(stated))
    return df.withColumns({"raw_conflict": raw, "conflict": raw & (F.col(confidence) >= threshold)})


def route(df: DataFrame, source: str, solution: str, truth: str, routes: dict[str, str]) -> DataFrame:
    """Adds score by the source's scorer; a source without one is an error when run."""
    out = F.raise_error(F.concat(F.lit("unknown source: "), F.col(source))).cast("double")
    for name, scorer in routes.items():
        out = F.when(F.col(source) == name, SCORERS.resolve(scorer)(F.col(solution), F.col(truth))).otherwise(out)
    return df.withColumn("score", out)


@REWARDS.register("naive")
def naive(df: DataFrame, scorer: str, solution: str, truth: str) -> DataFrame:
    return df.withColumn("score", SCORERS.resolve(scorer)(F.col(solution), F.col(truth)))


@REWARDS.register("overlong")
def overlong(df: DataFrame, scorer: str, solution: str, truth: str, length: str, most: int, buffer: int) -> DataFrame:
    return naive(df, scorer, solution, truth).withColumn("score", F.col("score") + overlong_penalty(F.col(length), most, buffer))


def from_results(df: DataFrame, results: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """Adds score: the share of passed tests (of the first ones by test number), or with first=None whether all passed.

    Programs are never run here: results (key, test, passed) come from elsewhere.
    """
    own = results.where(F.col("test") < first) if first else results
    agg = F.avg(F.col("passed").cast("double")) if first else F.bool_and("passed").cast("double")
    return df.join(own.groupBy(key).agg(agg.alias("score")), key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def flawed_penalty(score: Column, flawed: Column, penalty: float) -> Column:
    return F.when((score > 0) & flawed, score - penalty).otherwise(score)


def located_error(given: Column, wanted: Column) -> Column:
    """1 if the located step is the wanted one, else -1; null given counts as wrong."""
    return F.when(F.coalesce(given == wanted, F.lit(False)), 1.0).otherwise(-1.0)


#: What an answer may say, what a summary says by default, and fields of an object's box.
CONSISTENCY_ANSWERS = ("consistent", "inconsistent")
BOX_FIELDS = ("x", "y", "w", "h")


def output_fault(output: Column, inputs: Column, ambiguous: Column, note: Column, bad_verbs: tuple[str, ...] = (), forbidden: tuple[str, ...] = ()) -> Column:
    """Why a structured output (answer, cot, summary, objects) isn't valid, or null: the first rule that fails.

    output: a struct of strings answer, cot, summary and objects, an array of (box, description);
    inputs: the objects that it describes. An empty summary is right only for an ambiguous
    background without a note.
    """
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    answer = F.lower(F.trim(output["answer"]))
    low = {f: F.lower(output[f]) for f in ("cot", "summary")}
    objects = output["objects"]
    boxed = lambda k: F.forall(F.arrays_zip(inputs.alias("i"), objects.alias("o")), lambda x: x["i"]["box"][k].eqNullSafe(x["o"]["box"][k]))
    each = [(filled(output["answer"]), "missing field: answer"), (output["cot"].isNotNull(), "missing field: cot"), (output["summary"].isNotNull(), "missing field: summary"), (objects.isNotNull(), "missing field: objects"), (answer.isin(*CONSISTENCY_ANSWERS), "answer must be consistent or inconsistent"), (answer == F.when(ambiguous, CONSISTENCY_ANSWERS[0]).otherwise(CONSISTENCY_ANSWERS[1]), "answer should be the other"), (filled(output["cot"]), "empty cot"), (~ambiguous | F.contains(low["cot"], F.lit("cannot be determined")), "ambiguous but not said so"), (filled(output["summary"]) | (ambiguous & ~filled(note)), "empty summary"), (F.size(objects) == F.size(inputs), "object count mismatch")]
    each += [(boxed(k), f"box {k} mismatch") for k in BOX_FIELDS]
    each += [(F.forall(objects, lambda o: filled(o["description"])), "missing description")]
    without = lambda verb: F.forall(objects, lambda o: ~F.lower(o["description"]).rlike(verb))
    each += [(without(v), f"conjugated verb: {v}") for v in bad_verbs]
    each += [(~F.contains(low[f], F.lit(t)), f"{f} has {t}") for f in ("cot", "summary") for t in forbidden]
    return text.first_failure(*each)


def multi_metric(df: DataFrame, row: str, metric: str, value: str, weights: dict[str, float]) -> DataFrame:
    """row, reward: each metric's mean over repeats times its weight, clipped to 1 in size, summed. A metric without a weight adds nothing."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    per = df.groupBy(row, metric).agg(F.avg(value).alias("m")).withColumn("m", F.least(F.greatest(F.col("m") * w[F.col(metric)], F.lit(-1.0)), F.lit(1.0)))
    return per.groupBy(row).agg(F.sum("m").alias("reward"))


def point_in_box(point: Column, box: Column) -> Column:
    return (point[0].between(box[0], box[2]) & point[1].between(box[1], box[3])).cast("double")


def judged_by_split(df: DataFrame, split: str, ruled: Column, response: Column) -> DataFrame:
    """Adds score: the rule's on the test split, else the verdict in a judge's response (0 without one)."""
    return df.withColumn("score", F.when(F.col(split) == "test", ruled).otherwise(boxed_true(response)))


#: Weights of accuracy, form and the use of a tool.
VISUAL_WEIGHTS = (0.8, 0.2, 1.2)


def visual_tool_reward(solution: Column, judged: Column, open_mark: str = "<tool_call>") -> Column:
    """Weighted sum of a judge's accuracy (0 or 1), of form (-1 where think or answer marks don't pair), and of a tool call in a right answer."""
    count = lambda mark: F.size(F.split(solution, F.lit(mark))) - 1
    pairs = F.lit(True)
    for name in ("think", "answer"):
        pairs = pairs & (count(f"<{name}>") == count(f"</{name}>"))
    accuracy = F.coalesce(judged.cast("double"), F.lit(0.0))
    called = (F.contains(solution, F.lit(open_mark)) & (accuracy > 0.5)).cast("double")
    a, b, c = VISUAL_WEIGHTS
    return a * accuracy + b * F.when(pairs, 0.0).otherwise(-1.0) + c * called


def guarded(df: DataFrame, columns: list[str], score, seconds: float = 10.0, default: float = 0.0, workers: int = 4) -> DataFrame:
    """Adds score and failure: score(*values) of each row in a process of its own pool, the default where it fails or takes longer.

    A task has one pool. A call that hangs is ended with its process, so it costs its own time
    and no other row's result.
    """
    import pandas as pd

    def run(frames):
        from ..functions.guarded import Pool

        with Pool(score, workers) as pool:
            for frame in frames:
                got = pool.map([tuple(r) for r in frame[columns].itertuples(index=False, name=None)], seconds)
                yield frame.assign(score=pd.Series([default if f else float(v) for v, f in got], index=frame.index, dtype=float), failure=pd.Series([f for _, f in got], index=frame.index, dtype=object))

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("failure", StringType())]))


def run_tests(tests: DataFrame, key: str, call, schema: str = "key string, test int, passed boolean, error string", tries: int = 3) -> DataFrame:
    """The results table of a remote runner: call(list of (key, test, code, input, output)) gives (passed, error) for each, batch by batch.

    Programs run where the runner is, never in this engine; a batch that fails with an
    OSError is tried again, and then marked as failed, so one lost runner costs no task.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = list(frame[[key, "test", "code", "input", "output"]].itertuples(index=False, name=None))
            for k in range(tries):
                try:
                    got = call(rows)
                    break
                except OSError as e:
                    got = [(False, f"{type(e).__name__}: {e}")] * len(rows)
            yield pd.DataFrame({"key": [str(r[0]) for r in rows], "test": [int(r[1]) for r in rows], "passed": [bool(g[0]) for g in got], "error": [g[1] for g in got]})

    return tests.select(key, "test", "code", "input", "output").mapInPandas(run, schema)
