"""Parsers, scorers and boxes on literal cases."""

import pytest
from pyspark.sql import functions as F

from sparkgrade.functions import boxes, parsers, text
from sparkgrade.operators import packing, scoring


def value(spark, column, s):
    return spark.createDataFrame([(s,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("solution", "score"),
    [('{"answer": "b"}', 1), ('{"answer": "(B)"}', 1), ('{"answer":"A"} {"answer":"B"}', 1), ('x {"answer": "B", "summary": "cut', 1), ("no json", 0), ("", 0), ('{"other": 1}', 0), ('{"answer": "A"}', 0)],
)
def test_json_answers(spark, solution, score):
    assert value(spark, lambda x: scoring.json_answer(x, F.lit('{"answer": "B"}')), solution) == score
    assert value(spark, lambda x: scoring.json_answer(x, F.lit("B")), solution) == score


def test_thinking_and_sentences(spark):
    assert value(spark, text.thinking, "<think>a<think> b. c! d </think>{}") == "b. c! d"
    assert value(spark, text.thinking, "no mark") == ""
    assert value(spark, text.last_sentence, "One. Two is 3.5! 最后一句。") == "最后一句。"
    assert value(spark, text.last_sentence_of_paragraph, "One. Two.\n\nThree. Four.\n\n ") == "Four."


def test_options(spark):
    strict = value(spark, text.strict_options, "Q\n(A) yes\nOPTION B: no")
    assert (strict.a, strict.b, strict.error) == ("yes", "no", None)
    assert value(spark, text.strict_options, "A. yes").error == "option missing"
    assert value(spark, text.strict_options, "A. x\nA. y\nB. z").error == "option ambiguous"
    assert value(spark, text.strict_options, "A. x\nB. x").error == "options equal"
    assert value(spark, text.lenient_options, "A. x\nA. y\nB. z").a == "y"


def test_numbers_and_qa(spark):
    assert value(spark, text.last_number, "so 1,234 and -5.") == "-5."
    assert value(spark, lambda x: text.last_number(x, strict=True), "7 #### 1,234") == "1234"
    assert value(spark, text.qa_normal, "The  cat's, an Apple!") == "cats apple"
    assert value(spark, text.tagged_answer, "<answer>a</answer> <answer> b\n</answer>").strip() == "b"
    assert [p.type for p in value(spark, text.media_parts, "a <image> b<video>")] == ["text", "image", "text", "video"]


def test_balanced_json_and_mathematics():
    assert parsers.last_object('a {"x": {"y": "}"}} b {bad} {"z": 1} {') == {"z": 1}
    assert parsers.last_object("none") is None
    assert parsers.boxed("\\boxed{\\frac{1}{2}} and \\boxed{3{4}}") == "3{4}" and parsers.boxed("\\boxed{1") is None
    assert parsers.strip_latex("\\tfrac12") == "\\frac{1}{2}" and parsers.strip_latex("0.5") == "\\frac{1}{2}"
    assert parsers.numeric_equal("\\frac{3}{2}", "1.5") and parsers.numeric_equal("50", "0.5") and not parsers.numeric_equal("2", "3")
    assert parsers.numeric_equal("(1, 2)", "(1,2.0)") and not parsers.numeric_equal("(1,2)", "(1,3)")
    assert parsers.canonical('{"b":1, "a": [2]}') == '{"a":[2],"b":1}' and parsers.canonical(" a \n b ") == "a b"


@pytest.mark.parametrize(
    ("dialect", "raw"),
    [
        ("json_tags", '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>'),
        ("channels", 'to=functions.f <|constrain|>json<|message|>{"x": 1}<|call|>'),
        ("function_xml", "<function=f><parameter=x>1</parameter></function>"),
        ("function_xml", "<function=f><parameter=x>1"),
        ("arg_pairs", "<tool_call>f<arg_key>x</arg_key><arg_value>1</arg_value></tool_call>"),
        ("namespaced", "<n:tool_call><function=f><parameter=x>1</parameter></function></n:tool_call>"),
        ("invoke", '<invoke name="f"><parameter name="x">1</parameter></invoke>'),
        ("sections", '<|tool_call_begin|>functions.f:0<|tool_call_argument_begin|>{"x": 1}<|tool_call_end|>'),
        ("dsml", '<｜DSML｜invoke name="f"><｜DSML｜parameter name="x">1</｜DSML｜parameter></｜DSML｜invoke>'),
        ("braces", "call:f{x:1}"),
    ],
)
def test_tool_dialects(dialect, raw):
    assert parsers.TOOL_PARSERS[dialect](f"text {raw} more" if not raw.endswith("1") else raw) == [("f", '{"x": 1}')]
    assert parsers.TOOL_PARSERS[dialect]("nothing") == []


def test_assignment_and_regions():
    assert boxes.assignment([[1, 2], [2, 4], [9, 0]]) == [(1, 1), (2, 0)]
    a, b = [0, 0, 10, 10], [5, 5, 15, 15]
    assert boxes.hungarian_score([a], [a]) == 1 and boxes.hungarian_score([a], []) == 0 and boxes.hungarian_score([a, [50, 50, 60, 60]], [a]) == 0.5
    assert boxes.region_score([a], [b]) == pytest.approx(25 / 175) and boxes.region_score([], []) == 1 and boxes.region_score([a], []) == 0
    assert boxes.plain_boxes("x [1,2,3,4000]") == [[1, 2, 3, 1000]] and boxes.plain_boxes('{"boxes": [[1,2,3], [1,2,3,4]]}') == [[1, 2, 3, 4]]


def test_label_gate_comes_first():
    box = [0.0, 0.0, 10.0, 10.0]
    assert boxes.label_score([], [(box, "move")], []) == -1 and boxes.label_score([], [(box, "rotate (1, 2)")], []) == -1 and boxes.label_score([], [], []) == 0
    one = boxes.label_score([(box, "move (10, 5)")], [(box, "moved (20, 5)")], [(0, 0, 1.0)])
    assert one == pytest.approx(1.0) and boxes.label_score([(box, "rotate")], [(box, "delete")], [(0, 0, 1.0)]) == 0


def test_composites(spark):
    truth, given = '{"answer": "A", "boxes": []}', '{"answer": "a", "boxes": []}'
    df = spark.createDataFrame([(given, truth), ('{"answer": "b"}', truth), (None, None)], "s string, t string").select(boxes.box_parts(F.col("s"), F.col("t")).alias("p"))
    assert [r[0] for r in df.select(boxes.consistency_score(F.col("p"), F.lit(1.0))).collect()] == [1.0, 0.0, 0.0]


def test_packing():
    loads = [5, 9, 1, 7, 3, 3, 8, 4]
    for k in (2, 3, 4):
        parts = packing.differencing(loads, k)
        sums = [sum(x for x, p in zip(loads, parts, strict=True) if p == n) for n in range(k)]
        assert len(parts) == len(loads) and max(sums) - min(sums) <= max(loads)
    assert sorted(packing.differencing(loads, 4, equal=True)) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert packing.greedy([3, 1, 2], 2) == [0, 1, 1]
    parts = packing.keeping_groups(loads, ["a", "a", "b", "b", "c", "c", "d", "d"], 2)
    assert all(parts[i] == parts[i + 1] for i in range(0, 8, 2))
    batches = packing.micro_batches(loads, 12)
    assert all(sum(x for x, p in zip(loads, batches, strict=True) if p == n) <= 12 for n in set(batches))
    with pytest.raises(ValueError):
        packing.micro_batches([20], 12)
    assert packing.largest_first(loads, 2, 22) and packing.differencing([], 3) == []


def test_tool_call_score():
    call = {"name": "f", "parameters": {"x": 1}}
    assert packing and parsers.tool_call_score([call], [call]) == pytest.approx(1.0)
    assert parsers.tool_call_score([call], []) < 0.5 and parsers.tool_call_score([], []) == 1


def test_points_bleu_and_segments():
    assert parsers.points('```json\n[{"point_2d": [5, 6]}]\n```') == [[5, 6]] and parsers.points("no") == []
    assert parsers.point_reward("[[5, 5]]", [0, 0, 10, 10]) == 2 and parsers.point_reward("[[50, 5]]", [0, 0, 10, 10]) == 0 and parsers.point_reward("", [0, 0, 1, 1]) == 0
    assert parsers.bleu("the cat sat down", "the cat sat down") == pytest.approx(1) and parsers.bleu("x", "y") == 0
    assert parsers.segments("a <code>b</code> c", {"code": "<code>.*?</code>"}) == [("text", "a"), ("code", "<code>b</code>"), ("text", "c")]


def test_custom_functions(tmp_path):
    from sparkgrade.functions.registry import load_function

    (tmp_path / "f.py").write_text("def score(x, y=0):\n    return x + y\n")
    assert load_function(str(tmp_path / "f.py"), "score", y=2)(1) == 3
