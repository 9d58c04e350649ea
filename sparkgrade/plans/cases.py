"""Queries over literal cases: the events table deals them out, and the SQL holds the results that the rules ask for."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, parsers, text
from ..functions.registry import TOOL_PARSERS
from ..operators import scoring


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*map(F.lit, value)) if value else F.array().cast("array<string>")
    return F.lit(value)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return repr(float(value)) if isinstance(value, float) else str(value)


def _type(values: list) -> tuple[str, str]:
    kind = next((type(v) for v in values if v is not None), str)
    return {bool: ("boolean", "BOOLEAN"), int: ("bigint", "BIGINT"), float: ("double", "DOUBLE"), str: ("string", "VARCHAR")}[kind]


def query_of(columns: dict[str, tuple]):
    """(query, SQL) of columns: name to (function of columns, cases), a case being its inputs and, last, its result."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.read.parquet(f"{d}/events.parquet").select("event_id")
        out, inputs = [], []
        for name, (f, cases) in columns.items():
            n, kinds = len(cases), [_type([c[k] for c in cases])[0] if not any(isinstance(c[k], list) for c in cases) else None for k in range(len(cases[0]) - 1)]
            taken = []
            for k, kind in enumerate(kinds):
                values = F.array(*(_literal(c[k]) if kind is None else _literal(c[k]).cast(kind) for c in cases))
                inputs.append(F.get(values, (F.col("event_id") % n).cast("int")).alias(f"{name}_{k}"))
                taken.append(F.col(f"{name}_{k}"))
            kind = _type([c[-1] for c in cases])[0]
            got = f(*taken).cast(kind)
            out.append((F.round(got, 4) + F.lit(0.0) if kind == "double" else got).alias(name))
        # The inputs are made first, so that the functions meet columns, not constants.
        return rows.select("event_id", *inputs).select("event_id", *out)

    parts = []
    for name, (_, cases) in columns.items():
        when = " ".join(f"WHEN {i} THEN {_sql(c[-1])}" for i, c in enumerate(cases))
        kind = _type([c[-1] for c in cases])[1]
        value = f"(CASE event_id % {len(cases)} {when} END)::{kind}"
        parts.append(f"round({value}, 4) + 0.0 AS {name}" if kind == "DOUBLE" else f"{value} AS {name}")
    return run, f"SELECT event_id, {', '.join(parts)} FROM events"


def _json(c: Column) -> Column:
    return F.to_json(c)


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


_OPTIONS = [
    ("Q\nA. yes\nB. no", "yes|no|"), ("Q\n(A) yes\nOPTION B: no", "yes|no|"), ("A. yes", "yes||option missing"), ("A. x\nA. y\nB. z", "x|z|option ambiguous"), ("A. x\nB. x", "x|x|options equal"),
    ("  option a) one  \n\tB\uff1a two", "one|two|"), ("Apple. x\nB. z\nA . y", "y|z|"), ("", "||option missing"), ("optionA. x\nB. y", "|y|option missing"), ("a: 1\nb: 2", "1|2|"),
]
_LENIENT = [("Q\nA. yes\nB. no", "yes|no|"), ("(A) yes\nB. no", "|no|option missing"), ("A. x\nA. y\nB. z", "y|z|"), ("A) 1\nOPTION B\uff0e 2", "1|2|"), (None, "||option missing"), ("A.\nB. x", "|x|option missing")]
_SHOWN = lambda o: F.concat_ws("|", F.coalesce(o["a"], F.lit("")), F.coalesce(o["b"], F.lit("")), F.coalesce(o["error"], F.lit("")))

_SENTENCES = [
    ("One. Two is 3.5! Last one.", "Last one."), ("First observation. Therefore the layout is inconsistent.", "Therefore the layout is inconsistent."), ("\u5148\u68c0\u67e5\u3002\u56e0\u6b64\u4e00\u81f4\u3002", "\u56e0\u6b64\u4e00\u81f4\u3002"),
    ("no end", "no end"), ("a\n b.\n\n c  d", "c d"), ("", ""), ("  ", ""), ("so 3.14 is pi", "so 3.14 is pi"), ("what?!", "!"), ("Yes! ", "Yes!"), ("one\uff01two", "two"), ("U.S. is. big", "big"),
]
_THINKING = [
    ("<think>a. b</think>{}", "a. b"), ("no mark", ""), ("<think>x</think> <think> y </think>z", "y"), ("opened before</think> end", "opened before"), ("<think></think>", ""), ("<think>a<think> b </think>", "b"), (None, ""), ("</think>", ""),
]
_KEYS = [
    ("Hello  World", "helloworld"), ("system\nUser\nWhat is it?\nassistant\n", "whatisit?"), ("<|im_start|>user\nHi<|im_end|>", "hi"), ("<image>A [image] b<IMAGE>", "ab"), ("<|im_start|> assistants", "s"), ("keep <|other|> mark", "keep<|other|>mark"),
    ("", ""), ("a\u3000b\u00a0c", "abc"), ("a user\nuser b", "auseruserb"), ("<|vision_start|><|image_pad|><|vision_end|>x<|eot_id|>", "x"),
]
_FLEXIBLE = [("so 1,234 and -5.", "-5."), ("it is 1,234", "1,234"), ("none", None), ("a . b", "."), ("7 then .", "7"), ("-3.5 and .", "-3.5"), ("x=2,", "2,"), (None, None)]
_STRICT = [("7 #### 1,234", "1234"), ("#### -5\n#### 6.5", "6.5"), ("5", None), ("####7", None), ("#### 12,", "12")]
_TAGS = [("<answer>a</answer> <answer> b </answer>", "b"), ("x", None), ("<answer>one\ntwo</answer>", "one\ntwo"), ("<answer>open", None)]
_QA = [("The  cat's, an Apple!", "cats apple"), ("A", ""), ("  x  ", "x"), ("theory of a man", "theory of man")]
_FENCED = [('```json\n{"a": 1}\n```', '{"a": 1}'), ('say {"b": [2]} now', '{"b": [2]}'), ("none", None), ("{bad", None)]
_CLEAN = [(" a [title] b", "a. b"), ("x [ref] y", "x y"), ("plain", "plain")]
_NORMAL = [(" (B) ", "b"), ("A", "a"), ("", None), ("((c))", "(c)"), ("( )", None)]
_CHOICE = [("Answer: B", "B"), ("answer : $c$", "C"), ("Answer: E", None), ("Answer: A then Answer: D", "D")]

_LAST_JSON = [
    ('a {"x": {"y": "}"}} b {bad} {"z": 1} {', '{"z": 1}'), ('{"a": [1, {"b": 2}]}', '{"a": [1, {"b": 2}]}'), ("none", None), ("[1, 2]", None), ('{"a": 1} tail {"b": "{"}', '{"b": "{"}'), ('x {"n": {"m": 3}} y', '{"n": {"m": 3}}'), ("", None),
]
_CANONICAL = [('{"b":1, "a": [2]}', '{"a":[2],"b":1}'), (" a \n b ", "a b"), ("", ""), ('"x"', '"x"'), ("[1,  2]", "[1,2]"), (None, None)]
_BOXED = [("\\boxed{\\frac{1}{2}} and \\boxed{3{4}}", "3{4}"), ("\\boxed{1", None), ("none", None), ("x \\boxed{} y", ""), ("\\boxed{a}", "a")]
_FINAL = [
    ("12 square inches", "12"), ("x = 5", "5"), ("1,000", "1000"), ("\\frac12", "\\frac{1}{2}"), ("\\sqrt2", "\\sqrt{2}"), ("$7$ apples", "7"), ("3\\text{ cm}", "3"), ("90^\\circ", "90"), ("\\text{Monday}", "Monday"), ("10 dollars", "10"),
    ("\\$5", "5"), ("a 9", "9"), ("\\boxed{4}", "4"), ("5,\\!000", "5000"), ("12{,}345", "12345"), ("\\frac{1}{2}", "\\frac{1}{2}"), ("7\\mathrm{th}", "7"), ("2\\text{m}^2", "2"), ("8\\ldots", "8"), ("\\textbf{6} points", "6"), ("area 5", "are5"),
]
_LATEX = [
    ("\\tfrac12", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("k = 7", "7"), ("3/4", "\\frac{3}{4}"), ("\\sqrt 2", "\\sqrt{2}"), ("50\\%", "50"), ("\\left( 1, 2 \\right)", "(1,2)"), ("90^{\\circ}", "90"), (".25", "0.25"), ("5\\text{ cm}", "5"),
]
_EQUAL = [
    ("\\frac{3}{2}", "1.5", True), ("50", "0.5", True), ("2", "3", False), ("(1, 2)", "(1,2.0)", True), ("(1,2)", "(1,3)", False), ("(1,2]", "[1,2]", False), ("2\\sqrt{4}", "4", True), ("3^2", "9", True), ("1+1", "2", True), ("x+1", "x+2", False),
    ("\\frac{2}{4}", "\\frac{1}{2}", True), ("[0,1)", "[0,1.0)", True), ("2\\pi", "6.283185", True), ("100000", "100001", True), ("7", "8", False),
]
_MINERVA = [
    ("so Answer: 12", "12", 1.0), ("Answer: 5\nAnswer: \\frac12", "\\frac{1}{2}", 1.0), ("no statement 7", "7", -1.0), ("answer : 1,000 dollars", "1000", 1.0), ("Answer: 4", "5", -1.0), ("ANSWER: $x = 3$", "3", 1.0),
]
_MINERVA_PRED = [("so Answer: 12 cm", "12", "12"), ("none", "1", "[INVALID]"), ("Answer: a\nAnswer: b c", "x", "bc")]
_BOX_SIGN = [("so \\boxed{12}", "12", 1.0), ("\\boxed{1 2}", "12", -1.0), ("12", "12", -1.0), ("\\boxed{3} \\boxed{4}", "4", 1.0)]
_CHARS = [("\\boxed{3}", "3", 1.0), ("\\boxed{ 3}", "3", 0.0), ("3", "3", 0.0), ("\\boxed{1} \\boxed{2}", "2", 1.0)]
_VERDICTS = [("I think \\boxed{True}", 1.0), ("\\boxed{False}", 0.0), ("True", 0.0), ("\\boxed{True} no \\boxed{False}", 0.0), ("\\boxed{true}", 0.0)]

_CALLS = {
    "json_tags": [('<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call> and <tool_call>{"name": "g", "arguments": {}}</tool_call>', 'f{"x": 1};g{}'), ("nothing", ""), ("<tool_call>{bad}</tool_call>", "")],
    "channels": [('to=functions.f <|constrain|>json<|message|>{"x": 1}<|call|>', 'f{"x": 1}'), ("text", ""), ('to=functions.a.b<|message|>{"k": "v"}<|call|>', 'a.b{"k": "v"}')],
    "function_xml": [("<function=f><parameter=x>1</parameter><parameter=y>two</parameter></function>", 'f{"x": 1, "y": "two"}'), ("<function=f><parameter=x>1", 'f{"x": 1}'), ("none", "")],
    "arg_pairs": [("<tool_call>f<arg_key>x</arg_key><arg_value>1</arg_value></tool_call>", 'f{"x": 1}'), ("<tool_call>g</tool_call>", "g{}"), ("none", "")],
    "namespaced": [("<s:tool_call><function=f><parameter=x>1</parameter></function></s:tool_call>", 'f{"x": 1}'), ("<function=f></function>", "")],
    "invoke": [('<invoke name="f"><parameter name="x">1</parameter></invoke>', 'f{"x": 1}'), ("none", ""), ('<invoke name="f"></invoke><invoke name="g"><parameter name="s">a b</parameter></invoke>', 'f{};g{"s": "a b"}')],
    "sections": [('<|tool_call_begin|>functions.f:0<|tool_call_argument_begin|>{"x": 1}<|tool_call_end|>', 'f{"x": 1}'), ("none", "")],
    "dsml": [('<\uff5cDSML\uff5cinvoke name="f"><\uff5cDSML\uff5cparameter name="x">1</\uff5cDSML\uff5cparameter></\uff5cDSML\uff5cinvoke>', 'f{"x": 1}'), ("none", "")],
    "braces": [("call:f{x:1}", 'f{"x": 1}'), ('call:g{a:"b, c",d:{e:2},l:[1,2]}', 'g{"a": "b, c", "d": {"e": 2}, "l": [1, 2]}'), ("none", ""), ("call:h{}", "h{}")],
}
_told_calls = lambda dialect: lambda c: F.array_join(F.transform(parsers.tool_calls(c, dialect), lambda x: F.concat(x["name"], x["arguments"])), ";")

_ONE, _TWO = "[[0, 0, 400, 400]]", "[[0, 0, 400, 400], [500, 500, 900, 900]]"
_boxes = lambda b: json.dumps({"boxes": json.loads(b)})
_HUNGARIAN = [(_boxes(_ONE), _boxes(_ONE), 1.0), (_boxes(_ONE), _boxes(_TWO), 0.5), (_boxes(_TWO), _boxes(_ONE), 0.5), (_boxes("[[500, 500, 900, 900]]"), _boxes(_ONE), 0.0), (_boxes("[]"), _boxes(_ONE), 0.0), ("none", _boxes(_ONE), 0.0), (_boxes("[[0, 0, 200, 400]]"), _boxes(_ONE), 0.5)]


def _answer(answer: str, entries: list, summary: str = "s") -> str:
    return json.dumps({"answer": answer, "summary": summary, "boxes": [{"bbox": b, "label": label} for b, label in entries]})


_A, _B = [0, 0, 10, 10], [5, 5, 15, 15]
_COMPOSITE = [
    (_answer("b", []), _answer("A", []), 0.0), (_answer("(a)", []), _answer("A", []), 1.0), (_answer("A", [(_A, "add")]), _answer("A", []), 0.2),
    (_answer("A", [(_B, "add")]), _answer("A", [(_A, "add")]), 0.1 + 0.25 / 7 + 0.25 / 7 + 0.4), (_answer("A", [([50, 50, 60, 60], "add")]), _answer("A", [(_A, "add")]), 0.5), (_answer("A", [(_A, "add")]), _answer("A", [(_A, "add")]), 1.0),
]
_DETECTION = [(_answer("A", [(_A, "add")]), _answer("A", [(_A, "add")]), 1.0), (_answer("b", [(_B, "add")]), _answer("A", [(_A, "add")]), 0.25 / 7 + 0.25 / 7 + 0.5), (_answer("A", [(_A, "move")]), _answer("A", [(_A, "move (5, 0)")]), 0.25 - 0.25 + 0.5), ("none", _answer("A", [(_A, "add")]), 0.5)]
_REGION = [(_answer("A", [(_A, "add"), (_A, "add")]), _answer("A", [(_A, "add")]), 1.0), (_answer("A", [(_B, "x")]), _answer("A", [(_A, "x")]), 25 / 175), (_answer("A", []), _answer("A", []), 1.0), (_answer("A", []), _answer("A", [(_A, "x")]), 0.0)]
_LABELS = [
    (_answer("A", [(_A, "move (10, 5)")]), _answer("A", [(_A, "moved (20, 5)")]), 1.0), (_answer("A", [(_A, "delete")]), _answer("A", [(_A, "rotate")]), 0.0), (_answer("A", [(_A, "rotate (1, 2)")]), _answer("A", [(_A, "rotate")]), -1.0),
    (_answer("A", [(_A, "add")]), _answer("A", [(_A, "add and rotate")]), 0.5), (_answer("A", [(_A, "add, delete")]), _answer("A", [(_A, "add")]), 0.0),
]
_FLAT = [("x [1,2,3,4000] and [5, 6, 7, 8]", "[[1.0, 2.0, 3.0, 1000.0], [5.0, 6.0, 7.0, 8.0]]"), ('{"boxes": [[1,2,3], [1,2,3,4]]}', "[[1.0, 2.0, 3.0, 4.0]]"), ("none", "[]"), (None, None)]
_plain_boxes = parsers.string_udf(lambda t: json.dumps(boxes.plain_boxes(t)))

_POINTS = [('```json\n[{"point_2d": [5, 6]}]\n```', [0.0, 0.0, 10.0, 10.0], 2.0), ("[[50, 5]]", [0.0, 0.0, 10.0, 10.0], 0.0), ("", [0.0, 0.0, 1.0, 1.0], 0.0), ("[[50, 5], [5, 5]]", [0.0, 0.0, 10.0, 10.0], 1.5)]
_TOOLS = [
    ('[{"name": "f", "parameters": {"x": 1}}]', '[{"name": "f", "parameters": {"x": 1}}]', 1.0), ('[{"name": "f", "parameters": {"x": 1}}]', "[]", 0.0), ("[]", "[]", 1.0), ('[{"name": "f", "parameters": {"x": 1}}]', '[{"name": "f", "parameters": {"x": 2}}]', 2 / 3),
]
_SEGMENTS = [("a <code>b</code> c", "text:a|code:<code>b</code>|text:c"), ("plain", "text:plain"), ("<code>x</code>", "code:<code>x</code>"), ("  ", "")]
_MEDIA = [("a <image> b<video>", "text:a |image|text: b|video"), ("none", "text:none"), ("<audio>", "audio")]

QUERIES: dict[str, object] = {}
ORACLE_SQL: dict[str, str] = {}


def put(name: str, **columns) -> None:
    QUERIES[name], ORACLE_SQL[name] = query_of(columns)


put("option_cases", strict=(lambda t: _SHOWN(text.strict_options(t)), _OPTIONS), lenient=(lambda t: _SHOWN(text.lenient_options(t)), _LENIENT), given=(lambda t, a, b: _SHOWN(text.lenient_options(t, a, b)), [("A. x\nB. y", " p ", "q", "p|q|"), ("A. x\nB. y", "p", " ", "x|y|"), ("A. x\nB. y", None, "q", "x|y|")]))
put("sentence_cases", last=(text.last_sentence, _SENTENCES), thinking=(text.thinking, _THINKING), paragraph=(text.last_sentence_of_paragraph, [("One. Two.\n\nThree. Four.\n\n ", "Four."), ("a", "a"), ("A! B?\n\nC", "C")]))
put("prompt_key_cases", key=(text.prompt_key, _KEYS))
put("number_cases", flexible=(text.last_number, _FLEXIBLE), strict=(lambda t: text.last_number(t, strict=True), _STRICT), tagged=(text.tagged_answer, _TAGS), qa=(text.qa_normal, _QA), fenced=(text.fenced_json, _FENCED), cleaned=(text.cleanup, _CLEAN), answer=(text.normal_answer, _NORMAL), choice=(text.choice_letter, _CHOICE))
put("json_cases", last=(parsers.last_object_json, _LAST_JSON), canonical=(parsers.canonical_json, _CANONICAL), boxes=(_plain_boxes, _FLAT))
put("latex_cases", boxed=(parsers.boxed_answer, _BOXED), final=(parsers.final_answer_text, _FINAL), plain=(parsers.latex_plain, _LATEX), equal=(parsers.math_equal, _EQUAL))
_VERDICT_CASES = [
    ("(x+1)^2", "x^2+2x+1", "equal"), ("(x+1)^2", "x^2+1", "different"), ("\\frac{x^2-1}{x-1}", "x+1", "equal"), ("\\frac{1}{1+\\sqrt{2}}", "\\sqrt{2}-1", "equal"), ("2^x 2^x", "4^x", "equal"), ("(1,2]", "(1,2)", "different"),
    ("(-\\infty,3)\\cup(4,5)", "(-\\infty, 3) \\cup (4, 5)", "equal"), ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&\\frac{8}{2}\\end{pmatrix}", "equal"), ("y=2x+1", "2x-y+1=0", "equal"), ("y=2x+1", "y=2x+2", "different"), ("x<3", "3>x", "equal"),
    ("(((9^{64})^{64})^{64})^{64}", "1", "not evaluated"), ("(((9^{64})^{64})^{64})^{64}", "((9^{4096})^{64})^{64}", "equal"), ("{{{{{{", "1", "not evaluated"), ("1/0", "1", "not evaluated"), ("\\frac{\\frac{", "1", "not evaluated"), ("\\log_2{8}", "3", "equal"), ("x^y", "y^x", "different"),
]
put("verdict_cases", verdict=(parsers.math_verdict, _VERDICT_CASES), equal=(parsers.math_equal, [(a, b, {"equal": True, "different": False}.get(v)) for a, b, v in _VERDICT_CASES]))
put("stated_answer_cases", minerva=(scoring.minerva, _MINERVA), pred=(lambda s, t: parsers.minerva_score(s, t)["pred"], _MINERVA_PRED), strict_box=(lambda s, t: parsers.strict_box_score(s, t)["score"], _BOX_SIGN), chars=(scoring.boxed_exact, _CHARS), verdict=(scoring.boxed_true, _VERDICTS))
put("math_grade_cases", correct=(lambda s, t: parsers.math_grade(s, t)["correct"], [("\\boxed{6.28}", "2\\pi", True), ("\\boxed{1/2}", "0.5", True), ("\\boxed{3}", "4", False), ("7", "7", True)]), boxed=(lambda s, t: parsers.math_grade(s, t)["boxed"], [("\\boxed{1}", "1", True), ("1", "1", False)]))
put("tool_call_cases", **{d: (_told_calls(d), c) for d, c in _CALLS.items() if d in TOOL_PARSERS})
put("box_cases", hungarian=(lambda s, t: boxes.hungarian_iou(s, t), _HUNGARIAN), consistency=(lambda s, t: boxes.consistency_score(boxes.box_parts(s, t), F.lit(1.0)), _COMPOSITE), detection=(lambda s, t: boxes.detection_score(boxes.box_parts(s, t), F.lit(1.0)), _DETECTION), region=(lambda s, t: boxes.box_parts(s, t)["region"], _REGION), label=(lambda s, t: boxes.box_parts(s, t)["label"], _LABELS))
put("label_cases", words=(lambda t: _joined(text.keyword_set(t)), [("Moved and rotated", "rotate|move"), ("remove", ""), ("replace background", "replace|background"), ("ADD", "add")]), vectors=(lambda t: _json(text.bracket_vectors(t)), [("move (1, 2) x (3,4,5)", "[[1.0,2.0],[3.0,4.0,5.0]]"), ("(1) (a, b)", "[]"), ("none", "[]")]), way=(lambda t: _json(text.direction(t, F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))))), [("move (10, 5)", "[5.0,0.0]"), ("move (1, 2, 3)", "[1.0,2.0,3.0]"), ("none", None), ("(1, 2) (3, 4)", None)]), scaled=(lambda b: _json(text.scaled_box(b, F.lit(500), F.lit(2000))), [([0.0, 100.0, 500.0, 1000.0], "[0.0,200.0,250.0,2000.0]")]))
put("reward_cases", points=(parsers.point_rewards, _POINTS), tools=(parsers.tool_call_scores, _TOOLS), bleu=(parsers.bleu_scores, [("the cat sat down", "the cat sat down", 1.0), ("x", "y", 0.0), ("", "a", 0.0)]), segments=(lambda t: F.array_join(F.transform(parsers.text_segments(t, {"code": "<code>.*?</code>"}), lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "|"), _SEGMENTS), media=(lambda t: F.array_join(F.transform(text.media_parts(t), lambda p: F.concat(p["type"], F.coalesce(F.concat(F.lit(":"), p["text"]), F.lit("")))), "|"), _MEDIA), visual=(scoring.visual_tool_reward, [("<think>a</think><tool_call>x</tool_call><answer>b</answer>", 1.0, 2.0), ("<think>a<answer>b</answer>", 1.0, 0.6), ("<think>a</think>", 0.0, 0.0), ("<tool_call>", 0.0, 0.0)]))
put(
    "match_cases",
    exact=(scoring.exact_match, [("The Cat!", ["cat", "dog"], 1.0), ("cats", ["cat"], 0.0), ("x", [], 0.0)]), inside=(scoring.substring_match, [("a big cat here", ["Big cat"], 1.0), ("dog", ["cat"], 0.0)]), tagged=(scoring.tagged_exact_match, [("<answer>cat</answer>", ["cat"], 1.0), ("<answer>x</answer>" * 11 + "<answer>cat</answer>", ["cat"], 0.25), ("cat", ["cat"], 0.0)]),
    latex=(scoring.latex_equal, [("\\boxed{\\tfrac12}", "0.5", 1.0), ("\\boxed{2}", "3", 0.0), ("2", "2", 0.0)]), sign=(scoring.boxed_sign, [("\\boxed{1,000}", "1000", 1.0), ("\\boxed{4}", "5", -1.0), ("4", "4", -1.0)]), maths=(scoring.math_equal_score, [("\\boxed{\\frac{1}{4}}", "0.25", 1.0), ("9", "9", 1.0), ("9", "8", 0.0)]),
    choice=(scoring.choice, [("Answer: B", "B", 1.0), ("B", "B", 0.0)]), blend=(lambda a, f: scoring.blend(a, f), [(1.0, 0.0, 0.9), (0.0, 1.0, 0.1)]), bonus=(scoring.tool_bonus, [(-1.0, 4.0, -0.9), (-1.0, 40.0, -0.6), (1.0, 9.0, 1.0)]), located=(scoring.located_error, [(3, 3, 1.0), (2, 3, -1.0), (None, 3, -1.0)]), flawed=(lambda s, f: scoring.flawed_penalty(s, f, 0.5), [(1.0, True, 0.5), (1.0, False, 1.0), (-1.0, True, -1.0)]),
)
