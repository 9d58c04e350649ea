"""Scalars over graded text as columns: prompts, answers, options, thinking, numbers. All on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: White space of Unicode, as a class of Java's patterns.
WHITE = "[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The roles of prompts, and the marks of templates and images that no key keeps.
ROLES = ("system", "user", "assistant")
TURN_MARK = "<|im_start|>"
TEMPLATE_MARKS = ("<|im_end|>", "<|vision_start|>", "<|vision_end|>", "<|image_pad|>", "<|eot_id|>", "<|endoftext|>", "<|end|>", "<|assistant|>", "<|user|>", "<|system|>", "<image>", "[image]")
#: The fields of a nested prompt that hold more of it; `text` comes before them.
NESTED = ("content", "prompt", "messages")


def text_parts(value: Column, kind: DataType) -> Column:
    """Array of the texts of a prompt of any nesting: a text itself, a struct's `text`, else its content, prompt and messages, and all elements of arrays."""
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
    if isinstance(kind, ArrayType):
        inner = F.flatten(F.transform(value, lambda x: text_parts(x, kind.elementType)))
        return F.coalesce(inner, F.array().cast("array<string>"))
    if isinstance(kind, StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        below = [text_parts(value[n], fields[n]) for n in NESTED if n in fields]
        rest = F.concat(*below) if below else F.array().cast("array<string>")
        if isinstance(fields.get("text"), StringType):
            return F.when(value["text"].isNotNull(), F.array(value["text"])).otherwise(rest)
        return rest
    return F.array().cast("array<string>")


def prompt_text(df: DataFrame, column: str) -> Column:
    """The texts of a prompt column of any nesting, joined by line ends."""
    return F.array_join(text_parts(F.col(column), df.schema[column].dataType), "\n")


def shown_text(messages: Column) -> Column:
    """The contents of messages (role, content), joined by line ends; empty ones left out."""
    return F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda c: c.isNotNull() & (c != "")), "\n")


def _without_role(turn: Column) -> Column:
    """What follows a turn's mark, without the role that begins it."""
    bare = F.regexp_replace(turn, f"^{WHITE}+", "")
    out = bare
    for role in ROLES:
        out = F.when(bare.startswith(role), F.substring(bare, len(role) + 1, 1 << 30)).otherwise(out)
    return out


def prompt_key(text: Column) -> Column:
    """Lower case, without lines of a role alone, the marks of templates and images, and white space."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~F.regexp_replace(x, WHITE, "").isin(*ROLES))
    turns = F.split(F.array_join(lines, "\n"), re.escape(TURN_MARK))
    got = F.array_join(F.transform(turns, lambda t, i: F.when(i > 0, _without_role(t)).otherwise(t)), "")
    for mark in TEMPLATE_MARKS:
        got = F.replace(got, F.lit(mark), F.lit(""))
    return F.regexp_replace(got, WHITE, "")


def ground_truth(*candidates: Column) -> Column:
    """The first that isn't null."""
    return F.coalesce(*candidates)


def normal_answer(answer: Column) -> Column:
    """Trimmed, lower case, without one pair of parentheses around it; empty is null."""
    got = F.lower(F.btrim(answer, F.lit(" \t\n\r\f\v")))
    inner = F.btrim(F.regexp_extract(got, r"(?s)^\((.*)\)$", 1), F.lit(" \t\n\r\f\v"))
    return F.nullif(F.when(got.rlike(r"(?s)^\(.*\)$"), inner).otherwise(got), F.lit(""))


def flat_json_answer(text: Column) -> Column:
    """The answer of the last object without inner braces that has one; else the last "answer" that looks like it."""
    objects = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    answers = F.filter(F.transform(objects, lambda o: F.get_json_object(o, "$.answer")), lambda a: a.isNotNull())
    loose = F.regexp_extract_all(text, F.lit(r'"answer"\s*:\s*"([^"]*)"'), F.lit(1))
    return normal_answer(F.coalesce(F.get(answers, F.size(answers) - 1), F.get(loose, F.size(loose) - 1)))


def truth_answer(text: Column) -> Column:
    """The answer of JSON, of text that looks like it, or the text itself."""
    loose = F.nullif(F.regexp_extract(text, r'"answer"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return normal_answer(F.coalesce(F.get_json_object(text, "$.answer"), loose, text))


def thinking(text: Column) -> Column:
    """Between the last closing mark and the last opening one before it; empty without a closing mark or text."""
    before = F.when(F.contains(text, F.lit("</think>")), F.substring(text, 1, F.char_length(text) - F.char_length(F.substring_index(text, "</think>", -1)) - len("</think>")))
    return F.coalesce(trimmed(F.substring_index(before, "<think>", -1)), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


#: Marks that end a sentence wherever they are; a point ends one before a blank.
SENTENCE_ENDS = "!?\u3002\uff01\uff1f"
_CUT = "\u0001"


def last_sentence(text: Column) -> Column:
    """The last sentence of a text with single blanks; the whole of it if it has no other."""
    single = trimmed(F.regexp_replace(text, f"{WHITE}+", " "))
    cut = F.replace(F.regexp_replace(single, f"([{SENTENCE_ENDS}])", f"$1{_CUT}"), F.lit(". "), F.lit(f".{_CUT}"))
    parts = F.filter(F.transform(F.split(cut, _CUT), lambda x: F.btrim(x)), lambda x: x != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), single)


def last_sentence_of_paragraph(text: Column) -> Column:
    """The last sentence (.!? and a blank) of the last paragraph that isn't empty."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda s: F.btrim(s, F.lit(" \t\n\r\f\v")) != "")
    lines = F.split(F.btrim(F.get(parts, F.size(parts) - 1), F.lit(" \t\n\r\f\v")), r"(?<=[.!?])\s+")
    return F.get(lines, F.size(lines) - 1)


#: The marks after an option's letter.
OPTION_MARKS = ".\uff0e):\uff1a"
_PAIR = "array<struct<letter:string,value:string>>"


def option_lines(text: Column, strict: bool = False) -> Column:
    """Array of (letter, value) of the lines that state option A or B.

    A line: blanks, OPTION and blanks if it has them, the letter in either case, a mark, the
    value. strict: the letter in parentheses, (A), does as well.
    """

    def read(line: Column) -> Column:
        bare = F.btrim(line, F.lit(" \t"))
        rest = F.btrim(F.substring(bare, 7, 1 << 30), F.lit(" \t"))
        named = (F.lower(F.substring(bare, 1, 6)) == "option") & F.substring(bare, 7, 1).isin(" ", "\t")
        own = F.when(named, rest).otherwise(bare)
        letter = F.upper(F.substring(own, 1, 1))
        after = F.btrim(F.substring(own, 2, 1 << 30), F.lit(" \t"))
        marked = F.substring(after, 1, 1).isin(*OPTION_MARKS)
        plain = F.struct(F.when(letter.isin("A", "B") & marked, letter).alias("letter"), F.btrim(F.substring(after, 2, 1 << 30), F.lit(" \t")).alias("value"))
        if not strict:
            return plain
        inner = F.upper(F.substring(own, 2, 1))
        bracketed = (F.substring(own, 1, 1) == "(") & inner.isin("A", "B") & (F.substring(own, 3, 1) == ")")
        return F.when(bracketed, F.struct(inner.alias("letter"), F.btrim(F.substring(own, 4, 1 << 30), F.lit(" \t")).alias("value"))).otherwise(plain)

    return F.filter(F.transform(F.split(text, "\n"), read), lambda x: x["letter"].isNotNull() & (x["value"] != ""))


def _options(text: Column, letter: str, strict: bool) -> Column:
    return F.transform(F.filter(option_lines(text, strict), lambda x: x["letter"] == letter), lambda x: trimmed(x["value"]))


def strict_options(text: Column) -> Column:
    """Struct (a, b, error): exactly one value of each letter, and different ones."""
    a, b = (F.array_distinct(_options(text, x, True)) for x in "AB")
    error = F.when((F.size(a) == 0) | (F.size(b) == 0), "option missing").when((F.size(a) > 1) | (F.size(b) > 1), "option ambiguous").when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), "options equal")
    return F.struct(F.get(a, F.lit(0)).alias("a"), F.get(b, F.lit(0)).alias("b"), error.alias("error"))


def lenient_options(text: Column, option_a: Column | None = None, option_b: Column | None = None) -> Column:
    """Struct (a, b, error): given options if both aren't blank, else the last line of each letter."""
    a, b = (_options(text, x, False) for x in "AB")
    last = [F.get(x, F.size(x) - 1) for x in (a, b)]
    if option_a is not None:
        given = (F.trim(option_a) != "") & (F.trim(option_b) != "")
        last = [F.when(given, F.trim(o)).otherwise(x) for o, x in zip((option_a, option_b), last, strict=True)]
    return F.struct(last[0].alias("a"), last[1].alias("b"), F.when(last[0].isNull() | last[1].isNull(), "option missing").alias("error"))


#: The action words of labels.
ACTIONS = ("add", "delete", "rotate", "replace", "move", "background")


def keyword_set(label: Column, words: tuple[str, ...] = ACTIONS) -> Column:
    """The action words that begin a word of the label."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.rlike(F.lower(label), F.concat(F.lit(r"\b"), w)))


def bracket_vectors(label: Column) -> Column:
    """Arrays of 2 or 3 numbers in parentheses."""
    groups = F.regexp_extract_all(label, F.lit(r"\(([^()]*)\)"), F.lit(1))
    numbers = F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).try_cast("double")))
    return F.filter(numbers, lambda v: F.size(v).isin(2, 3) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def direction(label: Column, box: Column) -> Column:
    """The only vector of a label: 2 values are a point, less the box's centre (y upwards); 3 values stay."""
    found = bracket_vectors(label)
    v = F.get(found, F.lit(0))
    point = F.array(v[0] - (box[0] + box[2]) / 2, (box[1] + box[3]) / 2 - v[1])
    return F.when(F.size(found) == 1, F.when(F.size(v) == 2, point).otherwise(v))


def last_number(text: Column, strict: bool = False, tail: int = 300) -> Column:
    """In the text's end: the last number after #### (strict; without commas and currency marks), or the last run of
    digits, points and commas that isn't a point alone, as it stands."""
    end = F.right(text, F.lit(tail))
    number = r"(-?[0-9.,]+)"
    if strict:
        found = F.regexp_extract_all(end, F.lit("#### " + number), F.lit(1))
        return F.translate(F.get(found, F.size(found) - 1), ",$", "")
    found = F.regexp_extract_all(end, F.lit(number), F.lit(1))
    real = F.filter(found, lambda x: x != ".")
    return F.coalesce(F.get(real, F.size(real) - 1), F.get(found, F.lit(0)))


def tagged_answer(text: Column, tag: str = "answer") -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.trim(F.get(found, F.size(found) - 1))


def qa_normal(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single blanks."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def fenced_json(text: Column) -> Column:
    """The object in a code fence, or from the first to the last brace; null if it isn't JSON."""
    fence = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    got = F.coalesce(fence, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    return F.when(F.get_json_object(got, "$").isNotNull(), got)


def cleanup(text: Column) -> Column:
    """Bracketed titles are ends of sentences, other brackets go, double blanks are single."""
    got = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(got, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def media_parts(text: Column) -> Column:
    """Array of (type, text): media marks and the text between them."""
    marked = F.regexp_replace(text, r"(<image>|<video>|<audio>)", "\u0001$1\u0001")
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.when(p.isin("<image>", "<video>", "<audio>"), F.regexp_replace(p, "[<>]", "")).otherwise("text").alias("type"), F.when(p.isin("<image>", "<video>", "<audio>"), F.lit(None).cast("string")).otherwise(p).alias("text")))


def choice_letter(text: Column, pattern: str = r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?") -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.upper(F.get(found, F.size(found) - 1))


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that fails (is not true), or null."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in rules))


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, single blanks."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href=["']([^"']*)["']"""), F.lit(1))


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """From a canvas of 1000 to pixels."""
    return F.transform(box, lambda v, i: F.when(i % 2 == 0, v * width / 1000).otherwise(v * height / 1000))


def future_words(turns: Column, after: Column) -> Column:
    """Words in the turns after a number of them."""
    return F.aggregate(F.slice(turns, after + 1, F.greatest(F.size(turns) - after, F.lit(0))), F.lit(0), lambda a, t: a + F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")))
