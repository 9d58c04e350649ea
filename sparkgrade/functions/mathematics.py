"""Plain forms of mathematical answers, read with an explicit stack, and their equality."""

from __future__ import annotations

import functools
import re

from .algebra import DIFFERENT, EQUAL, NOT_EVALUATED, compared

#: Words that short answers carry as units or fillers, and layout marks that mean nothing.
UNIT_WORDS = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "sue", "points", "feet", "minutes", "digits", "cents", "degrees",
    "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
)
IGNORED_COMMANDS = ("ldots", "dots", "left", "right", ";", "!", " ", ",", "$", "%")
UNWRAPPED_COMMANDS = ("text", "mbox", "textbf", "overline", "boxed")
#: What a text in \\text{...} may hold that isn't part of an answer.
TEXT_FILLERS = ("", "s", ".", "m", "and")
#: Articles, wherever these letters and a blank stand.
ARTICLES = ("an ", "a ")

#: Characters of a pair whose verdict a worker remembers.
REMEMBERED = 400

_COMMAND = re.compile(r"[td]?frac|sqrt|[A-Za-z]+|.", re.S)
_WORD = re.compile(r"[A-Za-z]+")
_TICKETS = re.compile(r"\s*tickets")


class _Frame:
    """What is being read: a sequence up to its brace, or, where need is set, that many arguments; finish makes its value."""

    def __init__(self, finish, need: int | None = None) -> None:
        self.finish, self.need, self.parts = finish, need, []


def _small(value) -> str | None:
    """A short value as text. Long ones stay lists, so that nested groups aren't copied level by level."""
    if isinstance(value, list) and sum(len(x) for x in value if isinstance(x, str)) <= 64 and all(isinstance(x, str) for x in value):
        return "".join(value)
    return value if isinstance(value, str) else None


def _flat(value) -> str:
    out, rest = [], [value]
    while rest:
        x = rest.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            rest += reversed(x)
    return "".join(out)


class _Reader:
    """A reader of mathematical text: a cursor over characters that writes one plain form.

    units: unit words and wrapped fillers go (short answers); else they stay, and common forms
    of fractions are made one.
    """

    def __init__(self, text: str, units: bool) -> None:
        self.text, self.at, self.units = text, 0, units
        self.stack = [_Frame(None)]
        #: Whether a closing bracket may still come.
        self.brackets = True

    def read(self) -> str:
        while self.at < len(self.text):
            top, c = self.stack[-1], self.text[self.at]
            if c == "\\":
                self.named(self.command())
            elif top.need is not None:
                self.at += 1
                if c == "{":
                    self.stack.append(_Frame(lambda inner: inner))
                else:
                    self.give(c)
            elif c == "}" and len(self.stack) > 1:
                self.at += 1
                self.shut()
            elif c == "{":
                self.at += 1
                self.stack.append(_Frame(lambda inner: "" if _small(inner) == "," else ["{", inner, "}"]))
            elif c == "^":
                self.at += 1
                self.stack.append(_Frame(self.raised, 1))
            elif c.isascii() and c.isalpha():
                self.give(self.word())
            else:
                self.at += 1
                self.give("" if c.isspace() or c == "$" or (self.units and c == '"') or (not self.units and c == "%") else c)
        while len(self.stack) > 1:  # what the text leaves open ends with it
            if self.stack[-1].need is None:
                self.shut()
            else:
                self.give("")
        return _flat(self.stack[0].parts)

    def give(self, value) -> None:
        """Hands a value to what is being read; with its last argument a command has its own."""
        while True:
            top = self.stack[-1]
            top.parts.append(value)
            if top.need is None or len(top.parts) < top.need:
                return
            self.stack.pop()
            value = top.finish(*top.parts)

    def shut(self) -> None:
        top = self.stack.pop()
        whole = _small(top.parts)
        self.give(top.finish(top.parts if whole is None else whole))

    def command(self) -> str:
        """The name after a backslash: letters, or one mark. A number or letter may follow frac and sqrt at once."""
        m = _COMMAND.match(self.text, self.at + 1)
        self.at += 1 + (len(m[0]) if m else 0)
        return m[0] if m else ""

    @staticmethod
    def raised(over):
        """A superscript; degrees go."""
        over = over if _small(over) is None else _small(over)
        return "" if over == "\\circ" else ["^", over] if isinstance(over, str) and len(over) == 1 else ["^{", over, "}"]

    def word(self) -> str:
        m = _WORD.match(self.text, self.at)
        self.at = m.end()
        if not self.units:
            return m[0]
        left = m[0]
        if left == "children" and (more := _TICKETS.match(self.text, self.at)):
            self.at = more.end()
            return ""
        for unit in UNIT_WORDS:
            left = left.replace(unit, "")
        return left

    def named(self, name: str) -> None:
        if name in IGNORED_COMMANDS:
            self.give("")
        elif name == "mathrm" and self.units and self.text.startswith("{th}", self.at):
            self.at += 4
            self.give("")
        elif name.endswith("frac"):
            kind = name if self.units else "frac"
            self.stack.append(_Frame(lambda over, under: [f"\\{kind}{{", over, "}{", under, "}"], 2))
        elif name == "sqrt":
            while self.text[self.at : self.at + 1].isspace():
                self.at += 1
            index = self.index()
            self.stack.append(_Frame(lambda inner: [f"\\sqrt{index}{{", inner, "}"], 1))
        elif name in UNWRAPPED_COMMANDS and self.text.startswith("{", self.at):
            self.stack.append(_Frame(lambda inner: self.unwrapped(name, inner), 1))
        else:
            self.give("\\" + name)

    def unwrapped(self, name: str, inner):
        """The inside of a wrapper; in short answers a filler goes, and a power of a unit with it."""
        whole = (_small(inner) or "").strip() if _small(inner) is not None else None
        if self.units and name in ("text", "mbox") and whole in TEXT_FILLERS:
            if whole in ("", "m") and self.text.startswith(("^2", "^3"), self.at):
                self.at += 2
            return ""
        if not self.units and name == "mbox" and whole in TEXT_FILLERS:
            return ""
        return inner

    def index(self) -> str:
        if not self.brackets or not self.text.startswith("[", self.at):
            return ""
        end = self.text.find("]", self.at)
        self.brackets = end >= 0
        out = self.text[self.at : end + 1] if end >= 0 else ""
        self.at += len(out)
        return out


def strip_latex(text: str, left_side: bool = False) -> str:
    """A plain form of a mathematical answer: without layout, degrees, per cent, currency, trailing units and blanks.

    A short left side (as in k = ...) goes unless left_side, roots and fractions have braces,
    a fraction of whole numbers and one half are written as fractions, and no number begins
    with a point. What a text leaves open ends with it; nesting has no bound.
    """
    unit = text.find("\\text{ ")
    plain = _Reader(text if unit < 0 else text[:unit], False).read()
    plain = re.sub(r"(?<![0-9])[.](?=[0-9])", "0.", plain)
    left, mark, right = plain.partition("=")
    if mark and not left_side and "=" not in right and len(left) <= 2:
        plain = right
    if m := re.fullmatch(r"(-?[0-9]+)/(-?[0-9]+)", plain):
        plain = f"\\frac{{{m[1]}}}{{{m[2]}}}"
    return "\\frac{1}{2}" if plain == "0.5" else plain


def final_answer(text: str) -> str:
    """The normal form of short answers: what follows the last =, of a formula between dollar signs its inside, without
    articles, units, layout and blanks; a number without commas.

    An article goes wherever its letters and a blank stand, also at the end of a word.
    """
    text = text.rpartition("=")[2]
    for article in ARTICLES:
        text = text.replace(article, "")
    text = text.replace("\\$", "")
    before, dollar, rest = text.partition("$")
    if dollar and "$" in rest:
        text = rest.partition("$")[0]
    plain = _Reader(text.replace(",\\!", "").replace("{,}", ""), True).read()
    bare = plain.replace(",", "")
    return bare if bare.isdigit() else plain


def verdict(a: str, b: str, tolerance: float = 1e-4, percentage: bool = True) -> str:
    """EQUAL, DIFFERENT or NOT_EVALUATED: equal as plain forms, or as compared() says of them.

    Two equations are compared whole; of one against an expression, a short left side goes.
    Short pairs are remembered: many samples of a prompt give one answer.
    """
    return (_remembered if len(a) + len(b) <= REMEMBERED else _verdict)(a, b, tolerance, percentage)


def _verdict(a: str, b: str, tolerance: float, percentage: bool) -> str:
    x, y = strip_latex(a), strip_latex(b)
    if x == y:
        return EQUAL
    if "=" in a and "=" in b:
        x, y = strip_latex(a, True), strip_latex(b, True)
    return compared(x, y, tolerance, percentage)


_remembered = functools.lru_cache(1 << 14)(_verdict)


def numeric_equal(a: str, b: str, tolerance: float = 1e-4, percentage: bool = True) -> bool:
    """Whether the verdict is EQUAL; what can't be evaluated isn't."""
    return verdict(a, b, tolerance, percentage) == EQUAL


__all__ = ["DIFFERENT", "EQUAL", "NOT_EVALUATED", "final_answer", "numeric_equal", "strip_latex", "verdict"]
