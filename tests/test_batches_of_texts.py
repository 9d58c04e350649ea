"""Equal texts of a batch are parsed once, and short paths give what the long ones do."""

import random

import pytest

from sparkgrade.functions import boxes, parsers
from sparkgrade.functions.registry import TOOL_PARSERS


def test_equal_texts_of_a_batch_are_parsed_once(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"

    def noted(text):
        with open(seen, "a") as out:
            out.write(text + "\n")
        return [("f", text)]

    monkeypatch.setattr(TOOL_PARSERS, "resolve", lambda name: noted)
    rows = spark.createDataFrame([(None if i % 4 == 3 else f"t{i % 4}",) for i in range(400)], "t string").coalesce(1)
    got = [tuple((c.name, c.arguments) for c in r[0]) for r in rows.select(parsers.tool_calls(rows.t, "x")).collect()]
    assert got == [() if i % 4 == 3 else (("f", f"t{i % 4}"),) for i in range(400)]
    assert sorted(seen.read_text().split()) == ["t0", "t1", "t2"]


def test_one_box_each_as_by_coordinates():
    r = random.Random(6)
    for _ in range(2000):
        a, b = ([r.randrange(-2, 9) * r.choice((1, 0.5)) for _ in range(4)] for _ in range(2))
        # A box twice covers what it covers once, and takes the general path.
        assert boxes.union_area([a], [b]) == boxes.union_area([a, a], [b])
    boxes._wanted.cache_clear()
    for i in range(50):
        boxes.parts(f'so {{"answer": "{i}", "boxes": []}}', '{"answer": "(7)", "boxes": []}')
    assert boxes._wanted.cache_info().misses == 1


@pytest.mark.parametrize("text", ["", " ", "x", "<a>{\"b\": 1}", " {\"a\": 1}", "[1]", "[{\"a\": 1}] {", "nul {\"a\": 2}", "NaN", "﻿{\"a\": 1}", "\x0b{\"a\": 1}", "\"{}\"", "{\"a\": {\"b\": 1}} {\"c\": 2}", "-", "true"])
def test_last_object_as_by_loading_first(text):
    import json

    try:
        value = json.loads(text)
        want = value if isinstance(value, dict) else None
    except ValueError:
        found = parsers.objects_in(text)
        want = max(found, key=lambda f: f[0])[1] if found else None
    assert parsers.last_object(text) == want
