"""Places of a long key at which a source may begin: found without a row for every character."""

import random

from sparkgrade.operators import matching


def test_sources_at_any_place_and_few_places_asked(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdeäß😀") for _ in range(n))
    sources = [(i, text(matching.SHORTEST + i % 40)) for i in range(40)] + [(40, text(matching.SHORTEST - 1))]
    records = [(i, text(r.randrange(900)) + sources[i][1] + text(r.randrange(900))) for i in range(41)] + [(90, text(3000)), (91, None), (92, ""), (93, sources[5][1]), (94, sources[40][1])]
    s, d = spark.createDataFrame(sources, "o int, k string"), spark.createDataFrame(records, "r int, k string")
    got = {x.r: x.o for x in matching.trace_back(d, s, "r", "k", "k", "o").collect()}
    assert got == {i: i for i in range(40)} | {40: None, 90: None, 91: None, 92: None, 93: 5, 94: 40}
    asked = matching._asked(d.selectExpr("xxhash64(k) AS _id", "k AS _k").where(f"char_length(k) >= {matching.SHORTEST}"), matching.heads(s, "k")).count()
    assert 41 <= asked < 80
    none = s.where("o < 0")
    assert [x.o for x in matching.trace_back(d, none, "r", "k", "k", "o").collect()] == [None] * len(records)
    assert matching.trace_back(d.where("r < 0"), s, "r", "k", "k", "o").count() == 0
    places = matching._places(records[0][1])
    assert all(places[i] == matching._places(records[0][1][i : i + matching.SHORTEST])[0] for i in range(len(places)))
