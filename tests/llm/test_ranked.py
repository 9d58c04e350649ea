"""Ranked search against brute force in Python integers, and odd inputs."""

import math
import random
import re
import string
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sparkgrade.llm import ranked

DOCS = "doc_id long, text string, item_id int, term int, v string, a string, n int, key int"
ITEMS = "item_id long, text string, doc_id int, score string, item int"


def terms(text):
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    bags = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), bag, n in zip(docs, bags, sizes, strict=True):
            m = 50 + (50 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 1, "v", "a", 1, 1) for i, t in docs], DOCS).repartition(4)
    got = ranked.search(d, spark.createDataFrame([(i, t, 1, "s", 1) for i, t in items], ITEMS), **more).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "中文", "UP", "up"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda m: draw.choice((" ", "--", "\n")).join(draw.choices(words, weights, k=m))
    docs = [(i, text(draw.randint(1, 60))) for i in range(n)]
    items = [(i, text(draw.randint(1, 25))) for i in range(12)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus(1, 400)
    docs += [(900 - i, docs[3][1]) for i in range(80)]  # more copies than ranks: the smallest ids count
    docs += [(None, docs[5][1]), (5, docs[6][1]), (5, docs[5][1]), (1000, None), (1001, ""), (1002, " .,-\x7f"), (1003, "w1 " * 60_000 + "w40")]
    items += [(3, items[4][1]), (3, items[3][1]), (None, "w2 w50"), (20, None), (21, "... "), (22, "nowhere"), (23, docs[3][1])]
    assert found(spark, docs, items) == brute(docs, items, 50)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_items_in_blocks(spark, monkeypatch):
    docs, items = corpus(2, 150)
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 300)
    assert found(spark, docs, items, k=7) == brute(docs, items, 7)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None), (2, "")], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_nothing_to_find(spark, docs, items):
    assert found(spark, docs, items) == []


def test_every_document_has_the_only_term(spark):
    docs = [(i, "same") for i in range(70)]
    assert found(spark, docs, [(1, "same")]) == brute(docs, [(1, "same")], 50)


@pytest.mark.parametrize(("chunk", "cells"), [(7, 9), (40, 1000), (10**6, 10**6)])
def test_candidates_hold_the_best_over_any_cut(monkeypatch, chunk, cells):
    monkeypatch.setattr(ranked, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(ranked, "CELLS", cells)
    draw = random.Random(4)
    block = ranked._Items([1, 2, 3], ["a b c d", "c d e", "f a"])
    rows = sorted((c, t, draw.randint(1, 1000)) for c in range(60) for t in draw.sample(range(len(block.vocabulary)), 3))
    full = {(i, c): sum(v for d, t, v in rows if d == c and t in set(block.terms[i].tolist())) for i in range(3) for c in range(60)}
    kth = {i: sorted((full[i, c] for c in range(60)), reverse=True)[4] for i in range(3)}
    told = ranked._Thresholds(block, {i: int(kth[i] * 0.8) for i in range(3)}, 5)
    low = dict(told.lowest())
    sent = [r for r in rows if r[2] >= low[r[1]]]
    batches = [pa.RecordBatch.from_pydict({"class": [r[0] for r in sent[k : k + 5]], "term": [r[1] for r in sent[k : k + 5]], "v": [r[2] for r in sent[k : k + 5]]}) for k in range(0, len(sent), 5)]
    got = {(i, c): (p, u) for b in ranked._candidates(iter(batches), SimpleNamespace(value=told)) for i, c, p, u in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    for (i, c), s in full.items():
        if s >= kth[i]:
            assert got[i, c][0] <= s <= got[i, c][1]
    assert all(p <= full[x] for x, (p, _) in got.items())


def test_thresholds_are_sent_exactly():
    block = ranked._Items([1, 2], ["x y", "y"])
    told = ranked._Thresholds(block, {0: 21, 1: 10}, 1)
    y = int(block.terms[1][0])
    partial, upper = told.sums(np.array([0, 1, 2]), np.array([y, y, y]), np.array([9, 10, 11]), 3)
    assert partial.tolist() == [[0, 0], [0, 10], [11, 11]] and upper.tolist() == [[0, 0], [0, 10], [21, 11]]
