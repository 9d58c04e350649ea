"""The n-gram join where ids don't tell rows apart, and its search over any block sizes."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrade.llm import jaccard


def near_copies(n, draw):
    base = [f"w{k}" for k in range(200)]
    out = []
    for k in range(n):
        text = list(base)
        text[draw.randrange(200)] = f"x{k}"
        out.append(" ".join(text))
    return out


def test_rows_without_ids_take_no_longer(spark):
    texts = near_copies(700, random.Random(1))
    took = []
    for ids in (range(700), [None] * 700, [7] * 700):
        began = time.time()
        got = jaccard.join(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4), 3, 90).collect()
        took.append(time.time() - began)
        assert len(got) == 700 and {r.component_id for r in got} == {min((i for i in ids if i is not None), default=None)}
    assert max(took[1:]) < 3 * took[0] + 10


def test_one_of_each_after_a_clash(spark, monkeypatch):
    """Where seed 0 has a clash, the nodes are another seed's; rows with null and repeated ids are found by them all the same."""
    scan = jaccard._scan
    monkeypatch.setattr(jaccard, "_scan", lambda docs, words, seed: scan(docs, words, seed).withColumn("check", F.when(F.lit(seed == 0), F.monotonically_increasing_id()).otherwise(F.col("check"))))
    texts = near_copies(3, random.Random(2))
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, "one other text of five words or more"), (None, "another text that nobody else has here"), (None, ""), (9, "one other text of five words or more")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert kept == sorted([(5, texts[2]), (5, "one other text of five words or more"), (None, "another text that nobody else has here"), (None, "")], key=repr)


@pytest.mark.parametrize(("merge", "probe"), [(1, 1), (3, 2), (4096, 16)])
def test_search_equals_all_pairs(monkeypatch, merge, probe):
    monkeypatch.setattr(jaccard, "MERGE_BLOCK", merge)
    monkeypatch.setattr(jaccard, "PROBE_BLOCK", probe)
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        own = draw.choice(400, draw.integers(1, 80), replace=False) if not sets or draw.random() < 0.4 else np.setxor1d(sets[draw.integers(len(sets))].astype(int), draw.choice(400, draw.integers(0, 9), replace=False))
        sets.append(np.sort(own).astype(np.uint64))
    index = jaccard.Cluster(sets)
    for percent in (50, 80, 90):
        for i, q in enumerate(sets):
            want = {j for j, s in enumerate(sets) if len(q) and 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))}
            assert set(index.search(q, percent, lambda x: False)) == want, (percent, i)


def test_parities_rule_out_no_linked_pair():
    draw = np.random.default_rng(5)
    seen = {True: 0, False: 0}
    for _ in range(2000):
        a = np.unique(draw.integers(0, 1 << 62, draw.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < draw.choice([0.3, 0.8, 0.9, 1])], draw.integers(0, 1 << 62, draw.integers(0, 60)).astype(np.uint64)]))
        if len(b):
            linked = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            near = jaccard.may_link(jaccard.parity(a), len(a), jaccard.parity(b), len(b), 80)
            assert near or not linked
            seen[linked] += 1
    assert min(seen.values()) > 100


def test_a_shared_passage_makes_no_cluster(spark, monkeypatch):
    """Texts that share a passage, half of each, aren't gathered: only near copies are dealt to a cluster, however many nodes a signature pairs at once."""
    rows = []
    for k in range(60):
        own = [f"own{k}x{i}" for i in range(60)]
        rows += [(2 * k, " ".join([f"p{i}" for i in range(60)] + own)), (2 * k + 1, " ".join([f"p{i}" for i in range(60)] + own[:-1] + ["end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes, links = [], jaccard._all_links

    def counted(given, members, *rest):
        sizes.append(members.groupBy("cluster").count().agg(F.max("count")).first()[0])
        return links(given, members, *rest)

    monkeypatch.setattr(jaccard, "_all_links", counted)
    for few in (8, 1):
        monkeypatch.setattr(jaccard, "FEW_NODES", few)
        got = {r.doc_id: r.component_id for r in jaccard.join(docs, 3, 80).collect()}
        assert got == {k: k - k % 2 for k in range(120)}
    assert sizes == [2, 2]


def test_near_pairs_of_a_task_join_what_all_near_pairs_join():
    draw = np.random.default_rng(7)
    base = np.unique(draw.integers(0, 1 << 62, 260).astype(np.uint64))
    sets = []
    for _ in range(80):
        passage = base[: draw.integers(40, 250)] if draw.random() < 0.5 else sets[draw.integers(len(sets))][3:] if sets else base
        sets.append(np.unique(np.concatenate([passage, draw.integers(0, 1 << 62, draw.integers(1, 30)).astype(np.uint64)])))
    bits, n, group = [jaccard.parity(s) for s in sets], np.array([len(s) for s in sets]), np.arange(80) // 2

    def groups(pairs):
        up = jaccard._Joined()
        for a, b in pairs:
            up.up[up.root(a)] = up.root(b)
        return {frozenset(i for i in range(80) if up.root(i) == r) for r in {up.root(i) for i in range(80)}}

    own = [(2 * k, 2 * k + 1) for k in range(40)]
    for percent in (80, 90):
        near = [(i, j) for i in range(80) for j in range(i) if jaccard.may_link(bits[i], int(n[i]), bits[j], int(n[j]), percent)]
        got = list(jaccard._Joined().near(np.arange(80), group, n, bits, percent))
        assert groups(own + got) == groups(own + near) and set(map(frozenset, got)) <= set(map(frozenset, near))
        assert 0 < len(got) < 40 and len(near) > len(got)


def test_a_signature_of_many_gives_no_pairs_but_what_joins_groups(spark, monkeypatch):
    """Rows made for texts that share a passage don't grow with the square of their number; sets that are too long to carry their parities have the same groups."""
    made, across = [], jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *given: made.append(across(*given)) or made[-1])
    passage = " ".join(f"p{i}" for i in range(60))
    for many in (60, 120):
        rows = [(k, passage + "".join(f" own{k // 2}x{i}" for i in range(60)) + f" end{k % 2}") for k in range(many)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for held in (512, 0):
            monkeypatch.setattr(jaccard, "HELD_BITS", held)
            made.clear()
            counts = []
            monkeypatch.setattr(jaccard, "remove", lambda *tables: counts.append(made[0].count()) if made and not counts else None)
            assert {r.doc_id: r.component_id for r in jaccard.join(docs, 3, 80).collect()} == {k: k - k % 2 for k in range(many)}
            assert counts[0] <= many if held else counts[0] > many
