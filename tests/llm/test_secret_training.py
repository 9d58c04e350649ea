"""The network of the secret scan learns from, and is calibrated on, every finding."""

import numpy as np
import pytest
from test_operators import labelled_texts

from sparkgrade.llm import secrets
from sparkgrade.llm.calibration import calibrated


def test_every_finding_is_fitted_or_calibrates(spark, monkeypatch):
    """Shards of few rows: none is left out, long ones neither, and the order and partitions of the texts don't matter."""
    rows = [(i, t) for i, t in enumerate(labelled_texts())] + [(-1, 'token = "' + "a1" * 400 + '"')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(tuple(x.encode() for x in found), label) for _, t in rows for found, label in secrets._findings(t)}
    found = secrets.labelled_findings(df).collect()
    assert {(tuple(bytes(r.window).split(b"\0", 2)), r.label) for r in found} == want and len(found) == len(want)
    assert any(len(w[1]) > 512 for w, _ in want)
    seen = []
    inner = secrets._round
    monkeypatch.setattr(secrets, "_round", lambda s, own, *more: seen.append((own.count(), own.select("shard").distinct().count())) or inner(s, own, *more))
    net = secrets.trained(df, rows=100)
    assert len(seen) == secrets.ROUNDS and seen[0][1] > 3 and seen[0][0] + net.report["rows"] == len(want)
    assert net.report["recall"] >= secrets.RECALL
    again = secrets.trained(df.orderBy(df.doc_id.desc()).repartition(3), rows=100)
    assert again.threshold == net.threshold and all((again.p[k] == net.p[k]).all() for k in net.p)


def test_counted_rows_calibrate_as_rows_do():
    rnd = np.random.default_rng(1)
    x, y, n = rnd.integers(-9, 9, 60) / 4, rnd.random(60) < 0.5, rnd.integers(1, 5, 60)
    assert calibrated(x, y, n.astype(float)) == pytest.approx(calibrated(np.repeat(x, n), np.repeat(y, n)), abs=1e-9)
    net, plain = secrets.CharNet(), secrets.CharNet()
    net.calibrate(x, y, n.astype(float))
    plain.calibrate(np.repeat(x, n), np.repeat(y, n), np.ones(n.sum()))
    assert net.threshold == pytest.approx(plain.threshold) and net.report == pytest.approx(plain.report)


def test_a_score_does_not_depend_on_the_rows_beside_it():
    windows = [w for t in labelled_texts(60) for w, _ in secrets._findings(t)]
    net = secrets.CharNet()
    alone = np.concatenate([net.logits([w]) for w in windows])
    assert net.logits(windows) == pytest.approx(alone, abs=1e-9)
