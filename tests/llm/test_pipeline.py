"""The stages of the corpus pipeline against brute force on a small fixture, and on odd documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkgrade.llm import bpe

ITEMS = [(i, " ".join(f"q{i}_{k}" for k in range(20))) for i in range(5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents: clean ones, toxic ones, near copies, ones with a test item, ones with a secret, and odd ones."""
    rnd = random.Random(41)
    words = [f"w{i}" for i in range(400)]
    text = lambda n=60: [rnd.choice(words) for _ in range(n)]
    docs, kind, base = [], {}, text()
    for i in range(700):
        body = text()
        if i % 7 == 1:
            kind[i], body = "toxic", [*body[:30], "vile", "awful", "rotten", *body[30:]]
        elif i % 35 == 2:
            kind[i], body = "copy", [*base[:50], f"x{i}", *base[51:]]
        elif i % 35 == 3:
            kind[i], body = "item", [*body[:20], *ITEMS[i % 5][1].split(), *body[20:]]
        elif i % 35 == 4:
            kind[i], body = "secret", [*body[:20], f'token = "{rnd.randrange(16**40):040x}"', *body[20:]]
        docs.append((i, " ".join(body)))
    docs += [(9000, None), (9001, ""), (None, "lonely words here"), (9002, "short"), (9003, " ".join(text(40_000)))]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kind.get(i) == "toxic")) for i in range(700)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"{at}", docs, kind


def test_pipeline(spark, folder):
    at, docs, kind = folder
    kept, stage = {}, spark.read.parquet(f"{at}/documents.parquet")
    columns = stage.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = corpus_pipeline.written(f(spark, stage, at), "stage")
        assert stage.columns == columns
        kept[name] = {r.doc_id: r.text for r in stage.select("doc_id", "text").collect()}
    toxic, near, clean, secret = (kept[name] for name, _ in corpus_pipeline.STAGES[:-1])
    of = lambda k: {i for i, x in kind.items() if x == k}
    every = {i for i, _ in docs}
    assert len(of("toxic") & toxic.keys()) <= 5 and len(every - of("toxic") - toxic.keys()) <= 5
    assert near.keys() == toxic.keys() - (of("copy") & toxic.keys()) | {min(of("copy") & toxic.keys())}
    assert clean.keys() == near.keys() - of("item")
    assert secret.keys() == clean.keys()
    for i, text in clean.items():
        if i in of("secret"):
            assert secret[i] == re.sub(r'token = "[0-9a-f]{40}', "[SECRET]", text)
        else:
            assert secret[i] == text
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert got.keys() == secret.keys()
    own = bpe.vocabulary(bpe.default_path())
    assert all(got[i].n_tokens == len(own.encode(t)) for i, t in secret.items())
    assert np.mean([r.n_tokens for r in got.values()]) > 10


def test_pipeline_of_no_documents(spark, folder, tmp_path):
    at, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_remembers_a_lone_match_once():
    own = bpe.ByteBpe(bpe.default_path())
    texts = [f"word{i} more words, {i} of them" for i in range(50)]
    ids = own.encode_all(pa.array(texts))
    assert " more" in own.pieces and " more" not in own.matches and " words" in own.matches
    assert [own.decode(x).decode() for x in ids] == texts and [x.tolist() for x in ids] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["a " * 50_000] * 40})
    assert max(s.column(1).nbytes for s in bpe.slices(batch)) < 2 << 20
