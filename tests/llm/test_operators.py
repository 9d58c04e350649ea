"""The corpus operators on small fixtures: brute force, exact round trips, held-out accuracy, and odd inputs."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkgrade.llm import bpe, decontamination, hashing, jaccard, pii, quality, records, secrets, sharding, toxicity, urls
from sparkgrade.llm.common import shared_path

#: Null, empty, blank, short, repeated and long texts; ids that are null and repeated; columns whose names clash with the operators'.
LONG = "la " * 60_000 + "end"
ODD = [(None, None), (None, "x"), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (4, "one two"), (5, LONG), (6, "a\u00e9\U0001f600\u4e2d b\x00c"), (7, "ONE  two\nthree"), (8, "one")]
SCHEMA = "doc_id long, text string, lang string, source string, n int, node string, shard string, score string, label string, h string, base string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, 1, "n", "s", "s", "l", "h", "b") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1. Sharding.


def jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards_equal_the_published_algorithm(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *(random.Random(3).randrange(-(2**63), 2**63) for _ in range(500))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: (r.s.shard, r.s.grown) for r in df.select("k", sharding.jump_shards(df.k, 40).alias("s")).collect()}
    assert got == {k: (jump(k, 40), jump(k, 41)) for k in keys}
    assert all(a == b or b == 40 for a, b in got.values())


def test_shards(spark, odd, none):
    rows = sharding.shard(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is None, i or 0, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.shard == jump(r.doc_id or 0, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).collect() == []


def test_copies_of_one_row_have_gapless_slots(spark):
    rows = sharding.shard(spark.range(70_000).selectExpr("CAST(5 AS long) AS doc_id", "'same' AS text")).select("slot").collect()
    assert sorted(r.slot for r in rows) == list(range(70_000))


# 2. N-gram Jaccard join.


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_groups(rows, n, percent):
    sets, lists, up = [shingle_set(t, n) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, o in Counter(j for x in s for j in lists[x]).items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in s:
            lists[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(n=120):
    rnd, base = random.Random(2), [f"w{i}" for i in range(60)]
    out = []
    for k in range(n):
        words = base[:]
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(60)] = f"x{rnd.randrange(1000)}"
        out.append((500 + k, " ".join(words)))
    return out + [(900 + i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(12)))) for i in range(100)]


@pytest.mark.parametrize(("n", "percent", "most"), [(3, 90, jaccard.CLUSTER_SHINGLES), (5, 80, 800)])
def test_jaccard_join_against_brute_force(spark, n, percent, most):
    """The second case splits its clusters into blocks of 800 shingles."""
    rows = near_copies() + [r for r in ODD if r[1] != LONG] + [(950, "q r s t u v"), (951, "q r s T u v")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent, most)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_groups(rows, n, percent)


def test_jaccard_join_of_odd_rows(spark, odd, none):
    assert jaccard.join(odd).count() == len(ODD) and jaccard.join(none).count() == 0


def test_one_of_each_group_stays(spark):
    rows = near_copies(60)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    groups = {d: c for d, _, c in brute_groups(rows, 5, 80)}
    ids = [str(r.doc_id) for r in kept.collect()]
    wordless = [str(d) for d, t in rows if not t.split()]
    assert sorted(groups[i] for i in ids) == sorted(set(groups.values()) | set(wordless))


def test_repeated_ids_keep_one_row_of_a_group(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l m"), (None, "g h i j k l m"), (3, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in jaccard.one_of_each(df).collect()) == [("1", "a b c d e f"), ("2", "g h i j k l m"), ("3", "")]


def test_names_of_columns_that_the_join_uses(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (1, "a b c d e f", 1, 2, 3), (2, "x y", 1, 2, 3)], "doc_id long, text string, group_node int, group_component int, rank_node int")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_a_task_that_runs_again_gives_the_same_signatures(spark):
    docs = spark.createDataFrame(near_copies(60), "doc_id long, text string").coalesce(2)
    common = np.zeros(jaccard.SKETCH, bool)
    once, again = (sorted(map(tuple, jaccard._signed(docs, 3, 90, 0, common).collect())) for _ in range(2))
    assert once == again


def test_large_clusters_in_blocks_of_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CLUSTER_SETS", 20)
    rows = near_copies(150)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_groups(rows, 3, 90)


def test_divide_skip_finds_what_counting_finds():
    rnd = random.Random(4)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randrange(1, 50))], dtype=np.uint64)) for _ in range(80)]
    index = jaccard.Cluster(sets)
    for q in sets:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))}
        assert set(index.search(q, 60, lambda x: False)) == want


# 3. Toxicity.


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(1)
    words, bad = [f"w{i}" for i in range(300)], ["awful", "rotten", "vile"]
    rows = []
    for i in range(1500):
        text = [rnd.choice(words) for _ in range(rnd.randrange(30, 120))]
        if i % 3 == 0:
            for _ in range(4):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, rows[i][2]) for i, r in got.items() if r.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_evidence_against_a_plain_kneser_ney_model():
    """The same sums by dictionaries: distinct left contexts, absolute discount, shared backoff."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefgh") + rnd.choice(["", "x"]) for _ in range(rnd.randrange(1, 14))) for _ in range(160)]
    marks = [int(rnd.random() < 0.4 or "ax" in t) for t in texts]
    model = toxicity.ToxicityModel(texts, marks)
    label = {}
    for t, m in zip(texts, marks, strict=True):
        label[t] = max(m, label.get(t, 0))
    own = [[t for t in label if label[t] == k] for k in (0, 1)]
    fitted = [o[int(toxicity.CALIBRATE * len(o)) :] for o in own]
    known = {w for o in fitted for t in o for w in t.split()}
    pairs = lambda t: list(zip(["^", *(w if w in known else "?" for w in t.split())], [w if w in known else "?" for w in t.split()]))
    count = [Counter(p for t in o for p in set(pairs(t))) for o in fitted]
    cont = [Counter(w for _, w in c) for c in count]
    both = Counter(w for _, w in count[0].keys() | count[1].keys())
    both["?"] += 1
    share = lambda a, b, n, m: max(a / n - b / m, 0) / (a / n + b / m + 1 / n + 1 / m)
    kept = lambda c, totals, k, x: max(c[k][x] - toxicity.DISCOUNT, 0) * share(c[k][x], c[1 - k][x], totals[k], totals[1 - k]) ** model.power
    sizes, seen = [len(o) for o in fitted], [sum(c.values()) for c in cont]
    shared = lambda w: both[w] / sum(both.values())
    low_kept = [sum(kept(cont, seen, k, w) for w in both) for k in (0, 1)]
    low_back = 1 - sum(low_kept) / sum(seen)
    low = lambda k, w: (1 - low_back) * kept(cont, seen, k, w) / low_kept[k] + low_back * shared(w) if low_kept[k] else shared(w)

    def p(k, h, w):
        under = {x for x in count[0].keys() | count[1].keys() if x[0] == h}
        held = sum(kept(count, sizes, k, x) for x in under)
        if not held:
            return low(k, w)
        back = 1 - sum(kept(count, sizes, j, x) for j in (0, 1) for x in under) / sum(count[j][x] for j in (0, 1) for x in under)
        return (1 - back) * kept(count, sizes, k, (h, w)) / held + back * low(k, w)

    asked = [*texts[:40], "ax ax b", "unknown a other", ""]
    want = [sum(math.log(p(1, *x) / p(0, *x)) for x in pairs(t)) / (len(t.split()) + toxicity.PRIOR_WORDS) for t in asked]
    assert model.evidence(pa.array(asked)).tolist() == pytest.approx(want, abs=1e-5)
    for k in (0, 1):  # both are distributions
        assert sum(low(k, w) for w in both) == pytest.approx(1)
        assert sum(p(k, "a", w) for w in both) == pytest.approx(1)


def test_rare_expressions_count_for_something():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(100)]
    texts, marks = [], []
    for i in range(300):  # the first 90 of each class calibrate
        rare = 45 + i if i < 90 else i // 2 if i % 3 else 1000 + i
        for mark, name in ((1, "bad"), (0, "name")):
            texts.append(" ".join([*rnd.choices(words, k=20), f"{name}{rare}", *rnd.choices(words, k=20)]))
            marks.append(mark)
    model = toxicity.ToxicityModel(texts, marks)
    for rare in (60, 100, 149):
        for own, its in model.evidence(pa.array([f"w1 w2 bad{rare} w3", f"w1 w2 name{rare} w3"])).reshape(-1, 2):
            assert own > its


def test_labels_without_documents_do_not_count(spark):
    docs = spark.createDataFrame([(i, f"{'vile ' * (i % 2)}w{i % 7} w{i % 5}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(10_000 + i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rows=60)
    assert model.score(pa.array(["vile w1 w2"]))[0] > 0.5 > model.score(pa.array(["w1 w2"]))[0]


def test_toxicity_of_odd_rows(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    for labels in (empty, one):
        model = toxicity.fit(odd, labels)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert toxicity.reject(odd, model).columns == odd.columns
        assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, one).score(pa.array(["x"]))[0] < 0.5


# 4. Byte-level BPE.


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(reference_encoding):
    rnd, own = random.Random(5), bpe.vocabulary(bpe.default_path())
    texts = ["".join(rnd.choice(" \n\t\0ab,.A1\u00e9\u2603\U0001f600's  \n\u4e2d\u3000\x85<|endoftext|>") for _ in range(rnd.randrange(14))) for _ in range(3000)] + [LONG]
    for text, ids in zip(texts, own.encode_all(pa.array(texts)), strict=True):
        assert ids.tolist() == reference_encoding.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    text = "a\U0001f600 b"
    assert own.offsets(text, own.encode(text)).tolist() == [[0, 1], [1, 2], [1, 2], [2, 4]]


def test_bpe_frames(spark, odd, none, reference_encoding):
    rows = bpe.round_trip(odd, bpe.default_path()).collect()
    want = Counter()
    for i, t in ODD:
        ids = np.array(reference_encoding.encode_ordinary(t or ""), dtype="<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert bpe.round_trip(none, bpe.default_path()).count() == 0
    back = bpe.decode(bpe.encode(odd, bpe.default_path()), bpe.default_path()).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((i, (t or "").encode()) for i, t in ODD)


# 5. Quality rules.


def quality_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where, covered = defaultdict(list), set()
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    for places in where.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_brute_force(spark, none):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(["a", "b", "#", "\u00e9", " ", " ", "\n", "\t", "c d e", "|", "\U0001f600"]) for _ in range(rnd.randrange(90)))) for i in range(300)] + [(i + 5000, t) for i, t in ODD if i is not None and i != 4]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, text string, lang string, source string")
    for r in quality.judge(df).collect():
        want = quality_counts(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0


def test_adaptive_fences_keep_the_usual_and_drop_the_odd(spark):
    rnd = random.Random(7)
    usual = [(i, " ".join(f"{rnd.choice('abcde')}{rnd.randrange(999)}" for _ in range(100)), "x", "s") for i in range(200)]
    odd = [(1000, " ".join(f"#*$%&{i}" for i in range(100)), "x", "s")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not got[1000]


# 6. Records.


def test_records_round_trip(spark, odd, none, tmp_path):
    rows = near_copies(40) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = shared_path(spark, "records")
    told = records.write_records(docs, folder, bpe.default_path(), files=3)
    got = sorted(map(tuple, records.read_records(spark, folder, told).collect()), key=lambda r: r[1])
    own = bpe.vocabulary(bpe.default_path())
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(ids) + 1, zlib.crc32(np.append(ids, np.uint32(0)).astype("<u4").tobytes())) for i, ids in ((i, own.encode(t)) for i, t in rows))
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    part, count, _ = next(t for t in told if t[1] > 2)
    some = records.read_at(folder, part, [2, 0])
    assert len(some) == 2 and all(ids[-1] == 0 for _, ids in some)
    empty = shared_path(spark, "records")
    assert records.read_records(spark, empty, records.write_records(none, empty, bpe.default_path())).count() == 0


def test_records_are_what_the_library_encodes(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rnd, library = random.Random(15), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> a", "a<|endoftext|>b", "<|endoftext|>", *("".join(rnd.choice(["<|endoftext|>", " ", "\n", "\u00e9", "ab", "'s", "1", "\u4e2d"]) for _ in range(rnd.randrange(12))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = shared_path(spark, "records")
    told = records.write_records(docs, folder, bpe.default_path(), files=2)
    got = {r.doc_id: r for r in records.read_records(spark, folder, told).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    os.remove(f"{folder.removeprefix('file://')}/part-{told[0][0]:08d}.rec")
    with pytest.raises(ValueError, match="lacks"):
        records.read_records(spark, folder, told)


def test_copies_of_one_row_go_to_several_files(spark):
    docs = spark.range(0, 4000, 1, 4).selectExpr("CAST(7 AS long) AS doc_id", "'same text' AS text")
    told = records.write_records(docs, shared_path(spark, "records"), bpe.default_path(), files=4)
    assert sum(r for _, r, _ in told) == 4000 and max(r for _, r, _ in told) < 2500


def test_damaged_records_raise():
    data = bytearray(records.frame(records.pack(3, np.array([1, 70_000], dtype="<u4"))))
    doc_id, ids = records.unpack(records.unframe(bytes(data), 0)[0])
    assert doc_id == 3 and ids.tolist() == [1, 70_000]
    for at in (0, 9, 14, len(data) - 1):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises((ValueError, OverflowError)):
            records.unframe(bytes(bad), 0)


# 7. Secrets.


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_base_spans(spark, odd, none):
    rnd = random.Random(8)
    pieces = ["password", "Token", "api_key", "apikey", "=", ":", " ", '"', "abcdef12", "0123456789abcdef" * 2, "AKIA", "ABCDEF123456", "\U0001f600", "\n", "\u017fecret", "x"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))) for i in range(600)]
    net = secrets.CharNet()
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), net).collect():
        want = plain_secrets(dict(rows)[r.doc_id])
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans == told
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
    assert secrets.scan(odd, secrets.trained(odd)).count() == len(ODD)
    assert secrets.scan(none, secrets.trained(none)).count() == 0


def test_network_learns_and_redacts(spark):
    rnd = random.Random(9)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    word = lambda n: "".join(rnd.choice("aeiounrst") for _ in range(n))
    positive = [secrets.window(f"the token = {hexes(40)} is", 12, 52) for _ in range(300)]
    negative = [secrets.window(f"und die {(w := word(20))} ist", 8, 28) for _ in range(300)]
    net = secrets.fit(positive + negative, [1] * 300 + [0] * 300)
    assert (net.score(positive[:50]) >= net.threshold).mean() > 0.9 and not (net.score(negative[:50]) >= net.threshold).any() and net.report["recall"] >= secrets.RECALL
    df = spark.createDataFrame([(1, f"a password={hexes(18)} b", "k"), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, spans string")
    got = secrets.redact(df, net)
    assert got.columns == df.columns and {r.doc_id: r.text for r in got.collect()} == {1: "a [SECRET] b", 2: None, 3: "clean"}


def labelled_texts(n=400):
    rnd = random.Random(21)
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rnd.choice("aeiounrst") for _ in range(rnd.randrange(3, 25)))
    for i in range(n):
        words = [word() for _ in range(60)]
        if i % 3 == 0:
            words[rnd.randrange(60)] = f'token = "{hexes(40)}"'
        if i % 3 == 1:
            words[rnd.randrange(60)] = rnd.choice([str(rnd.randrange(10**16)), f"{word()}.{rnd.randrange(99)}@mail.example.com", "2024-01-15T10"])
        yield " ".join(words)


def test_network_adds_secrets_that_no_rule_names(spark):
    """The rules are masked in training: other names, alphabets and lengths are found, ordinary long words and numbers aren't."""
    texts = list(labelled_texts())
    net = secrets.trained(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert net.report["recall"] >= secrets.RECALL and net.report["precision"] > 0.95
    new = ['aeio pwd_live = "f2c81b7a90de4f1a6b3c" rst', 'clientkey = "Zk3pQ9xT7mB2vN8cR4wL" tre', 'passphrase = "9f8e7d6c5b4a39281706f5e4" no']
    plain = ["nine aeiounrstaeiounrstae more", "on 2024-01-15T10 and 1234567890123456 ", "see aeio.12@mail.example.com"]
    found = secrets.spans_of(pa.array(new + plain), net)
    assert sum(any(k == 3 for _, k, _ in f) for f in found[:3]) >= 2 and not any(found[3:])


def test_the_whole_of_a_long_candidate_is_read():
    """Pieces of places give what one convolution over all gives, wherever the candidate's mark is."""
    net, rnd = secrets.CharNet(3), random.Random(3)
    long = "".join(rnd.choice("abc") for _ in range(5000))
    windows = [("x" * 20, long[:k] + "Q7Z" + long[k:], " y") for k in (0, 2040, 2500, 4990)] + [("", "short123", "")]
    x, sizes = secrets.codes(windows)
    conv = np.maximum(net._patches(x) @ net.p["w"] + net.p["b"], 0)
    centre = np.arange(conv.shape[1]) + secrets._SPAN // 2
    flat = net._forward(x, sizes)[1]
    for i, n in enumerate(sizes):
        body = (centre >= secrets.CONTEXT) & (centre < secrets.CONTEXT + n)
        around = ~body & (centre < 2 * secrets.CONTEXT + n)
        assert np.allclose(flat[i], np.concatenate([conv[i, body].max(0), conv[i, around].max(0)]))
    assert np.allclose(net.logits(windows), [net.logits([w])[0] for w in windows])


def test_gradient_of_the_network():
    net, rnd = secrets.CharNet(5), random.Random(5)
    windows = [("ab = ", "".join(rnd.choice("abcXYZ019") for _ in range(rnd.randrange(8, 30))), " z") for _ in range(6)]
    (x, sizes), y, w = secrets.codes(windows), np.array([1, 0, 1, 0, 1, 1.0]), np.ones(6)

    def loss():
        p = secrets._sigmoid(net._forward(x, sizes)[-1])
        return -np.mean(w * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    g = net._gradient(x, sizes, y, w)
    for k, value in net.p.items():
        flat, own = value.reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(own))[:4]:
            before = flat[i]
            flat[i] = before + 1e-6
            up = loss()
            flat[i] = before - 1e-6
            down = loss()
            flat[i] = before
            assert own[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6), k


def test_texts_over_many_slices(spark, reference_encoding):
    """Batches of several slices, with nulls and letters beyond ASCII: every operator over Arrow batches sees each text whole."""
    rnd = random.Random(31)
    rows = []
    for i in range(60):
        text = None if i % 7 == 0 else " ".join(rnd.choice(["\u00e9t\u00e9", "na\u00efve", "w\u4e2d", "plain", f"n{rnd.randrange(9999)}"]) for _ in range(60_000 if i % 5 == 0 else 200))
        if i % 3 == 1 and text:
            at = rnd.randrange(len(text))
            text = f'{text[:at]} token = "{rnd.randrange(16**40):040x}" {text[at:]}'
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    net = secrets.CharNet()
    got = {r.doc_id: r for r in secrets.scan(docs, net).collect()}
    for i, text in rows:
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in plain_secrets(text or ""))
        assert got[i].spans == told
    clean = {r.doc_id: r.text for r in secrets.redact(docs, net).collect()}
    for i, text in rows:
        want = text
        for a, _, b in reversed([s for s in plain_secrets(text or "") if s[1] == 0]):
            want = want[:a] + "[SECRET]" + want[b:]
        assert (clean[i] is None) == (text is None) and (text is None or clean[i].replace('"', "") == want.replace('"', ""))
    encoded = {r.doc_id: r.n_tokens for r in bpe.round_trip(docs, bpe.default_path()).collect()}
    assert all(encoded[i] == len(reference_encoding.encode_ordinary(t or "")) for i, t in rows)
    model = toxicity.ToxicityModel(["bad bad awful", "good words here"] * 20, [1, 0] * 20)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(scores[i] == pytest.approx(model.score(pa.array([t], pa.string()))[0]) for i, t in rows)
    bench = spark.createDataFrame([(k, " ".join(rows[k][1].split()[-30:])) for k in (1, 5, 10, 25)], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert {(k, k) for k in (1, 5, 10, 25)} <= pairs
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {i for i, _ in rows} - {d for d, _ in pairs}


# 8. Personal data.

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]


def test_personal_data_base_spans(spark, odd, none):
    rnd = random.Random(10)
    pieces = ["1", "2", "99", "4111111111111111", "4", " ", "-", ".", "@", "+", "a", "_", "b.c", "\U0001f600", "\u00e9", "(", ")", "255", "256", "0", "\n", "\ue000", "\ue001"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(30)))) for i in range(1500)]
    model = pii.trained(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        found = [(k, m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, dict(rows)[r.doc_id]) if valid(k, m.group())]
        told = ",".join(f"{k}:{a}:{b}" for k, (a, b) in found)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _ in found) for x in PATTERNS]
    assert pii.scan(odd, pii.trained(odd)).count() == len(ODD) and pii.scan(none, pii.trained(none)).count() == 0


def test_addresses_with_zero_parts(spark):
    rnd = random.Random(12)
    parts = ["0", "00", "000", "1", "9", "10", "010", "99", "100", "199", "249", "255", "0255", "256", "0256", "300", "999", "1000", "0" * 4000]
    rows = [(i, f"at {t} now") for i, t in enumerate(["10.0.0.1", "0.0.0.0", "1.1.1.000", "192.168.0.1", "127.0.0.1", "256.0.0.1", *(".".join(rnd.choices(parts, k=4)) for _ in range(600))])]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string"), pii.Boosted()).collect()}
    for i, text in rows:
        found = [m.span() for m in re.finditer(PATTERNS["ip"], text) if valid("ip", m.group())]
        told = ",".join(f"ip:{a}:{b}" for a, b in found)
        assert got[i].n_ip == len(found) and got[i].spans == told and got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert [got[i].n_ip for i in range(6)] == [1, 1, 1, 1, 1, 0]


def test_trees_add_forms_that_no_rule_matches_and_redact(spark):
    rnd = random.Random(13)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        d = digits(15)
        return d + next(c for c in "0123456789" if valid("card", d + c))

    rows = []
    for i in range(800):
        kind = (f"w{i}@mail.example.com", ".".join(str(rnd.randrange(256)) for _ in range(4)), card(), f"+1 (555) {digits(3)}-{digits(4)}", digits(16), f"2024-0{rnd.randrange(1, 9)}-{rnd.randrange(10, 28)}", digits(8))[i % 7]
        rows.append((i, f"some words {kind} and others"))
    model = pii.trained(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.report["precision"] >= pii.PRECISION and model.report["recall"] > 0.5
    new = [(1, "write jane [at] corp [dot] com now", "write [PII] now"), (2, "please call (555) 123-4567 now", "please call [PII] now"), (3, "on 2024-01-15 we met", None), (4, "a@b.co, +1 (555) 123-4567.", "[PII], [PII]."), (5, None, None), (6, "", None), (7, "\U0001f600 10.0.0.1\U0001f600", "\U0001f600 [PII]\U0001f600")]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in new], "doc_id long, text string, base string")
    got = pii.redact(df, model)
    assert got.columns == df.columns and {r.doc_id: r.text for r in got.collect()} == {i: t if w is None else w for i, t, w in new}
    spans = {r.doc_id: (r.spans, r.n_spans) for r in pii.scan(df, model).collect()}
    assert spans[1] == ("gbt:6:30", 1) and spans[2] == ("gbt:12:26", 1) and spans[3] == ("", 0)


def test_many_matches_in_one_text(spark):
    """More matches than a block of the fold holds, at places beyond it."""
    text = "".join(f"u{i}@h{i}.org \u00e9" for i in range(1500))
    row = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Boosted()).first()
    assert row.spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERNS["email"], text)) and row.n_email == 1500


def test_boosted_trees_and_their_column_agree(spark):
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 20, (400, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] > 9) & (x[:, 3] < 8)).astype(float)
    model = pii.Boosted()
    model.fit(x, y)
    assert ((model.total(x) > 0) == (y == 1)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in pii.FEATURES))
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(F.struct(*pii.FEATURES).alias("c")).select(model.column(F.col("c"))).collect()]
    assert np.allclose(got, model.total(x[:50]))


# 9. Decontamination.


def alnum_shingles(text):
    words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_decontamination_against_brute_force(spark, odd, none):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 70)))) for i in range(60)] + [(60, None), (61, ""), (None, "a b c d e f"), (3, "one two")]
    docs = []
    for i in range(250):
        body = [rnd.choice(words) for _ in range(rnd.randrange(1500))]
        if i % 2:
            passage = rnd.choice(items[:60])[1].split()
            if i % 3 == 0 and len(passage) > 30:
                passage[rnd.randrange(len(passage))] = "other"
            at = rnd.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((i, " ".join(body)))
    docs += [(None, "x A b, C d e f y"), (900, None), (901, ""), (902, items[5][1]), (902, items[5][1])]
    sets = [(i, alnum_shingles(t)) for i, t in items]

    def inside(s, t):
        (short,) = s if len(s) == 1 else ((),)
        if len(short) < 5 and short:
            words = " ".join(re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower()))
            return f" {' '.join(short)} " in f" {words} "
        return bool(s) and 100 * len(s & alnum_shingles(t)) >= 80 * len(s)

    want = Counter()
    for d, t in docs:
        want.update((d, i) for i, s in sets if inside(s, t))
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(frame, bench)
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want
    clean = decontamination.decontaminate(frame, bench)
    assert clean.columns == frame.columns and Counter(r.doc_id for r in clean.collect()) == Counter(d for d, t in docs if not any(inside(s, t) for _, s in sets))
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"a{i}_{k}" for k in range(20))) for i in range(30)], "item_id long, text string")
    docs = bench.selectExpr("item_id AS doc_id", "concat('before ', text, ' after') AS text")
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 500)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()) == [(i, i) for i in range(30)]


def test_word_hashes():
    texts = ["a B", None, "", " x\ty ", "b", "A\u00e9 b", "b"]
    got, bounds = hashing.word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [2, 0, 0, 2, 1, 2, 1]
    assert got[1] == got[4] == got[7] and len(set(got.tolist())) == 5


# 10. URLs.


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.example.com/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "x://example.com/en/8#f": ("example.com", "/en/8", "com/en/", "block"),
        "http://b.net/de/": ("b.net", "/de/", "net/de/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://net/de/1": ("net", "/de/1", "net/de/", "block"),
        "http://h?q=://z": ("h", "", None, None),
        "http://u://v/w": ("u:", "//v/w", None, None),
        "nothing": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://\u00c4.ORG/es/": ("\u00c4.org", "/es/", "org/es/", "block"),
    }
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(cases)], "page_id long, url string, host string, k int")
    for r in urls.judge(df).collect():
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_reputation_blocks_bad_hosts_only(spark):
    rows = [(i, f"http://bad.x.com/en/{i}") for i in range(50)] + [(100 + i, f"http://good.example.com/en/7{i}") for i in range(50)]
    rows += [(200, "http://bad.x.com/other"), (201, "http://good.example.com/other"), (202, "http://unseen.dev/other"), (203, None)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "block" and got[201] == got[202] == got[203] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
