"""Secret scan: base rules, and a character convolutional network over further candidates.

A linear-time filter picks the texts that can hold anything; in those, the base rules find
their spans, and a wide generator proposes runs of token characters. The network (embedding,
convolution, max pooling, one hidden layer; numpy alone) reads each whole candidate and its
context. It is trained on all different labelled findings, with the rules masked: the
keyword before a confirmed value is replaced by another name, and in half of the findings the
value is redrawn from other alphabets and lengths, so that neither gives a finding away.
Candidates outside all base spans are the other class, but for those that an assignment mark
and digits or mixed case make doubtful: they are in neither. Findings are dealt to shards of
bounded size; in each round every shard goes on from the mean of all shards' networks. Scores
are calibrated on all rows that were not trained on, by their counts at each step of the logits;
the threshold is the highest step that keeps the wanted recall there.
What the network adds are candidates outside all base spans.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .calibration import calibrated
from .common import bounded_batches, remove, return_memory, table, written
from .hashing import mix

#: Fixed by the result contract, in its order; A-Z and a-z alone have a case.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ with 32 characters or more
KINDS = ("assign", "access", "hex", "cnn")
#: Candidates of the network: runs of 16 token characters or more, and runs of 8 with a digit or after an assignment mark.
_TOKEN = r"[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{_TOKEN})(?:{_TOKEN}{{16,}}|(?=[A-Za-z+/_-]*[0-9]){_TOKEN}{{8,15}}(?!{_TOKEN}))=*"
ASSIGNED = rf"""[:=]\x20*["']?({_TOKEN}{{8,15}}=*)(?!{_TOKEN})"""
#: A text without any of these has no span of any kind (RE2 syntax).
FILTER = r"""(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_-]{16}|[0-9][A-Za-z0-9+/_-]{7}|[A-Za-z+/_-]{4}[0-9]|[A-Za-z+/_-][0-9][A-Za-z0-9+/_-]|[:=]\x20*["']?[A-Za-z0-9+/_-]{8}"""
#: An assignment mark right before a candidate.
MARKED = r"""[:=]\x20*["']?$"""
#: Findings of a shard of the training, about; rounds over all of them; the share of all that calibrates instead.
SHARD_ROWS = 6000
ROUNDS = 6
CALIBRATE = 0.3
#: Steps of the logits within which calibration counts rows, and the logits beyond which it doesn't tell them apart.
GRID, EDGE = 256, 64
RECALL = 0.98
#: Bytes of texts that are scanned at once.
SLICE_BYTES = 1 << 20
#: Characters of the context on each side.
CONTEXT = 20
_EMBED, _FILTERS, _SPAN, _HIDDEN = 8, 24, 5, 16
_CLASSES = 73
#: Places of a convolution that are held at once, for one row; rows are taken together up to CELLS.
PIECE, CELLS = 2048, 40_000
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' spans, in code points, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _assign().finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(found)


def _assign():
    return re.compile(ASSIGN, re.IGNORECASE | re.ASCII)


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    """What the network reads: context before, the whole candidate, context after."""
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def _lut() -> np.ndarray:
    """Classes of characters: 0 padding, digits and letters, common marks, other ASCII, line ends, anything beyond ASCII."""
    lut = np.full(129, 64, np.int64)
    for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        lut[ord(c)] = i + 1
    for i, c in enumerate("+/_=-.: "):
        lut[ord(c)] = 65 + i if c != " " else 63
    lut[[34, 39]] = 72
    lut[[0, 10, 128]] = 0, 64, 71
    return lut


def codes(windows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of windows as rows of one width, and the lengths of the candidates.

    A row: CONTEXT characters before, the candidate, CONTEXT after, padding: enough for a span
    around the last character, so that what a row gives doesn't depend on the others' lengths.
    """
    sizes = np.array([len(w[1]) for w in windows], np.int64)
    width = int(sizes.max(initial=0)) + 2 * CONTEXT + _SPAN // 2
    joined = "".join((b.rjust(CONTEXT, "\0") + w + a).ljust(width, "\0") for b, w, a in windows)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(windows), width)
    return _lut()[np.minimum(points, 128)], sizes


class CharNet:
    """Embedding, convolution, max pooling over the candidate and over its context, hidden layer, sigmoid; calibrated."""

    def __init__(self, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        self.p = {
            "e": rnd.normal(0, 0.3, (_CLASSES, _EMBED)),
            "w": rnd.normal(0, 0.25, (_SPAN * _EMBED, _FILTERS)),
            "b": np.zeros(_FILTERS),
            "h": rnd.normal(0, 0.2, (2 * _FILTERS, _HIDDEN)),
            "hb": np.zeros(_HIDDEN),
            "o": rnd.normal(0, 0.2, _HIDDEN),
            "ob": np.zeros(1),
        }
        #: Slope and shift of the calibration; probability from which a candidate is a finding; what that keeps on the calibration rows.
        self.slope, self.shift, self.threshold = 1.0, 0.0, 2.0
        self.report: dict[str, float] = {}

    def _patches(self, x: np.ndarray) -> np.ndarray:
        """The embedded characters at each place: row, place, span * embedding."""
        return np.lib.stride_tricks.sliding_window_view(self.p["e"][x], _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, _SPAN * _EMBED)

    def _forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        """Places of the maxima, pooled and hidden values, logits. Places are read in pieces, so a long candidate needs no more memory."""
        p, places = self.p, x.shape[1] - _SPAN + 1
        best = [np.full((len(x), _FILTERS), -1.0) for _ in range(2)]
        at = [np.zeros((len(x), _FILTERS), np.int64) for _ in range(2)]
        for start in range(0, places, PIECE):
            some = slice(start, min(places, start + PIECE))
            conv = np.maximum(self._patches(x[:, some.start : some.stop + _SPAN - 1]) @ p["w"] + p["b"], 0)
            centre = np.arange(some.start, some.stop) + _SPAN // 2
            body = (centre >= CONTEXT) & (centre < CONTEXT + sizes[:, None])
            around = ~body & (centre < 2 * CONTEXT + sizes[:, None])
            for k, mask in enumerate((body, around)):
                own = np.where(mask[:, :, None], conv, -1.0)
                where = own.argmax(1)
                value = np.take_along_axis(own, where[:, None, :], 1)[:, 0]
                more = value > best[k]
                best[k], at[k] = np.where(more, value, best[k]), np.where(more, where + start, at[k])
        flat = np.maximum(np.concatenate(best, 1), 0)
        hidden = np.maximum(flat @ p["h"] + p["hb"], 0)
        return at, flat, hidden, hidden @ p["o"] + p["ob"]

    def logits(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """The network's value of each window, those of about one length together."""
        out = np.zeros(len(windows))
        for some in _alike([len(w[1]) for w in windows]):
            out[some] = self._forward(*codes([windows[i] for i in some]))[-1]
        return out

    def score(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated probabilities."""
        return _sigmoid(self.slope * self.logits(windows) + self.shift)

    def fit(self, windows: list[tuple[str, str, str]], y: np.ndarray, epochs: int = ROUNDS, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> None:
        """Adam on the logistic loss, with the classes weighted alike."""
        state = self.start()
        for k in range(epochs):
            state = self.epoch(state, windows, y, float(y.mean()), batch, rate, [seed, k])
        self.take(state)

    def start(self) -> dict[str, np.ndarray]:
        """What an epoch goes on from: the parameters and Adam's moments and steps."""
        return {f"{part}{k}": v.copy() if part == "p" else np.zeros_like(v) for part in "pmv" for k, v in self.p.items()} | {"t": np.zeros(1)}

    def take(self, state: dict[str, np.ndarray]) -> None:
        self.p = {k: state[f"p{k}"].copy() for k in self.p}

    def epoch(self, state: dict[str, np.ndarray], windows: list[tuple[str, str, str]], y: np.ndarray, share: float, batch: int = 64, rate: float = 3e-3, seed: int | list[int] = 7) -> dict[str, np.ndarray]:
        """The state after one epoch over the windows; share: that of the findings among all rows."""
        rnd, moments, t = np.random.default_rng(seed), {k: (state[f"m{k}"].copy(), state[f"v{k}"].copy()) for k in self.p}, float(state["t"][0])
        self.take(state)
        weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        order = rnd.permutation(len(windows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            t += 1
            total: dict[str, np.ndarray] = {}
            for part in _alike([len(windows[j][1]) for j in some]):
                own = some[part]
                for k, g in self._gradient(*codes([windows[j] for j in own]), y[own], weight[own]).items():
                    total[k] = total.get(k, 0) + g * (len(own) / len(some))
            for k, g in total.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return {f"p{k}": v for k, v in self.p.items()} | {f"{part}{k}": x for k, mv in moments.items() for part, x in zip("mv", mv, strict=True)} | {"t": np.array([t])}

    def calibrate(self, logits: np.ndarray, truth: np.ndarray, rows: np.ndarray) -> None:
        """Slope, shift and threshold from logits with their labels, each of so many rows. Without both kinds they stay."""
        kept = rows[truth].sum()
        if not kept or kept == rows.sum():
            return
        _, self.slope, self.shift = calibrated(logits, truth, rows)
        scores = _sigmoid(self.slope * logits + self.shift)
        own, order = scores[truth], np.argsort(scores[truth], kind="stable")
        self.threshold = float(own[order[np.searchsorted(np.cumsum(rows[truth][order]), int((1 - RECALL) * kept), side="right")]])
        taken = scores >= self.threshold
        self.report = {"recall": float(rows[taken & truth].sum() / kept), "precision": float(rows[taken & truth].sum() / rows[taken].sum()), "rows": float(rows.sum())}

    def _gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        at, flat, hidden, logits = self._forward(x, sizes)
        d = (_sigmoid(logits) - y) * weight / len(x)
        dh = np.outer(d, p["o"]) * (hidden > 0)
        df = (dh @ p["h"].T) * (flat > 0)
        g = {"o": hidden.T @ d, "ob": np.array([d.sum()]), "h": flat.T @ dh, "hb": dh.sum(0), "w": np.zeros_like(p["w"]), "b": df[:, :_FILTERS].sum(0) + df[:, _FILTERS:].sum(0), "e": np.zeros_like(p["e"])}
        rows = np.arange(len(x))[:, None, None]
        for k, where in enumerate(at):
            part = df[:, k * _FILTERS : (k + 1) * _FILTERS]
            read = x[rows, where[:, :, None] + np.arange(_SPAN)]  # row, filter, span
            patches = p["e"][read].reshape(len(x), _FILTERS, _SPAN * _EMBED)
            g["w"] += np.einsum("nf,nfs->sf", part, patches)
            back = (part[:, :, None] * p["w"].T[None]).reshape(len(x), _FILTERS, _SPAN, _EMBED)
            np.add.at(g["e"], read, back)
        return g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _alike(lengths: list[int]) -> Iterator[np.ndarray]:
    """Places of windows of about one length that are read together, so that a long one doesn't widen the others."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * min(PIECE, lengths[order[end]] + 2 * CONTEXT) <= CELLS:
            end += 1
        yield order[start:end]
        start = end


def fit(windows: list[tuple[str, str, str]], labels: list[int]) -> CharNet:
    """A calibrated network with its threshold. Without findings of both kinds it adds nothing."""
    net, y = CharNet(), np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return net
    hold = (mix(np.arange(len(y), dtype=np.uint64)) % np.uint64(1000)).astype(int) < 1000 * CALIBRATE
    some = lambda mask: [w for w, m in zip(windows, mask, strict=True) if m]
    net.fit(some(~hold), y[~hold])
    net.calibrate(net.logits(some(hold)), y[hold] == 1, np.ones(hold.sum()))
    return net


def _candidates(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in re.finditer(CANDIDATE, text)]
    assigned = {m.span(1) for m in re.finditer(ASSIGNED, text)}
    return sorted(assigned.union(found)) if assigned else found


class _Cover:
    """Whether a span overlaps any of some spans, by binary search in their union."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, _, b in spans:  # by start
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def masked(text: str) -> Iterator[tuple[str, str, str]]:
    """Windows of the base findings with the rule masked: another name for the keyword, and once more with another value."""
    for start, kind, end in base_spans(text):
        before, name = text[max(0, start - CONTEXT) : start], ""
        if kind == 0:
            m = _assign().match(text, start)
            name, between, value = m[1], text[m.end(1) : m.start(2)], m[2]
        else:
            between, value = "", text[start:end]
        seed = zlib.crc32(f"{before}{value}".encode("utf-8", "replace"))
        rnd = np.random.default_rng(seed)
        draw = lambda n, letters, rnd=rnd: "".join(letters[i] for i in rnd.integers(0, len(letters), n))
        other = draw(int(rnd.integers(3, 9)), "abcdefghijklmnopqrstuvwxyz_") if name else ""
        after = text[end : end + CONTEXT]
        yield (before + other + between)[-CONTEXT:], value, after
        if name:
            letters = _ALPHABETS[seed % len(_ALPHABETS)]
            value = draw(int(rnd.integers(8, 41)), letters)
            yield (before + other + between)[-CONTEXT:], value[:-1] + (value[-1] if any(c.isdigit() for c in value) else "7"), after


def _findings(text: str) -> Iterator[tuple[tuple[str, str, str], int]]:
    """The labelled windows of a text."""
    for found in masked(text):
        yield found, 1
    cover = _Cover(base_spans(text))
    for a, b in _candidates(text):
        if not cover.meets(a, b):
            before, body, after = window(text, a, b)
            mixed = any(c.isdigit() for c in body) or (body != body.lower() and body[1:] != body[1:].lower())
            if not (mixed and re.search(MARKED, before)):
                yield (before, body, after), 0


def labelled_findings(docs: DataFrame) -> DataFrame:
    """h (a hash), window, label of every labelled finding, different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                kept = {("\0".join(x.replace("\0", " ") for x in found).encode("utf-8", "replace"), label) for _, text in _possible(some.column(1)) for found, label in _findings(text)}
                out = [(int.from_bytes(hashlib.blake2b(told, digest_size=8).digest(), "little", signed=True), told, label) for told, label in kept]
                yield pa.RecordBatch.from_pydict({"h": pa.array([r[0] for r in out], pa.int64()), "window": pa.array([r[1] for r in out], pa.binary()), "label": pa.array([r[2] for r in out], pa.int32())})

    found = docs.select(F.lit(0).alias("zero"), "text").mapInArrow(run, "h bigint, window binary, label int")
    return found.dropDuplicates(["window", "label"])


def _possible(texts: pa.Array) -> list[tuple[int, str]]:
    """(place, text) of the texts in which something can be found."""
    hits = np.flatnonzero(np.array(pc.fill_null(pc.match_substring_regex(texts, FILTER), False)))
    return list(zip(hits.tolist(), texts.take(pa.array(hits)).to_pylist(), strict=True))


def _windows(told: pa.Array | pa.ChunkedArray) -> list[tuple[str, str, str]]:
    return [tuple(w.decode("utf-8", "replace").split("\0", 2)) for w in told.to_pylist()]


def _round(spark: SparkSession, rows: DataFrame, state: dict[str, np.ndarray], share: float, number: int) -> dict[str, np.ndarray]:
    """The mean of what an epoch makes of the state on every shard, weighted by rows. A task holds a shard, the driver one network."""
    sent = spark.sparkContext.broadcast(state)

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("h", "ascending"), ("label", "ascending"), ("window", "ascending")])
        got = CharNet().epoch(sent.value, _windows(shard["window"]), shard["label"].to_numpy().astype(float), share, seed=[7, number])
        told = np.concatenate([got[k].ravel() for k in sorted(got)])
        return pa.table({"place": np.arange(len(told), dtype=np.int32), "shard": np.full(len(told), shard["shard"][0].as_py(), np.int64), "x": told * len(shard), "n": np.full(len(told), len(shard), np.int64)})

    each = rows.groupBy("shard").applyInArrow(run, "place int, shard bigint, x double, n bigint")
    # Added up in the order of the shards, so that a run's rounding is that of any other.
    own = each.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "x"))).alias("all"), F.sum("n").alias("n"))
    mean = own.select("place", (F.aggregate("all", F.lit(0.0), lambda a, s: a + s["x"]) / F.col("n")).alias("x")).toArrow().sort_by("place")["x"].to_numpy()
    sent.unpersist()
    out, at = {}, 0
    for k in sorted(state):
        out[k] = mean[at : at + state[k].size].reshape(state[k].shape)
        at += state[k].size
    return out


def trained(docs: DataFrame, rows: int = SHARD_ROWS) -> CharNet:
    """Fits to all different findings, in shards of some `rows`, and calibrates on all of the rest.

    One pass over the texts; the findings are written, and dealt to shards by their hash.
    """
    spark, net = docs.sparkSession, CharNet()
    found = written(labelled_findings(docs), "findings")
    held_out = F.pmod("h", F.lit(1000)) < 1000 * CALIBRATE
    counts = {(r["held"], r["label"]): r["count"] for r in found.groupBy(held_out.alias("held"), "label").count().collect()}
    fitted = counts.get((False, 0), 0) + counts.get((False, 1), 0)
    if fitted and {label for _, label in counts} == {0, 1}:
        own = found.where(~held_out).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(-(-fitted // rows))))
        state, share = net.start(), counts.get((False, 1), 0) / fitted
        for number in range(ROUNDS):
            state = _round(spark, own, state, share, number)
        net.take(state)
        sent = spark.sparkContext.broadcast(net)

        def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, SLICE_BYTES):
                    steps = np.clip(np.floor(sent.value.logits(_windows(some.column(1))) * GRID), -EDGE * GRID, EDGE * GRID)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(steps.astype(np.int32))], names=["label", "step"])

        steps = found.where(held_out).select("label", "window").mapInArrow(logits, "label int, step int").groupBy("step", "label").count().toArrow().sort_by([("step", "ascending"), ("label", "ascending")])
        net.calibrate(steps["step"].to_numpy() / GRID, steps["label"].to_numpy() == 1, steps["count"].to_numpy().astype(float))
    remove(found)
    return net


def spans_of(texts: pa.Array, net: CharNet) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: (start, kind, end) by start and then kind."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    asked: list[tuple[int, int, int]] = []
    windows: list[tuple[str, str, str]] = []
    for i, text in _possible(texts):
        out[i] = base_spans(text)
        cover = _Cover(out[i])
        for a, b in _candidates(text) if net.threshold <= 1 else ():
            if not cover.meets(a, b):
                asked.append((i, a, b))
                windows.append(window(text, a, b))
    if windows:
        touched = set()
        for (i, a, b), p in zip(asked, net.score(windows), strict=True):
            if p >= net.threshold:
                out[i].append((a, 3, b))
                touched.add(i)
        for i in touched:
            out[i].sort()
    return out


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: CharNet) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans (all of them) of every whole text.

    Null and empty texts have no spans. Null ids and repeated rows are kept. No rows: no rows.
    Other columns are left out, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                found = spans_of(some.column(1), sent.value)
                base = [[s for s in x if s[1] < 3] for x in found]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": some.column(0)}
                    | {f"n_{kind}": pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k, kind in enumerate(KINDS[:3])}
                    | {"base_sha256": pa.array([hashlib.sha256(_told(x).encode()).hexdigest() for x in base], pa.string()), "spans": pa.array([_told(x) for x in found], pa.string()), "n_spans": pa.array([len(x) for x in found], pa.int64())}
                )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint")


def redact(docs: DataFrame, net: CharNet, mark: str = "[SECRET]") -> DataFrame:
    """docs, with all their columns; each span of text, overlapping ones together, is replaced by the mark."""
    bounded_batches(docs.sparkSession)
    sent, at, schema = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            for some in slices(pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["a", "b"]), SLICE_BYTES):
                for text, spans in zip(some.column(1).to_pylist(), spans_of(some.column(1), sent.value), strict=True):
                    if spans:
                        parts, end = [], 0
                        for a, _, b in spans:
                            if a >= end:
                                parts += [text[end:a], mark]
                            end = max(end, b)
                        text = "".join(parts) + text[end:]
                    texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return_memory()

    return docs.mapInArrow(run, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, trained(docs))
