"""Boxes: overlap, optimal assignment, union regions, label scores and composites."""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsers import last_object
from .text import ACTIONS

CANVAS = 1000


def iou_column(a: Column, b: Column) -> Column:
    """Overlap over union of two arrays [x1, y1, x2, y2]; 0 where they don't overlap."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero)
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda x: F.greatest(x[2] - x[0], zero) * F.greatest(x[3] - x[1], zero)
    return F.when(w * h > 0, w * h / (area(a) + area(b) - w * h)).otherwise(0.0)


def iou(a: list[float], b: list[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: max(0, x[2] - x[0]) * max(0, x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def assignment(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total gain: shortest augmenting paths with potentials, O(n^2 m)."""
    rows, cols = len(gain), len(gain[0]) if gain else 0
    if rows == cols == 1:
        return [(0, 0)]
    if rows > cols:
        return sorted((i, j) for j, i in assignment([list(c) for c in zip(*gain, strict=True)]))
    up, vp, owner = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        slack, back, done = [math.inf] * (cols + 1), [0] * (cols + 1), [False] * (cols + 1)
        while owner[at]:
            done[at] = True
            i, step, to = owner[at], math.inf, 0
            for j in range(1, cols + 1):
                if not done[j]:
                    cost = -gain[i - 1][j - 1] - up[i] - vp[j]
                    if cost < slack[j]:
                        slack[j], back[j] = cost, at
                    if slack[j] < step:
                        step, to = slack[j], j
            for j in range(cols + 1):
                if done[j]:
                    up[owner[j]] += step
                    vp[j] -= step
                else:
                    slack[j] -= step
            at = to
        while at:
            owner[at], at = owner[back[at]], back[at]
    return sorted((owner[j] - 1, j - 1) for j in range(1, cols + 1) if owner[j])


def union_area(boxes: list[list[float]], others: list[list[float]]) -> tuple[int, int]:
    """(intersection, union) of two unions of boxes with truncated coordinates, by compressed coordinates."""
    cut = [[[max(0, min(CANVAS, int(v))) for v in b] for b in side] for side in (boxes, others)]
    if len(boxes) == len(others) == 1:
        (a,), (b,) = cut
        area = lambda x1, y1, x2, y2: max(0, x2 - x1) * max(0, y2 - y1)
        both = area(max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])) if area(*a) and area(*b) else 0
        return both, area(*a) + area(*b) - both
    xs, ys = (sorted({b[k] for side in cut for b in side for k in ks}) for ks in ((0, 2), (1, 3)))
    both = either = 0
    for x1, x2 in zip(xs, xs[1:], strict=False):
        for y1, y2 in zip(ys, ys[1:], strict=False):
            a, b = (any(s[0] <= x1 and x2 <= s[2] and s[1] <= y1 and y2 <= s[3] for s in side) for side in cut)
            size = (x2 - x1) * (y2 - y1)
            both += size * (a and b)
            either += size * (a or b)
    return both, either


def region_score(truth: list, given: list) -> float:
    both, either = union_area(truth, given)
    return both / either if either else 1.0


def hungarian_score(truth: list, given: list) -> float:
    """The best total overlap over the larger count; 0 if a side is empty."""
    if not truth or not given:
        return 0.0
    gain = [[iou(a, b) for b in given] for a in truth]
    return sum(gain[i][j] for i, j in assignment(gain)) / max(len(truth), len(given))


def _clamped(box) -> list[float] | None:
    try:
        values = [float(v) for v in box]
    except (TypeError, ValueError):
        return None
    return [max(0.0, min(float(CANVAS), v)) for v in values] if len(values) == 4 and all(map(math.isfinite, values)) else None


def plain_boxes(raw: str | None) -> list[list[float]]:
    """The four-number arrays of an object's boxes; of text that isn't JSON, all arrays of four integers."""
    import json

    if not (raw or "").strip():
        return []
    try:
        value = json.loads(raw)
    except ValueError:
        return [_clamped(m) for m in re.findall(r"\[(\d+)[,\s]+(\d+)[,\s]+(\d+)[,\s]+(\d+)\]", raw)]
    found = value.get("boxes") if isinstance(value, dict) else None
    return [c for b in found if isinstance(b, list) and (c := _clamped(b))] if isinstance(found, list) else []


def labelled_boxes(value: dict | None) -> list[tuple[list[float], str]]:
    """(box, label) of the entries of an object's boxes that have both."""
    out = []
    for entry in (value or {}).get("boxes") or []:
        if isinstance(entry, dict) and (box := _clamped(entry.get("bbox") or [])) and isinstance(entry.get("label"), str):
            out.append((box, entry["label"].lower()))
    return out


@functools.lru_cache(maxsize=4096)
def _words(label: str) -> frozenset[str]:
    """The action words of a label."""
    return frozenset(w for w in ACTIONS if re.search(rf"\b{w}", label))


@functools.lru_cache(maxsize=4096)
def _vectors(label: str) -> list[list[float]]:
    """The vectors of a label; not to be changed."""
    out = []
    for group in re.findall(r"\(([^()]*)\)", label):
        try:
            values = [float(x) for x in group.split(",")]
        except ValueError:
            continue
        if len(values) in (2, 3) and all(map(math.isfinite, values)):
            out.append(values)
    return out


def _direction(label: str, box: list[float]) -> list[float] | None:
    found = _vectors(label)
    if len(found) != 1:
        return None
    v = found[0]
    return v if len(v) == 3 else [v[0] - (box[0] + box[2]) / 2, (box[1] + box[3]) / 2 - v[1]]


def _agreement(wanted: list[float] | None, given: list[float] | None) -> float:
    """The clamped cosine; 0.1 less where only one has a third value, and then of the first two."""
    if wanted is None:
        return 1.0
    if given is None:
        return 0.0
    n = min(len(wanted), len(given))
    a, b = wanted[:n], given[:n]
    norm = math.hypot(*a) * math.hypot(*b)
    cosine = max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / norm)) if norm >= 1e-12 else 0.0
    return max(0.0, cosine - 0.1) if len(wanted) != len(given) else cosine


def label_score(truth: list[tuple], given: list[tuple], pairs: list[tuple[int, int, float]]) -> float:
    """-1 if any given label has a vector without move, move without one, or more than one; else the mean over
    matched pairs of the share of action words times the overlap, in which move counts by its direction."""
    for _, label in given:
        if len(_vectors(label)) != ("move" in _words(label)):
            return -1.0
    total = 0.0
    for i, j, overlap in pairs:
        wanted, own = _words(truth[i][1]), _words(given[j][1])
        if wanted and own <= wanted:
            points = len(own - {"move"})
            if "move" in own:
                points += _agreement(_direction(truth[i][1], truth[i][0]), _direction(given[j][1], given[j][0]))
            total += points / len(wanted) * overlap
    return total / len(pairs) if pairs else 0.0


def _answered(text: str | None) -> tuple[str | None, list[tuple[list[float], str]]]:
    """(answer in normal form, labelled boxes) of a text's last object."""
    value = last_object(text)
    answer = None if value is None or value.get("answer") is None else re.sub(r"^\((.*)\)$", r"\1", str(value["answer"]).strip().lower()).strip() or None
    return answer, labelled_boxes(value)


#: Many answers are held against one truth.
_wanted = functools.lru_cache(maxsize=1024)(_answered)


def parts(solution: str | None, truth: str | None) -> tuple[float, float, float, int, int]:
    """(answers equal, region score, label score, boxes wanted, boxes given)."""
    (want, a), (got, b) = _wanted(truth), _answered(solution)
    pairs = []
    if a and b:
        gain = [[iou(x[0], y[0]) for y in b] for x in a]
        pairs = [(i, j, gain[i][j]) for i, j in assignment(gain)]
    return float(want is not None and want == got), region_score([x[0] for x in a], [y[0] for y in b]), label_score(a, b, pairs), len(a), len(b)


def box_parts(solution: Column, truth: Column) -> Column:
    """Struct of parts()."""

    def run(given: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parts(s, t) for s, t in zip(given, wanted, strict=True)], columns=["same", "region", "label", "wanted", "given"])

    return F.pandas_udf(run, "struct<same:double,region:double,label:double,wanted:int,given:int>")(solution, truth)


def hungarian_iou(solution: Column, truth: Column) -> Column:
    def run(given: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([hungarian_score(plain_boxes(t), plain_boxes(s)) for s, t in zip(given, wanted, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(solution, truth)


def consistency_score(p: Column, summary: Column) -> Column:
    """0 unless the answers are equal; without boxes wanted 1 (none given) or 0.2; else 0.1 + 0.25 region + 0.25 label + 0.4 summary."""
    full = 0.1 + 0.25 * p["region"] + 0.25 * p["label"] + 0.4 * summary
    return F.when(p["same"] == 0, 0.0).when(p["wanted"] == 0, F.when(p["given"] == 0, 1.0).otherwise(0.2)).otherwise(full)


def detection_score(p: Column, summary: Column) -> Column:
    return 0.25 * p["region"] + 0.25 * p["label"] + 0.5 * summary
