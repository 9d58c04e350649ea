"""Partitioning and packing by load: workloads, differencing, greedy heaps, budgets. One group is one small list."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def workload(length: Column) -> Column:
    return 24576 * length + length * length


def differencing(loads: list[int], k: int, equal: bool = False) -> list[int]:
    """A part from 0 to k - 1 for each load (Karmarkar and Karp): the two states of the largest spread are merged, heavy
    parts with light ones. equal: as many loads in each part, where k divides the count."""
    if equal and len(loads) % k:
        raise ValueError("the loads don't divide into equal parts")
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    heap, tick = [], 0
    starts = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    for some in starts:
        parts = sorted(([loads[i], [i]] for i in some), key=lambda p: -p[0]) + [[0, []] for _ in range(k - len(some))]
        heap.append((-(parts[0][0] - parts[-1][0]), tick, parts))
        tick += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), tick, parts))
        tick += 1
    out = [0] * len(loads)
    for n, (_, members) in enumerate(sorted(heap[0][2], key=lambda p: min(p[1], default=len(loads))) if heap else []):
        for i in members:
            out[i] = n
    return out


def greedy(loads: list[int], k: int, equal: bool = False) -> list[int]:
    """Each load, in the given order, to the part with the smallest sum (that isn't full)."""
    room = len(loads) // k if equal else len(loads)
    heap, out = [(0, n, 0) for n in range(k)], []
    for load in loads:
        total, n, count = heapq.heappop(heap)
        out.append(n)
        if count + 1 < room or not equal:
            heapq.heappush(heap, (total + load, n, count + 1))
    return out


def largest_first(loads: list[int], k: int, most: int | None = None) -> list[int]:
    """Loads in falling order to the part with the smallest sum; ValueError if a part would go over `most`."""
    heap, out = [(0, n) for n in range(k)], [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: -loads[i]):
        total, n = heapq.heappop(heap)
        if most is not None and total + loads[i] > most:
            raise ValueError("no part has room")
        out[i] = n
        heapq.heappush(heap, (total + loads[i], n))
    return out


def keeping_groups(loads: list[int], groups: list, k: int) -> list[int]:
    """Runs of one group stay together, as many runs in each part."""
    runs: list[list[int]] = []
    for i, g in enumerate(groups):
        if i and groups[i - 1] == g:
            runs[-1].append(i)
        else:
            runs.append([i])
    parts = differencing([sum(loads[i] for i in r) for r in runs], k, equal=len(runs) % k == 0)
    out = [0] * len(loads)
    for run, p in zip(runs, parts, strict=True):
        for i in run:
            out[i] = p
    return out


def micro_batches(loads: list[int], budget: int) -> list[int]:
    """Batch of each load: as many batches as the sum needs, balanced, the heaviest in the middle."""
    if max(loads, default=0) > budget:
        raise ValueError("a load is over the budget")
    n = max(1, min(len(loads), math.ceil(sum(loads) / budget)))
    while True:
        parts = differencing([x for x in loads], n)
        sums = [0] * n
        for x, p in zip(loads, parts, strict=True):
            sums[p] += x
        if max(sums, default=0) <= budget or n >= len(loads):
            break
        n += 1
    rising = sorted(range(n), key=lambda p: sums[p])
    middle = rising[::2] + rising[1::2][::-1]
    place = {p: i for i, p in enumerate(middle)}
    return [place[p] for p in parts]


def partition(df: DataFrame, group: list[str], order: str, load: str, method: Callable[[list[int]], list[int]] | dict[str, Callable[[list[int]], list[int]]]) -> DataFrame:
    """Adds part: each group's loads, in order, to parts by the method. A group is one batch, and bounded as that.

    Several methods by name add a column each, in one pass. Groups go through Python by the
    batch, not one by one: a group's first row tells where it begins.
    """
    methods = method if isinstance(method, dict) else {"part": method}
    schema = StructType([*df.schema.fields, *(StructField(name, IntegerType()) for name in methods)])

    def dealt(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        loads = [int(x) for x in rows[load].to_pylist()]
        groups = [loads[a:b] for a, b in zip(starts, [*starts[1:], len(loads)], strict=True)]
        out = rows.drop_columns(["_place"])
        for name, deal in methods.items():
            out = out.append_column(name, pa.array([p for own in groups for p in deal(own)], pa.int32()))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            starts = np.flatnonzero(batch["_place"].to_numpy() == 1)
            if open_group is not None and not len(starts):
                open_group = pa.concat_tables([open_group, new])
                continue
            if open_group is not None:
                yield from dealt(pa.concat_tables([open_group, new.slice(0, starts[0])]), [0])
            if len(starts) > 1:
                yield from dealt(new.slice(starts[0], starts[-1] - starts[0]), (starts[:-1] - starts[0]).tolist())
            if len(starts):
                open_group = new.slice(starts[-1])
        if open_group is not None:
            yield from dealt(open_group, [0])

    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(order).asc_nulls_last())))
    return placed.mapInArrow(run, schema)


def runs(df: DataFrame, order: str, key: str, within: list[str]) -> DataFrame:
    """Adds run: the number of the run of equal keys in a row."""
    w = Window.partitionBy(*within).orderBy(order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
