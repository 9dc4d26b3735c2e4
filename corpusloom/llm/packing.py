"""Filling containers of fixed capacity with texts, as full as can be.

Sizes are whole numbers up to the capacity, so how many items there are of each
size is a table of fixed length, and the packing is planned on that table:

* items above a third of the capacity go at most two to a container; the
  largest is matched with the largest that fits beside it,
* smaller ones, largest first, go where the gap left is the tightest; a new
  container is opened when none fits.

Many containers with the same gap are handled as one *run*, so planning takes
time by sizes and runs, not by items.  Each item then finds its container by
its rank among the items of its size, which is counted in parallel: a rank in
its task and the number of such items in the tasks before.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from .tokens import _load, encoder_of

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first rank, first container, containers, items in each): the
    items of a size, in order of rank, fill the containers of its runs in order.

    ``counts``: number of items of each size from 1 to ``capacity``.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes go from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(size: int, first: int, n: int, each: int = 1) -> None:
        out.append((size, used[size], first, n, each))
        used[size] += n * each
        left[size] -= n * each

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        n = left[s]
        if not n:
            large.pop()
            continue
        k = bisect_left(large, min(s, capacity - s) + 1) - 1
        while k >= 0 and (not left[large[k]] or large[k] == s and n < 2):
            k -= 1
        if k < 0:
            put(s, bins, n)
            add(capacity - s, bins, n)
            bins += n
        elif (t := large[k]) == s:
            put(s, bins, n // 2, 2)
            add(capacity - 2 * s, bins, n // 2)
            bins += n // 2
        else:
            m = min(n, left[t])
            put(s, bins, m)
            put(t, bins, m)
            add(capacity - s - t, bins, m)
            bins += m
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(order, s)
            if k == len(order):
                each = capacity // s
                full, rest = divmod(left[s], each)
                if full:
                    put(s, bins, full, each)
                    add(capacity - each * s, bins, full)
                    bins += full
                if rest:
                    put(s, bins, 1, rest)
                    add(capacity - rest * s, bins, 1)
                    bins += 1
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            m = min(n, left[s])
            if m < n:
                add(gap, first + m, n - m)
            # The tightest gap stays the tightest while it holds another.
            each = min(gap // s, left[s] // m) if m == n else 1
            put(s, first, m, max(1, each))
            add(gap - max(1, each) * s, first, m)
    return out


def token_items(docs: DataFrame, doc_id: str, text: str, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, size, task, at) of each item: a text, or the parts
    of a text longer than the capacity, all but the last as long as that.
    ``at``: rank among the items of that size in its task."""
    shared = _load(docs.sparkSession, vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task, seen = encoder_of(shared), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in parts:
            ids, rows = b.column("d"), []
            for k, t in enumerate(b.column("t")):
                n = e.count(t.as_py())
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    rows.append((k, piece, start, size, task, seen[size]))
                    seen[size] += 1
            if rows:
                c = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[0])), pa.array(c[1].astype(np.int32)), *(pa.array(x) for x in c[2:4]), pa.array(c[4].astype(np.int32)), pa.array(c[5])], ["doc_id", "piece", "start", "size", "task", "at"])

    schema = f"doc_id {kind}, piece int, start long, size long, task int, at long"
    return cut(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema), "items")


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, container, start, n_tokens) of each item of ``token_items``.

    A text without tokens takes no room and has no row.  The plan is exact for
    the counts of all items; equal items are told apart by their place in the
    input only.
    """
    per = items.groupBy("size", "task").agg(F.count("*").alias("n"))
    counts = {int(r["size"]): int(r["n"]) for r in per.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    by: dict[int, tuple[np.ndarray, ...]] = {}
    for s in counts:
        own = sorted((r[1:] for r in runs if r[0] == s))
        by[s] = tuple(np.array(c, np.int64) for c in zip(*own))
    shared = items.sparkSession.sparkContext.broadcast(by)
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("size", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = items.join(base, ["size", "task"]).select("doc_id", "piece", "start", "size", (F.col("base") + F.col("at")).alias("rank"))
    kind = items.schema["doc_id"].dataType.simpleString()

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            box = np.zeros(len(pdf), np.int64)
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            for s in np.unique(size):
                first, start, _, each = shared.value[int(s)]
                here = size == s
                k = np.searchsorted(first, rank[here], side="right") - 1
                box[here] = start[k] + (rank[here] - first[k]) // each[k]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "container": box, "start": pdf["start"], "n_tokens": size})

    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, container long, start long, n_tokens long")


def fill_report(boxes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers the tokens
    allow, the share of room that is used and the fullest container."""
    by = boxes.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return by.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.ceil(F.sum("n") / capacity), F.lit(0)).alias("least_containers"),
        F.round(F.sum("n") / (F.count("*") * capacity), 6).alias("used"), F.max("n").alias("fullest"),
    )
